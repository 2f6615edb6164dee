"""Boosted trees for a given loss: squared, Poisson and Tweedie, with row weights and early stopping.

A round fits one MLlib regression tree to the Newton step of every row (minus gradient over hessian,
weighted with the hessian), then sets the tree's leaf values anew from grouped sums of gradient and
hessian, and adds them to the raw score. A tree becomes a column expression, so scoring
stays in generated code; raw scores are written every few rounds, so no plan grows with the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from math import log

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.operators.metrics import loss_gradient
from shelfline.plans.scoring import Tree, Trees

#: Rounds after which raw scores are written.
KEEP = 5


@dataclass(frozen=True)
class Loss:
    """A weighted loss of truth y and raw score f: its value, gradient and hessian, and whether f is the log of the mean."""

    value: Callable[[Column, Column, Column], Column]
    steps: Callable[[Column, Column, Column], dict[str, Column]]
    log: bool

    def start(self, mean: float) -> float:
        return log(max(mean, 1e-9)) if self.log else mean


SQUARED = Loss(lambda y, f, w: w * (y - f) * (y - f), loss_gradient, False)
POISSON = Loss(lambda y, f, w: w * (F.exp(f) - y * f), lambda y, f, w: {"grad": w * (F.exp(f) - y), "hess": w * F.exp(f)}, True)


def tweedie(power: float) -> Loss:
    """Deviance of a compound Poisson variable with variance ``mean ** power``, 1 < power < 2."""
    a, b = 1.0 - power, 2.0 - power
    low, high = (lambda f: F.exp(a * f)), (lambda f: F.exp(b * f))
    return Loss(
        lambda y, f, w: w * (high(f) / b - y * low(f) / a),
        lambda y, f, w: {"grad": w * (high(f) - y * low(f)), "hess": w * (b * high(f) - a * y * low(f))},
        True,
    )


def choose(tree: Tree, columns: Sequence[str], leaf: Callable[[int], Column], at: int = 0) -> Column:
    """``leaf(node)`` of the leaf that a row falls in."""
    if tree.feature[at] < 0:
        return leaf(at)
    x = F.col(columns[tree.feature[at]])
    left = x.isin([float(v) for v in tree.levels[at]]) if at in tree.levels else x <= float(tree.threshold[at])
    return F.when(left, choose(tree, columns, leaf, tree.left[at])).otherwise(choose(tree, columns, leaf, tree.right[at]))


def leaf_sums(rows: DataFrame, tree: Tree, columns: Sequence[str]) -> dict[int, tuple[float, float]]:
    """Sums of gradient and hessian of the training rows of every leaf; as many rows as leaves."""
    leaf = choose(tree, columns, lambda n: F.lit(int(n))).alias("leaf")
    sums = rows.where("NOT _valid").groupBy(leaf).agg(F.sum("grad").alias("g"), F.sum("hess").alias("h"))
    return {r.leaf: (r.g, r.h) for r in sums.collect()}


def refitted(tree: Tree, sums: dict[int, tuple[float, float]], reg: float) -> Tree:
    """The tree with -gradient / (hessian + reg) in its leaves."""
    value = np.zeros(len(tree.value))
    for n, (g, h) in sums.items():
        value[n] = -g / (h + reg) if h + reg > 0 else 0.0
    return replace(tree, value=value)


@dataclass(frozen=True)
class Boosted:
    """A fitted model: raw score = start + step x the trees' sum; ``curve`` has (round, train_loss, valid_loss)."""

    start: float
    step: float
    trees: tuple[Tree, ...]
    loss: Loss
    columns: tuple[str, ...]
    curve: tuple[tuple[int, float, float | None], ...]

    def raw(self) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + self.step * choose(tree, self.columns, lambda n, t=tree: F.lit(float(t.value[n])))
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, the mean."""
        return df.withColumn("prediction", F.exp(self.raw()) if self.loss.log else self.raw())

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean of every row of a feature matrix."""
        raw = self.start + (Trees(self.trees, np.full(len(self.trees), self.step)).predict(x) if self.trees else np.zeros(len(x)))
        return np.exp(raw) if self.loss.log else raw


def boost(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    loss: Loss,
    weight: str | None = None,
    validation: str | None = None,
    rounds: int = 50,
    step: float = 0.1,
    depth: int = 4,
    least_rows: int = 1,
    reg: float = 0.0,
    patience: int = 5,
    bins: int = 64,
    seed: int = 7,
) -> Boosted:
    """Fit ``rounds`` trees, or fewer: with ``validation`` (a boolean column), rounds end when the loss of those rows
    has not fallen for ``patience`` of them, and the trees up to the best one stay.

    ``columns`` must have no nulls; rows with a null label or weight, or no positive weight, are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    valid = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    names = [f"_c{i}" for i in range(len(columns))]
    rows = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names)), F.col(label).cast("double").alias("_y"), w.alias("_w"), valid.alias("_valid"))
    rows = rows.where("_y IS NOT NULL AND _w > 0")
    mean = rows.where("NOT _valid").agg(F.try_divide(F.sum(F.col("_y") * F.col("_w")), F.sum("_w"))).first()[0]
    if mean is None:
        raise ValueError("there are no training rows")
    start = loss.start(mean)
    rows = VectorAssembler(inputCols=names, outputCol="_features").transform(rows.withColumn("_f", F.lit(start)))
    rows = stage(rows, "boosting-rows")
    y, f, w = F.col("_y"), F.col("_f"), F.col("_w")
    grower = DecisionTreeRegressor(featuresCol="_features", labelCol="_target", weightCol="hess", maxDepth=depth, maxBins=bins, minInstancesPerNode=least_rows, seed=seed)

    def losses(data: DataFrame) -> tuple[float, float | None]:
        own = {r["_valid"]: r.l for r in data.groupBy("_valid").agg(F.try_divide(F.sum(loss.value(y, f, w)), F.sum("_w")).alias("l")).collect()}
        return own[False], own.get(True)

    trees: list[Tree] = []
    curve = [(0, *losses(rows))]
    best = 0
    for n in range(1, rounds + 1):
        moved = rows.withColumns(loss.steps(y, f, w)).where("hess > 0")
        target = moved.where("NOT _valid").withColumn("_target", -F.col("grad") / F.col("hess")).select("_features", "_target", "hess")
        tree = Tree.parse(grower.fit(target).toDebugString)
        tree = refitted(tree, leaf_sums(moved, tree, names), reg)
        trees.append(tree)
        rows = rows.withColumn("_f", f + step * choose(tree, names, lambda k, t=tree: F.lit(float(t.value[k]))))
        if n % KEEP == 0:
            rows = stage(rows, "boosting-scores")
        curve.append((n, *losses(rows)))
        if validation:
            if curve[n][2] is not None and curve[n][2] < curve[best][2]:
                best = n
            elif n - best >= patience:
                break
    kept = best if validation and curve[0][2] is not None else len(trees)
    return Boosted(start, step, tuple(trees[:kept]), loss, tuple(columns), tuple(curve))
