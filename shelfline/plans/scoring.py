"""Fitted MLlib models as plain arrays, for jobs that score many times in one pass.

A linear model is its coefficients, a tree its node arrays. Both score a matrix of feature rows
inside an Arrow batch, so a whole recursion or the errors of all prefixes of a boosted model take one
pass over the rows. The arrays are as large as the model, not as the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


@dataclass(frozen=True)
class Tree:
    """A regression tree: node 0 is the root, a leaf has feature -1; ``levels`` holds the left-hand categories of a node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    levels: dict[int, np.ndarray]

    @classmethod
    def parse(cls, text: str) -> Tree:
        """From the printed form of an MLlib tree, which holds every number in full."""
        lines = iter([x.strip() for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))])
        nodes: list[list] = []
        levels: dict[int, np.ndarray] = {}

        def read() -> int:
            at, line = len(nodes), next(lines)
            if line.startswith("Predict"):
                nodes.append([-1, 0.0, -1, -1, float(line.split(":")[1])])
                return at
            _, feature, how, bound = _SPLIT.match(line).groups()
            nodes.append([int(feature), 0.0, -1, -1, 0.0])
            if how == "<=":
                nodes[at][1] = float(bound)
            else:
                levels[at] = np.array([float(x) for x in bound.strip("{}").split(",") if x])
            nodes[at][2] = read()
            next(lines)  # the opposite condition
            nodes[at][3] = read()
            return at

        read()
        feature, threshold, left, right, value = zip(*nodes)
        return cls(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of every row of ``x``."""
        at = np.zeros(len(x), np.int64)
        while True:
            going = np.flatnonzero(self.feature[at] >= 0)
            if not len(going):
                return at
            node = at[going]
            own = x[going, self.feature[node]]
            left = own <= self.threshold[node]
            for n, chosen in self.levels.items():
                here = node == n
                left[here] = np.isin(own[here], chosen)
            at[going] = np.where(left, self.left[node], self.right[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


@dataclass(frozen=True)
class Trees:
    """A weighted sum of trees."""

    trees: tuple[Tree, ...]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(w * t.predict(x) for w, t in zip(self.weights, self.trees))

    def prefixes(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions of the first 1, 2, ... trees."""
        total = np.zeros(len(x))
        for w, t in zip(self.weights, self.trees):
            total = total + w * t.predict(x)
            yield total


@dataclass(frozen=True)
class Line:
    """A linear predictor; ``log`` says that it predicts the log of the mean."""

    coefficients: np.ndarray
    intercept: float
    log: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        eta = x @ self.coefficients + self.intercept
        return np.exp(eta) if self.log else eta


def as_arrays(model: PipelineModel) -> Trees | Line:
    """The last stage of a fitted pipeline as arrays: boosted or single trees, linear or generalised linear regression."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "trees"):
        return Trees(tuple(Tree.parse(t.toDebugString) for t in last.trees), np.array(last.treeWeights))
    if hasattr(last, "toDebugString"):
        return Trees((Tree.parse(last.toDebugString),), np.ones(1))
    log = False
    if last.hasParam("family"):
        link = last.getOrDefault("link") if last.isDefined("link") else None
        power = last.getOrDefault("linkPower") if last.isDefined("linkPower") else None
        tweedie, family = last.getOrDefault("family") == "tweedie", last.getOrDefault("family")
        log = power == 0.0 if tweedie else link == "log" or (link is None and family == "poisson")
        if not log and not (power == 1.0 if tweedie else link == "identity" or (link is None and family == "gaussian")):
            raise ValueError("only identity and log links are known")
    return Line(last.coefficients.toArray(), float(last.intercept), log)


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def prefix_errors(df: DataFrame, model: Trees, columns: Sequence[str], label: str) -> DataFrame:
    """(round, squares, n): squared errors of the first 1, 2, ... trees over all rows, in one pass; a row per round."""
    rounds = len(model.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, n = np.zeros(rounds), 0
        for batch in batches:
            y = batch.column(label).to_numpy(zero_copy_only=False)
            for i, p in enumerate(model.prefixes(matrix(batch, columns))):
                squares[i] += ((y - p) ** 2).sum()
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"round": np.arange(1, rounds + 1, dtype=np.int32), "squares": squares, "n": np.full(rounds, n)})

    rows = df.select(*columns, F.col(label).cast("double").alias(label)).where(F.col(label).isNotNull())
    partial = rows.mapInArrow(run, "round int, squares double, n bigint")
    return partial.groupBy("round").agg(F.sum("squares").alias("squares"), F.sum("n").alias("n"))
