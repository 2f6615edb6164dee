"""Forecast and classification metrics.

Series tables are sparse: a missing period is a zero. The scaled error needs no dense
table, because the squared differences across a gap are known in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.operators.hierarchy import LEVELS, membership, roll_up

NODE = ["level", "node"]


def series_scale(nodes: DataFrame, last: date, step_days: int, keys: Sequence[str] = NODE, value: str = "demand") -> DataFrame:
    """Mean squared first difference from the first sale to ``last``: (*keys, scale).

    Between two sales next to each other the difference is taken directly; across a gap the
    series falls to zero and rises again, which adds both squares; after the final sale it
    falls once. A series whose first sale is the last period has no difference: null.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    x, before = F.col(value), F.lag(value).over(w)
    gap = F.datediff("date", F.lag("date").over(w))
    rise = F.when(gap == step_days, (x - before) * (x - before)).when(gap > step_days, before * before + x * x).otherwise(0.0)
    steps = nodes.filter(x != 0).select(*keys, "date", x.alias("_x"), rise.alias("_rise"))
    tail = F.when(F.max("date") < F.lit(last), F.pow(F.max_by("_x", "date"), 2)).otherwise(0.0)
    periods = F.datediff(F.lit(last), F.min("date")) / step_days
    return steps.groupBy(*keys).agg(F.try_divide(F.sum("_rise") + tail, periods).alias("scale"))


def leaf_value(sold: DataFrame, prices: DataFrame, last: date, days: int) -> DataFrame:
    """Money value of each leaf's sales over the last ``days``; a missing price adds nothing."""
    recent = sold.filter(F.col("date") > F.lit(last - timedelta(days=days))).filter(F.col("date") <= F.lit(last))
    return (
        recent.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
        .withColumn("value", F.col("demand") * F.col("sell_price"))
    )


def node_weights(valued: DataFrame) -> DataFrame:
    """Share of each node in its level's value: (level, node, value, weight)."""
    # Every level adds up to the total of the leaves.
    total = valued.agg(F.sum("value")).scalar()
    return roll_up(valued, {"value": "value"}).withColumn("weight", F.try_divide(F.col("value"), total))


def leaf_errors(truth: DataFrame, forecast: DataFrame, ids: Sequence[str]) -> DataFrame:
    """truth - forecast per leaf and period, without a join: sign the rows and add them up."""
    signed = truth.select(*ids, "date", F.col("demand").alias("error")).unionByName(
        forecast.select(*ids, "date", (-F.col("demand")).alias("error"))
    )
    return signed.groupBy(*ids, "date").agg(F.sum("error").alias("error"))


def node_squares(errors: DataFrame) -> DataFrame:
    """Sum of squared node errors over the horizon."""
    nodes = roll_up(errors, {"error": "error"}, ["date"])
    return nodes.groupBy(*NODE).agg(F.sum(F.col("error") * F.col("error")).alias("_sq"))


def with_rmsse(nodes: DataFrame, errors: DataFrame, horizon: int) -> DataFrame:
    """Attach the root mean squared scaled error over ``horizon`` periods to nodes with a scale.

    A node without squared errors forecast every period exactly.
    """
    mean = F.coalesce("_sq", F.lit(0.0)) / horizon
    scaled = F.sqrt(F.try_divide(mean, F.col("scale"))).alias("rmsse")
    return nodes.join(node_squares(errors), NODE, "left").select(*nodes.columns, scaled)


def contributors_base(scale: DataFrame, weights: DataFrame) -> DataFrame:
    """(level, node, scale, weight); the weights of all levels add up to 1.

    A node that sold nothing in the weight window has weight 0.
    """
    share = F.coalesce("weight", F.lit(0.0)) / len(LEVELS)
    return scale.join(weights.select(*NODE, "weight"), NODE, "left").withColumn("weight", share)


def contributors(scale: DataFrame, weights: DataFrame, errors: DataFrame, horizon: int) -> DataFrame:
    """(level, node, scale, weight, rmsse, contribution)."""
    parts = with_rmsse(contributors_base(scale, weights), errors, horizon)
    return parts.withColumn("contribution", F.col("rmsse") * F.col("weight"))


def wrmsse(parts: DataFrame) -> DataFrame:
    return parts.agg(F.sum("contribution").alias("wrmsse"))


def wrmsse_by_level(parts: DataFrame) -> DataFrame:
    """Score of each level and their mean as 'overall', in one pass."""
    sums = parts.rollup("level").agg(F.sum("contribution").alias("_sum"), F.grouping("level").alias("_all"))
    return sums.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col("level")).alias("level"),
        F.when(F.col("_all") == 1, F.col("_sum")).otherwise(F.col("_sum") * len(LEVELS)).alias("wrmsse"),
    )


def leaf_sample_weight(products: DataFrame, weights: DataFrame, scale: DataFrame, leaf: str = "id") -> DataFrame:
    """Per leaf: sum over the nodes above it of weight / sqrt(scale)."""
    per_node = weights.join(scale, NODE).select(*NODE, F.try_divide(F.col("weight") / len(LEVELS), F.sqrt("scale")).alias("_w"))
    return (
        membership(products, leaf).join(per_node, NODE, "left").groupBy(leaf).agg(F.sum("_w").alias("sample_weight"))
    )


def loss_gradient(y: Column, p: Column, weight: Column) -> dict[str, Column]:
    """Gradient and hessian of the weighted squared loss."""
    return {"grad": -2 * weight * (y - p), "hess": 2 * weight}


# Metrics as aggregate expressions of (truth, prediction).
def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """Coefficient of determination times 100."""
    rest = F.sum((y - p) * (y - p))
    return 100 * (1 - F.try_divide(rest, F.var_pop(y) * F.count(y)))


def quadratic_kappa(a: Column, b: Column) -> Column:
    """Quadratic weighted kappa; squared distances need only the moments of both ratings."""
    a, b = a.cast("double"), b.cast("double")
    seen = F.avg((a - b) * (a - b))
    expected = F.avg(a * a) - 2 * F.avg(a) * F.avg(b) + F.avg(b * b)
    return 1 - F.try_divide(seen, expected)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings beyond chance, as a one-row table."""
    sides = F.array(
        F.struct(F.col(a).alias("c"), F.lit(1).alias("na"), F.lit(0).alias("nb")),
        F.struct(F.col(b).alias("c"), F.lit(0).alias("na"), F.lit(1).alias("nb")),
    )
    per_class = (
        df.select((F.col(a) == F.col(b)).cast("int").alias("same"), F.explode(sides).alias("s"))
        .groupBy("s.c")
        .agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"), F.sum(F.col("same") * F.col("s.na")).alias("same"))
    )
    n = F.sum("na").cast("double")
    found = per_class.agg((F.sum("same") / n).alias("po"), (F.sum(F.col("na") * F.col("nb")) / (n * n)).alias("pe"))
    return found.select(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


Metric = Callable[[Column, Column], Column]


def score(df: DataFrame, metrics: Mapping[str, Metric], truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Apply named metrics per group in one aggregation."""
    return df.groupBy(*by).agg(*[fn(F.col(truth), F.col(prediction)).alias(name) for name, fn in metrics.items()])


def best_of_two(truth: Column, a: Column, b: Column) -> Column:
    """Per row the prediction closer to the truth; ``a`` on ties."""
    return F.when(F.abs(a - truth) <= F.abs(b - truth), a).otherwise(b)
