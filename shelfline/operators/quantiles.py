"""Exact quantiles of groups that may be larger than a task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from shelfline.operators.running import running_total_by


def group_quantiles(df: DataFrame, key: str, value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """(key, one column per quantile), linear between the two neighbouring values; nulls are left out.

    Equal values are counted first; a running total over the ordered (key, value) counts places
    every value, whatever the size of a group. The two neighbours of a quantile are the values
    whose places hold its position rounded down and up.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total_by(counts, [key], [value], "_n", "_to")
    sizes = placed.groupBy(F.col(key).alias("_key")).agg(F.max("_to").alias("_size"))
    placed = placed.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    first, last = F.col("_to") - F.col("_n"), F.col("_to") - 1
    out, near = {}, F.lit(False)
    for name, q in quantiles.items():
        at = (F.col("_size") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda p: (first <= p) & (p <= last)
        near = near | holds(low) | holds(high)
        below, above = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        out[name] = (below + (above - below) * F.max(at - low)).alias(name)
    return placed.filter(near).groupBy(key).agg(*out.values())
