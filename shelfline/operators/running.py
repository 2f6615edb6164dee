"""Positions and running totals over groups too large for one task.

Rows are range-partitioned by their order, each partition is summed on its own, and the
totals of the earlier partitions are added. The placed rows are checkpointed, so a lost
executor cannot move the partition borders between the two uses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.lineage import cut
from shelfline.operators.reshape import shuffle_partitions


def _placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return cut(df.repartitionByRange(shuffle_partitions(df), *order).withColumn("_part", F.spark_partition_id()))


def running_total_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` inside ``keys`` along ``order``; null where the value is null."""
    placed = _placed(df, [*keys, *order])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per key and partition.
    earlier = (
        placed.groupBy(*keys, "_part")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_here", F.sum(value).over(here))
        .join(earlier, [*keys, "_part"])
        .withColumn(out, F.when(F.col(value).isNotNull(), F.col("_before") + F.col("_here")))
        .drop("_part", "_here", "_before")
    )


def period_running_totals(
    df: DataFrame, totals: Mapping[str, tuple[str, Sequence[str]]], value: str, key: str = "id", day: str = "date"
) -> DataFrame:
    """Running totals inside calendar periods, over all series of a group in (series, day) order.

    ``totals`` maps output names to a period (month, week, ...) and group keys. The total at a row is the sum
    of the earlier series of the group in that period plus the running total of its own series, so
    only the (series, period) sums are ordered across series; all periods share one such pass per group.
    """

    def period(unit: str) -> Column:
        return F.struct(F.lit(unit).alias("unit"), F.date_trunc(unit, day).cast("date").alias("start"))

    units = sorted({unit for unit, _ in totals.values()})
    groups = sorted({tuple(by) for _, by in totals.values()})
    keys = sorted({k for by in groups for k in by})
    cells = df.select(key, *keys, F.col(value).alias("_x"), F.explode(F.array(*map(period, units))).alias("_period"))
    sums = cut(cells.groupBy(key, *keys, "_period").agg(F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_sum")))
    for i, by in enumerate(groups):
        sums = running_total_by(sums, [*by, "_period"], [key], "_sum", f"_to_{i}")
    # One row per series with a small map period -> offsets: the rows keep their partitioning.
    before = F.struct(*[(F.col(f"_to_{i}") - F.col("_sum")).alias(f"g{i}") for i in range(len(groups))])
    earlier = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_period", before))).alias("_before"))

    def own(unit: str) -> Column:
        w = Window.partitionBy(key, F.date_trunc(unit, day)).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(value).over(w)

    # Rows of a series stand together once, for the periods, the join and the windows to come.
    out = df.repartition(key).withColumns({f"_own_{u}": own(u) for u in units}).join(earlier, key, "left")
    found = {
        name: F.when(F.col(value).isNotNull(), F.col(f"_own_{u}") + F.try_element_at("_before", period(u))[f"g{groups.index(tuple(by))}"])
        for name, (u, by) in totals.items()
    }
    return out.withColumns(found).drop("_before", *(f"_own_{u}" for u in units))


def positions(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... along ``order`` without gathering them in one task.

    The range partitions are sorted before the checkpoint, so the generated id holds both the
    partition (upper bits) and the place in it (lower 33 bits): one range exchange, no window.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df), *order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_here": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(F.broadcast(earlier), "_part")
        .withColumn(out, (F.col("_before") + F.col("_here")).cast("bigint"))
        .drop("_id", "_part", "_here", "_before")
    )
