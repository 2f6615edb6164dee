"""Wide and long forms, gap filling, horizon rows and labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F


def melt(wide: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, value: str) -> DataFrame:
    return wide.unpivot(list(ids), list(values), var, value)


def pivot(long: DataFrame, ids: Sequence[str], label: str, labels: Sequence[str], value: str) -> DataFrame:
    """One column per label; the label list is given, so no extra pass looks for it."""
    return long.groupBy(*ids).pivot(label, list(labels)).agg(F.first(value))


def pivot_stat(
    long: DataFrame, ids: Sequence[str], label: str, labels: Sequence[str], value: str, stat: str = "mean"
) -> DataFrame:
    agg = {"mean": F.avg, "sum": F.sum}[stat]
    return long.groupBy(*ids).pivot(label, list(labels)).agg(agg(value))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    start: date,
    end: date,
    step_days: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add the missing periods of each series between start and end with value 0.

    Each observed row emits itself and the empty periods up to the next one, so the dense
    table costs one shuffle of the sparse table by series and no grid join. The number of
    partitions is pinned to the session's setting: the bytes of the sparse input say nothing
    about the dense rows that follow, so coalescing by size would leave too few tasks.
    """
    df = df.repartition(shuffle_partitions(df), *keys)
    w = Window.partitionBy(*keys).orderBy(day)
    step = F.expr(f"interval {step_days} days")
    marked = df.withColumns({"_next": F.lead(day).over(w), "_rank": F.row_number().over(w)})
    first = F.when(F.col("_rank") == 1, F.least(F.lit(start), F.col(day))).otherwise(F.col(day))
    last = F.coalesce(F.date_sub("_next", step_days), F.greatest(F.lit(end), F.col(day)))
    return (
        marked.select(
            *keys, *carry, F.col(day).alias("_seen"), value, F.explode(F.sequence(first, last, step)).alias(day)
        )
        .withColumn(value, F.when(F.col(day) == F.col("_seen"), F.col(value)).otherwise(F.lit(0.0)))
        .drop("_seen")
    )


def fill_window(df: DataFrame, keys: Sequence[str], day: str, value: str, start: date, end: date) -> DataFrame:
    """Every series on every day of a short window, 0 where nothing stands; no other day is made.

    Rows outside the window only tell that their series exists: they are dropped map-side, so
    a row per series with its few window values is what is shuffled.
    """
    inside = F.col(day).between(F.lit(start), F.lit(end))
    seen = F.collect_list(F.when(inside, F.struct(F.col(day), F.col(value))))
    days = F.explode(F.sequence(F.lit(start), F.lit(end))).alias(day)
    rows = df.groupBy(*keys).agg(F.map_from_entries(seen).alias("_seen")).select(*keys, "_seen", days)
    return rows.withColumn(value, F.coalesce(F.try_element_at("_seen", F.col(day)), F.lit(0.0))).drop("_seen")


def add_horizon(series: DataFrame, ids: Sequence[str], last: date, days: int, value: str = "demand") -> DataFrame:
    """Append ``days`` future rows with a null value for every series."""
    future = F.sequence(F.lit(last + timedelta(days=1)), F.lit(last + timedelta(days=days)))
    ahead = (
        series.select(*ids)
        .distinct()
        .select(*ids, F.explode(future).alias("date"), F.lit(None).cast("double").alias(value))
    )
    return series.select(*ids, "date", value).unionByName(ahead)


def number_of_label(label: Column | str, prefix: str = "d_") -> Column:
    """``d_17`` -> 17."""
    return F.regexp_replace(label, f"^{prefix}", "").cast("int")


def horizon_label(n: Column) -> Column:
    return F.concat(F.lit("F"), n.cast("string"))


def date_of_label(label: Column | str, first: date) -> Column:
    """Horizon label F1, F2, ... -> date, F1 being ``first``."""
    return F.date_add(F.lit(first), number_of_label(label, "F") - 1)


def swap_suffix(col: Column | str, old: str, new: str) -> Column:
    return F.regexp_replace(col, f"{old}$", new)
