"""Cleaning: outliers, nulls, type narrowing, release trimming, history splice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ByteType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructType,
)

from shelfline.functions.rolling import along

# Strict bounds of the narrowing rule; a column that touches a bound keeps the wider type.
INT_BOUNDS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
FLOAT_MAX = 3.4028234663852886e38

_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def narrow_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast every numeric column to the smallest type its values allow.

    One aggregate pass finds the ranges. Returns the narrowed table and a report with one
    row per column (column_name, old_type, new_type, old_bytes, new_bytes).
    """
    numeric = [
        f for f in df.schema.fields if isinstance(f.dataType, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType))
    ]
    aggs = [a for f in numeric for a in (F.min(f.name).alias(f"lo_{f.name}"), F.max(f.name).alias(f"hi_{f.name}"))]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    chosen = {}
    for f in numeric:
        low, high, old = found[f"lo_{f.name}"], found[f"hi_{f.name}"], f.dataType.simpleString()
        new = old
        if low is not None and old in ("double", "float"):
            new = "float" if -FLOAT_MAX < low and high < FLOAT_MAX else old
        elif low is not None and old != "tinyint":
            new = next((t for t, bound in INT_BOUNDS if low > -bound and high < bound - 1), "bigint")
        chosen[f.name] = (old, new)
    narrowed = df.select(*[F.col(c).cast(chosen[c][1]) if c in chosen else F.col(c) for c in df.columns])
    report = df.sparkSession.createDataFrame(
        [(c, old, new, found["rows"] * _WIDTH[old], found["rows"] * _WIDTH[new]) for c, (old, new) in chosen.items()],
        "column_name string, old_type string, new_type string, old_bytes bigint, new_bytes bigint",
    )
    return narrowed, report


def like_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Reorder and cast to a reference schema; columns outside it are dropped."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def trim_before_release(sales: DataFrame, prices: DataFrame, week: str = "wm_yr_wk") -> DataFrame:
    """Keep weeks from the first priced week of a (store, item) on; add weeks since release."""
    release = prices.groupBy("store_id", "item_id").agg(F.min(week).alias("_first"))
    return (
        sales.join(release, ["store_id", "item_id"], "left")
        .filter(F.col(week) >= F.col("_first"))
        .withColumn("release", F.col(week) - F.col("_first"))
        .drop("_first")
    )


def difference(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """First difference per series; days where any series has no difference are dropped."""
    w = along(key, day)
    before = F.lag(value).over(w)
    out = df.withColumns({"shifted_demand": before, value: F.col(value) - before})
    broken = out.filter(F.col(value).isNull()).select(day).distinct()
    return out.join(broken, day, "left_anti")


def cap_outliers(df: DataFrame, key: str, value: str, sigmas: float = 4.0, floor: float = 2.0) -> DataFrame:
    """Cap at max(floor, mean + sigmas * std) of the series; ``was_capped`` marks changed rows.

    The moments are aggregated per series and joined back, so a long series is not
    gathered in one task.
    """
    limit = (
        df.groupBy(key)
        .agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        .select(key, F.greatest(F.lit(floor), F.col("_m") + sigmas * F.col("_s")).alias("new_max"))
    )
    out = df.join(limit, key, "left")
    over = F.col(value) > F.col("new_max")
    return out.withColumns(
        {"was_capped": F.coalesce(over, F.lit(False)).cast("int"), value: F.when(over, F.col("new_max")).otherwise(F.col(value))}
    )


def winsorise(df: DataFrame, key: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip at two exact per-series quantiles; ``was_clipped`` marks changed rows."""
    bounds = df.groupBy(key).agg(F.percentile(value, [low, high]).alias("_q"))
    out = df.join(bounds, key, "left").withColumns({"_lo": F.col("_q")[0], "_hi": F.col("_q")[1]})
    x = F.col(value)
    outside = (x < F.col("_lo")) | (x > F.col("_hi"))
    return out.withColumns(
        {"was_clipped": outside.cast("int"), value: F.least(F.greatest(x, F.col("_lo")), F.col("_hi"))}
    ).drop("_q", "_lo", "_hi")


def spliced(history: DataFrame, score: DataFrame, keep_days: int, day: str, features) -> DataFrame:
    """Features for ``score`` rows computed with the last ``keep_days`` of history in front."""
    last = history.agg(F.max(day)).scalar()
    first = score.agg(F.min(day)).scalar()
    recent = history.filter(F.col(day) > F.date_sub(last, keep_days))
    return features(recent.unionByName(score)).filter(F.col(day) >= first)


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, keep: Sequence[str]) -> DataFrame:
    """One row per key: the one with the smallest ``order`` value."""
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in keep])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def clamp_at_zero(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def undo_log_difference(shifted: Column, change: Column) -> Column:
    return F.expm1(shifted + change)


def members(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose ``keys`` are in the table ``chosen``, however long it is.

    A key that is a folder of ``df`` prunes the scan at run time to the folders the list names.
    """
    return df.join(chosen.select(*keys).distinct(), list(keys), "left_semi")
