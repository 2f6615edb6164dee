"""Runs of empty periods and differences after the first sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.functions.rolling import along


def zero_run_length(key: str, day: str, value: str) -> tuple[Column, Column]:
    """(position in the series, length of the run of zeros that ends at the row)."""
    w = along(key, day)
    pos = F.row_number().over(w)
    filled = F.when(F.coalesce(F.col(value), F.lit(1.0)) != 0, F.col("_pos"))
    last = F.max(filled).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pos, F.col("_pos") - F.coalesce(last, F.lit(0))


def zero_runs(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Longest run of zeros per series, and whether a run that long ends the series.

    A series without zeros has length 0 and flag 1.
    """
    pos, run = zero_run_length(key, day, value)
    lengths = df.withColumn("_pos", pos).withColumn("_run", run)
    return lengths.groupBy(key).agg(
        F.max("_run").alias("max_consecutive_zeros"),
        (F.max("_run") == F.max_by("_run", "_pos")).cast("int").alias("max_consecutive_zeros_at_end"),
    )


def with_longest_zero_run(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """The longest run of zeros as a column; stays in the partitioning by series."""
    pos, run = zero_run_length(key, day, value)
    longest = F.max("_run").over(Window.partitionBy(key))
    out = df.withColumn("_pos", pos).withColumn("_run", run)
    return out.withColumn("max_consecutive_zeros", longest).drop("_pos", "_run")


def scaled_differences(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Squared first differences from the first non-zero period on."""
    w = along(key, day)
    started = F.min(F.when(F.col(value) != 0, F.col(day))).over(Window.partitionBy(key))
    change = F.col(value) - F.lag(value).over(w)
    return (
        df.select(key, day, (change * change).alias("squared_diff"), started.alias("_first"))
        .filter(F.col(day) > F.col("_first"))
        .drop("_first")
    )
