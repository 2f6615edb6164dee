"""Assertions on outputs, as tables with one row per check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def null_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of null cells over the columns."""
    cells = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(F.lit("null_cells").alias("check_name"), F.coalesce(F.sum(cells), F.lit(0)).cast("bigint").alias("violations"))


def key_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose number of rows differs between the tables."""
    sides = a.select(key, F.lit(1).alias("n")).unionAll(b.select(key, F.lit(-1).alias("n")))
    off = sides.groupBy(key).agg(F.sum("n").alias("n")).filter("n <> 0")
    return off.agg(F.lit("key_mismatches").alias("check_name"), F.count(F.lit(1)).alias("violations"))


def unsorted_rows(df: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """Rows of a series whose ``order`` value falls behind the row before it."""
    before = F.lag(order).over(Window.partitionBy(key).orderBy(position))
    off = df.select((F.col(order) < before).alias("off")).filter("off")
    return off.agg(F.lit("unsorted_rows").alias("check_name"), F.count(F.lit(1)).alias("violations"))
