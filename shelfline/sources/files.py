"""File scans and sinks: CSV in and out, Parquet stages, report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Header row, column types guessed from the data (costs one extra pass)."""
    return spark.read.csv(path, header=True, inferSchema=True)


def read_csv_typed(
    spark: SparkSession, path: str, schema: StructType | str, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Header row, declared types and date format; a cell that does not parse fails the read."""
    return spark.read.schema(schema).csv(
        path, header=True, dateFormat=date_format, mode="FAILFAST", enforceSchema=False
    )


def day_columns(first: int, last: int) -> list[str]:
    return [f"d_{n}" for n in range(first, last + 1)]


def select_days(wide: DataFrame, ids: Sequence[str], first: int, last: int) -> DataFrame:
    """Keep the id columns and the day columns first..last; pruning reaches the scan."""
    return wide.select(*ids, *day_columns(first, last))


def read_head(spark: SparkSession, path: str, schema: StructType | str, n: int) -> DataFrame:
    """The row-capped scan."""
    return read_csv_typed(spark, path, schema).limit(n)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, dateFormat="yyyy-MM-dd")


def write_report(sheets: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """One Parquet table per report sheet; returns sheet name -> path."""
    paths = {}
    for name, df in sheets.items():
        paths[name] = f"{folder}/{name}"
        df.write.parquet(paths[name])
    return paths
