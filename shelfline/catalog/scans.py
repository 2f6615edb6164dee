"""Scans and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfline.catalog.base import DAILY, query
from shelfline.lineage import cut, fresh_path, stage
from shelfline.sources import files, retail


@query(
    "s01_csv_inferred",
    "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_inferred(spark, sf):
    path = fresh_path(spark, "customer-csv")
    files.write_csv(files.table(spark, sf, "customer"), path)
    return files.read_csv_inferred(spark, path)


@query("s02_csv_typed", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority FROM orders")
def csv_typed(spark, sf):
    path = fresh_path(spark, "orders-csv")
    df = files.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", "o_orderpriority"
    )
    files.write_csv(df, path)
    return files.read_csv_typed(spark, path, "o_orderkey bigint, o_orderdate date, o_totalprice double, o_orderpriority string")


@query("s04_row_capped_scan", "SELECT least(count(*), 500) AS n, least(count(*), 500) AS members FROM orders")
def row_capped_scan(spark, sf):
    """The cap is the feature: at most 500 rows of the file, each of them a row of the table."""
    path = fresh_path(spark, "orders-csv")
    orders = files.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    files.write_csv(orders, path)
    head = cut(files.read_head(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string", 500))
    members = head.join(orders.distinct(), orders.columns, "left_semi").agg(F.count(F.lit(1)).alias("members"))
    return head.agg(F.count(F.lit(1)).alias("n")).withColumn("members", members.scalar())


@query(
    "s05_csv_sink",
    DAILY + "SELECT id, CAST(date AS DATE) AS date, demand FROM daily WHERE date > DATE '2001-10-07'",
)
def csv_sink(spark, sf):
    path = fresh_path(spark, "forecast-csv")
    df = retail.daily_window(spark, sf, date(2001, 10, 8), retail.SPAN_END)
    files.write_csv(df.select("id", "date", "demand"), path)
    return files.read_csv_typed(spark, path, "id string, date date, demand double")


@query(
    "s06_report_tables",
    """SELECT 'by_status' AS sheet, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY ALL""",
)
def report_tables(spark, sf):
    orders = files.table(spark, sf, "orders")

    def counts(column: str) -> DataFrame:
        return orders.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))

    sheets = {"by_status": counts("o_orderstatus"), "by_priority": counts("o_orderpriority")}
    paths = files.write_report(sheets, fresh_path(spark, "report"))
    parts = [spark.read.parquet(path).select(F.lit(name).alias("sheet"), "name", "n") for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "s07_stage_checkpoint",
    DAILY + "SELECT 'stage' AS kind, id, date, demand, cents FROM sold UNION ALL SELECT 'checkpoint', id, date, demand, cents FROM sold",
)
def stage_checkpoint(spark, sf):
    df = retail.daily_sold(spark, sf).select("id", "date", "demand", "cents")
    kept = stage(df, "daily-sold").select(F.lit("stage").alias("kind"), "*")
    return kept.unionByName(cut(df).select(F.lit("checkpoint").alias("kind"), "*"))
