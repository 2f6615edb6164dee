"""The retail model: sales facts, calendar and prices derived from the given tables.

Two grains share one shape (id, item_id, dept_id, cat_id, store_id, state_id, date, demand):

* daily  - item = brand, store = supplier region
* weekly - item = type/brand, store = supplier nation, date = Monday of the week

Facts stay sparse (a row only where something sold) until an operator needs every period.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.lineage import stage
from shelfline.operators.reshape import fill_gaps, fill_window
from shelfline.sources.files import table

# The calendar table covers these whole weeks, and HORIZON days after them.
SPAN_START = date(1995, 1, 2)
SPAN_END = date(2001, 11, 4)
LAST_WEEK = date(2001, 10, 29)
HORIZON = 28

IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]


def days_in_span() -> int:
    return (SPAN_END - SPAN_START).days + 1


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its product and place; money in whole cents."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_name", "r_name")
    )
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("p_brand", "p_type", "n_name", "r_name", "date", "qty", "cents")
    )


def week_start(day: Column | str) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_code(day: Column | str) -> Column:
    """Consecutive week number, 1 for the first week of the span."""
    return (F.floor(F.datediff(day, F.lit(SPAN_START)) / 7) + 1).cast("int")


def _daily_ids(df: DataFrame) -> DataFrame:
    number = F.regexp_extract("item_id", r"(\d+)$", 1).cast("int")
    return df.withColumns(
        {
            "id": F.concat_ws("_", "item_id", "store_id"),
            "dept_id": F.substring("item_id", 1, 7),
            "cat_id": F.when(number <= 12, "LOW").otherwise("HIGH"),
            "state_id": F.when(F.col("store_id") == "AMERICA", "AMER")
            .when(F.col("store_id") == "ASIA", "APAC")
            .otherwise("EMEA"),
        }
    )


def daily_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily facts: (ids, date, demand, cents)."""
    sold = (
        sale_lines(spark, sf_dir)
        .groupBy(F.col("p_brand").alias("item_id"), F.col("r_name").alias("store_id"), "date")
        .agg(F.sum("qty").cast("double").alias("demand"), F.sum("cents").alias("cents"))
    )
    return _daily_ids(sold).select(*IDS, "date", "demand", "cents")


def weekly_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse weekly facts: (ids, date = Monday, demand, cents)."""
    return (
        sale_lines(spark, sf_dir)
        .groupBy("p_type", "p_brand", "n_name", "r_name", week_start("date").alias("date"))
        .agg(F.sum("qty").cast("double").alias("demand"), F.sum("cents").alias("cents"))
        .select(
            F.concat_ws("_", F.concat_ws("/", "p_type", "p_brand"), "n_name").alias("id"),
            F.concat_ws("/", "p_type", "p_brand").alias("item_id"),
            F.col("p_brand").alias("dept_id"),
            F.col("p_type").alias("cat_id"),
            F.col("n_name").alias("store_id"),
            F.col("r_name").alias("state_id"),
            "date",
            "demand",
            "cents",
        )
    )


def staged_daily_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse daily facts, written once; jobs that use them twice read the lines once."""
    return stage(daily_sold(spark, sf_dir), "daily-sold")


def staged_weekly_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(weekly_sold(spark, sf_dir), "weekly-sold")


def daily_series(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    """Every series on every day of the span; demand is 0 where nothing sold."""
    sold = (daily_sold(spark, sf_dir) if sold is None else sold).drop("cents")
    return fill_gaps(sold, ["id"], "date", "demand", SPAN_START, SPAN_END, carry=IDS[1:])


def daily_window(spark: SparkSession, sf_dir: str, first: date, last: date) -> DataFrame:
    """Every series on the days first..last only; a series without a sale there is 0 throughout."""
    return fill_window(daily_sold(spark, sf_dir), IDS, "date", "demand", first, last)


def weekly_series(spark: SparkSession, sf_dir: str, sold: DataFrame | None = None) -> DataFrame:
    sold = (weekly_sold(spark, sf_dir) if sold is None else sold).drop("cents")
    return fill_gaps(
        sold, ["id"], "date", "demand", SPAN_START, LAST_WEEK, step_days=7, carry=IDS[1:]
    )


def prices_of(sold: DataFrame) -> DataFrame:
    """Weekly price per (store, item): cents per unit, whole cents; absent without sales."""
    return (
        sold.groupBy("store_id", "item_id", week_code("date").alias("wm_yr_wk"))
        .agg(F.sum("cents").alias("c"), F.sum("demand").cast("bigint").alias("q"))
        .select("store_id", "item_id", "wm_yr_wk", F.expr("c div q / 100.0D").alias("sell_price"))
    )


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_of(daily_sold(spark, sf_dir))


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices_of(weekly_sold(spark, sf_dir))


# Dates of named days (month, day) and days of the month with a benefit flag.
EVENTS_1 = [
    (1, 1, "NewYear", "National"),
    (2, 14, "ValentinesDay", "Cultural"),
    (7, 4, "IndependenceDay", "National"),
    (10, 31, "Halloween", "Cultural"),
    (12, 25, "Christmas", "National"),
]
EVENTS_2 = [(1, 1, "Bowl", "Sporting"), (10, 31, "Harvest", "Cultural")]
SNAP_CA = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
SNAP_TX = [1, 3, 5, 6, 7, 9, 11, 12, 13, 15]
SNAP_WI = [2, 3, 5, 6, 8, 9, 11, 12, 14, 15]


def _named_day(events: list[tuple], part: int) -> Column:
    out = F.lit(None).cast("string")
    for event in events:
        month, day = event[0], event[1]
        out = F.when((F.month("date") == month) & (F.dayofmonth("date") == day), event[part]).otherwise(out)
    return out


def calendar(spark: SparkSession, extra_days: int = HORIZON, sold: DataFrame | None = None) -> DataFrame:
    """One row per day of the span plus the horizon; a few thousand rows by construction.

    With ``sold`` the span is widened to the days on which something sold, so that no fact is
    without its calendar day. The bounds are aggregates of that table, not constants.
    """
    day = F.dayofmonth("date")
    bounds = spark.range(1) if sold is None else sold.agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    first = F.lit(SPAN_START) if sold is None else F.least(F.lit(SPAN_START), F.col("_from"))
    last = F.lit(SPAN_END) if sold is None else F.greatest(F.lit(SPAN_END), F.col("_to"))
    return (
        bounds.select(F.explode(F.sequence(first, F.date_add(last, extra_days))).alias("date"))
        .select("date", F.concat(F.lit("d_"), day_number("date").cast("string")).alias("d"))
        .select(
            "date",
            week_code("date").alias("wm_yr_wk"),
            F.date_format("date", "EEEE").alias("weekday"),
            F.dayofweek("date").alias("wday"),
            F.month("date").alias("month"),
            F.year("date").alias("year"),
            "d",
            _named_day(EVENTS_1, 2).alias("event_name_1"),
            _named_day(EVENTS_1, 3).alias("event_type_1"),
            _named_day(EVENTS_2, 2).alias("event_name_2"),
            _named_day(EVENTS_2, 3).alias("event_type_2"),
            day.isin(SNAP_CA).cast("int").alias("snap_CA"),
            day.isin(SNAP_TX).cast("int").alias("snap_TX"),
            day.isin(SNAP_WI).cast("int").alias("snap_WI"),
        )
    )


def day_number(day: Column | str) -> Column:
    return F.datediff(day, F.lit(SPAN_START)) + 1


def wide_sales(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """Wide form of the daily series: one row per series, columns d_first..d_last."""
    names = [f"d_{n}" for n in range(first, last + 1)]
    low = SPAN_START + timedelta(days=first - 1)
    high = SPAN_START + timedelta(days=last - 1)
    return (
        daily_window(spark, sf_dir, low, high)
        .withColumn("d", F.concat(F.lit("d_"), day_number("date").cast("string")))
        .groupBy(*IDS)
        .pivot("d", names)
        .agg(F.first("demand"))
    )


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission template: every daily series under both suffixes, F1..F28 = 0."""
    both = F.explode(F.array(F.lit("_validation"), F.lit("_evaluation")))
    zeros = [F.lit(0.0).alias(f"F{n}") for n in range(1, HORIZON + 1)]
    ids = daily_sold(spark, sf_dir).select("id").distinct()
    return ids.select("id", both.alias("half")).select(F.concat("id", "half").alias("id"), *zeros)
