"""Scalar functions, on order dates and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.catalog.base import query, r6
from shelfline.functions import dates, scalars
from shelfline.sources import files

_D = "CAST(o_orderdate AS DATE)"


def _orders(spark, sf, *columns):
    df = files.table(spark, sf, "orders")
    return df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), *columns)


def _int(expr: str, name: str) -> str:
    return f"CAST({expr} AS INTEGER) AS {name}"


@query(
    "f01_date_parts",
    f"SELECT o_orderkey, {_int(f'year({_D})', 'year')}, {_int(f'quarter({_D})', 'quarter')}, {_int(f'month({_D})', 'month')}, "
    f"{_int(f'weekofyear({_D})', 'week')}, {_int(f'day({_D})', 'day')}, {_int(f'isodow({_D}) - 1', 'dayofweek')} FROM orders",
)
def date_parts(spark, sf):
    return _orders(spark, sf).select("o_orderkey", *[c.alias(n) for n, c in dates.parts("date").items()])


@query(
    "f02_weekday_weekend",
    f"SELECT o_orderkey, {_int(f'isodow({_D}) - 1', 'dow')}, {_int(f'isodow({_D}) >= 6', 'is_weekend')} FROM orders",
)
def weekday_weekend(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey", dates.monday_zero("date").alias("dow"), dates.is_weekend("date").alias("is_weekend")
    )


@query(
    "f03_period_edges",
    "SELECT o_orderkey, "
    + ", ".join(
        f"{_int(f'date_trunc({chr(39)}{u}{chr(39)}, {_D}) = {_D}', f'is_{u}_start')}, "
        f"{_int(f'date_trunc({chr(39)}{u}{chr(39)}, {_D} + 1) = {_D} + 1', f'is_{u}_end')}"
        for u in ("year", "quarter", "month")
    )
    + " FROM orders",
)
def period_edges(spark, sf):
    return _orders(spark, sf).select("o_orderkey", *[c.alias(n) for n, c in dates.edge_flags("date").items()])


@query("f04_week_of_month", f"SELECT o_orderkey, {_int(f'ceil(day({_D}) / 7.0)', 'tm_wm')} FROM orders")
def week_of_month(spark, sf):
    return _orders(spark, sf).select("o_orderkey", dates.week_of_month("date").alias("tm_wm"))


@query(
    "f05_sunday_weeks",
    f"SELECT o_orderkey, {_int(f'dayofweek({_D}) + 1', 'wday')}, {_int(f'(dayofyear({_D}) - 1) // 7 + 1', 'week')} FROM orders",
)
def sunday_weeks(spark, sf):
    return _orders(spark, sf).select(
        "o_orderkey", dates.sunday_one("date").alias("wday"), dates.seven_day_week("date").alias("week")
    )


@query(
    "f06_parse_format_add",
    f"""SELECT o_orderkey, strftime({_D}, '%Y/%m/%d') AS text, {_D} AS parsed, CAST({_D} + 27 AS DATE) AS later, CAST({_D} - 28 AS DATE) AS earlier,
CAST(date_diff('day', DATE '1995-01-02', {_D}) AS INTEGER) AS age FROM orders""",
)
def parse_format_add(spark, sf):
    df = _orders(spark, sf).withColumn("text", F.date_format("date", "yyyy/MM/dd"))
    parsed = F.to_date("text", "yyyy/MM/dd")
    return df.select(
        "o_orderkey",
        "text",
        parsed.alias("parsed"),
        F.date_add(parsed, 27).alias("later"),
        F.date_sub(parsed, 28).alias("earlier"),
        F.datediff(parsed, F.lit("1995-01-02").cast("date")).alias("age"),
    )


@query(
    "f07_string_functions",
    """SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS starts, ends_with(p_brand, '5') AS ends, contains(p_name, 'red') AS has_red,
replace(p_brand, '#', '_') AS swapped, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS pattern, split_part(p_name, ' ', 2) AS second,
substr(p_type, 1, 3) AS short, p_type || '-' || p_brand AS joined FROM part""",
)
def string_functions(spark, sf):
    df = files.table(spark, sf, "part")
    return df.select(
        "p_partkey",
        F.startswith("p_brand", F.lit("Brand#1")).alias("starts"),
        F.endswith("p_brand", F.lit("5")).alias("ends"),
        F.contains("p_name", F.lit("red")).alias("has_red"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("swapped"),
        F.regexp_replace("p_brand", "[0-9]+", "N").alias("pattern"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        F.substring("p_type", 1, 3).alias("short"),
        F.concat_ws("-", "p_type", "p_brand").alias("joined"),
    )


@query(
    "f08_arithmetic",
    """SELECT c_custkey, abs(c_acctbal) AS abs, round(sqrt(abs(c_acctbal)), 6) AS sqrt, round(c_acctbal * c_acctbal, 2) AS square,
CAST(ceil(c_acctbal) AS BIGINT) AS ceil, round(c_acctbal / 7, 3) AS round3, round(exp(c_acctbal / 100000) - 1, 8) AS expm1,
CAST(sign(c_acctbal) AS DOUBLE) AS sign, least(c_acctbal, 1000) AS low, greatest(c_acctbal, 1000) AS high FROM customer""",
)
def arithmetic(spark, sf):
    x = F.col("c_acctbal")
    return files.table(spark, sf, "customer").select(
        "c_custkey",
        F.abs(x).alias("abs"),
        r6(F.sqrt(F.abs(x))).alias("sqrt"),
        F.round(x * x, 2).alias("square"),
        F.ceil(x).alias("ceil"),
        F.round(x / 7, 3).alias("round3"),
        F.round(F.expm1(x / 100000), 8).alias("expm1"),
        F.signum(x).alias("sign"),
        F.least(x, F.lit(1000.0)).alias("low"),
        F.greatest(x, F.lit(1000.0)).alias("high"),
    )


@query(
    "f09_nulls_and_recode",
    """SELECT d.doc_id, CAST(quality IS NULL AS INTEGER) AS no_label, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS recoded,
CASE WHEN n_chars > 500 THEN n_chars END AS long_chars FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def nulls_and_recode(spark, sf):
    df = files.table(spark, sf, "documents").select("doc_id", "n_chars")
    df = df.join(files.table(spark, sf, "labels"), "doc_id", "left")
    return df.select(
        "doc_id",
        F.col("quality").isNull().cast("int").alias("no_label"),
        scalars.recode(F.col("quality"), {1: "good", 0: "poor"}).alias("recoded"),
        F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("long_chars"),
    )


@query(
    "f10_guarded_ratio",
    "SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS date, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio FROM lineitem",
)
def guarded_ratio(spark, sf):
    ratio = scalars.ratio(F.col("l_extendedprice"), F.col("l_discount"))
    return files.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"), F.round(ratio, 4).alias("ratio")
    )
