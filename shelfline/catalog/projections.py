"""Projections, filters, reshaping and cleaning."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfline.catalog.base import DAILY, DAILY_SOLD, WEEKLY, query, r6
from shelfline.functions.rolling import along, with_count_rolling
from shelfline.functions.scalars import price_bin
from shelfline.lineage import stage
from shelfline.operators import checks, clean, reshape
from shelfline.operators.prices import with_price_per_day
from shelfline.sources import files, retail

_F_COLS = [f"F{n}" for n in range(1, 29)]
_LAST28 = date(2001, 10, 8)
_SPLIT = "DATE '2001-10-07'"


def _w():
    return along("id", "date")


def _wide_cols(first: int, last: int) -> str:
    return ", ".join(f"max(CASE WHEN cal.dn = {n} THEN demand END) AS d_{n}" for n in range(first, last + 1))


#: Days of the whole wide table.
_ALL = retail.days_in_span()


def _wide_file(spark, sf) -> DataFrame:
    """The wide table with a column for every day, written and read back."""
    return stage(retail.wide_sales(spark, sf, 1, _ALL), "wide-sales")


@query(
    "s03_day_range_columns",
    DAILY
    + f"SELECT id, item_id, dept_id, cat_id, store_id, state_id, {_wide_cols(11, 40)} FROM daily JOIN cal USING (date) GROUP BY ALL",
)
def day_range_columns(spark, sf):
    """Thirty of all day columns; only these are read from the file."""
    return files.select_days(_wide_file(spark, sf), retail.IDS, 11, 40)


@query(
    "p01_melt_wide_days",
    DAILY + "SELECT id, item_id, store_id, cal.d, demand FROM daily JOIN cal USING (date)",
)
def melt_wide_days(spark, sf):
    return reshape.melt(_wide_file(spark, sf), ["id", "item_id", "store_id"], files.day_columns(1, _ALL), "d", "demand")


_PIVOT28 = ", ".join(f"max(CASE WHEN date = DATE '2001-10-07' + {n} THEN demand END) AS F{n}" for n in range(1, 29))


def _last_28(spark, sf) -> DataFrame:
    """The last 28 days of every series with their horizon label."""
    df = retail.daily_window(spark, sf, _LAST28, retail.SPAN_END)
    return df.withColumn("F", reshape.horizon_label(F.datediff("date", F.lit(_LAST28)) + 1))


@query("p02_pivot_horizon", DAILY + f"SELECT id, {_PIVOT28} FROM daily WHERE date > {_SPLIT} GROUP BY id")
def pivot_horizon(spark, sf):
    return reshape.pivot(_last_28(spark, sf), ["id"], "F", _F_COLS, "demand")


@query(
    "p03_pivot_table_mean",
    DAILY
    + "SELECT store_id, "
    + ", ".join(f"round(avg(demand) FILTER (WHERE year(date) = {y}), 6) AS y{y}" for y in range(1995, 2002))
    + " FROM daily GROUP BY store_id",
)
def pivot_table_mean(spark, sf):
    df = retail.daily_series(spark, sf).withColumn("y", F.concat(F.lit("y"), F.year("date").cast("string")))
    years = [f"y{y}" for y in range(1995, 2002)]
    out = reshape.pivot_stat(df, ["store_id"], "y", years, "demand", "mean")
    return out.select("store_id", *[r6(y).alias(y) for y in years])


@query(
    "p04_stacked_weights",
    WEEKLY
    + "SELECT id, date, demand * sell_price AS value FROM weekly LEFT JOIN prices ON prices.store_id = weekly.store_id AND prices.item_id = weekly.item_id AND prices.wm_yr_wk = weekly.wk WHERE wk > 353",
)
def stacked_weights(spark, sf):
    sold = retail.staged_weekly_sold(spark, sf)
    df = retail.weekly_series(spark, sf, sold).filter(F.col("date") > F.lit(retail.LAST_WEEK - timedelta(weeks=4)))
    df = df.withColumn("wm_yr_wk", retail.week_code("date"))
    df = df.join(retail.prices_of(sold), ["store_id", "item_id", "wm_yr_wk"], "left")
    return df.select("id", "date", (F.col("demand") * F.col("sell_price")).alias("value"))


@query(
    "p05_horizon_extension",
    DAILY
    + """SELECT id, item_id, store_id, date, demand FROM daily
UNION ALL SELECT id, item_id, store_id, cal.date, NULL FROM ids CROSS JOIN cal WHERE cal.dn > 2499""",
)
def horizon_extension(spark, sf):
    return reshape.add_horizon(retail.daily_series(spark, sf), ["id", "item_id", "store_id"], retail.SPAN_END, 28)


@query(
    "p06_select_drop_rename",
    "SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_nationkey FROM customer",
)
def select_drop_rename(spark, sf):
    return (
        files.table(spark, sf, "customer")
        .withColumnRenamed("c_custkey", "customer_id")
        .withColumnRenamed("c_mktsegment", "segment")
        .drop("c_name", "c_acctbal")
    )


@query("p07_regex_columns", "SELECT l_quantity, l_extendedprice, l_tax, l_discount FROM lineitem")
def regex_columns(spark, sf):
    df = files.table(spark, sf, "lineitem")
    return df.select(df.colRegex("`l_(quantity|extendedprice|tax|discount)`"))


@query(
    "p08_date_window_clip",
    DAILY + "SELECT id, date, demand FROM daily WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-06-30'",
)
def date_window_clip(spark, sf):
    return retail.daily_window(spark, sf, date(1999, 3, 1), date(1999, 6, 30)).select("id", "date", "demand")


@query(
    "p09_day_membership",
    "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')",
)
def day_membership(spark, sf):
    df = files.table(spark, sf, "events").select("event_id", "event_type", "value")
    return df.filter(F.col("event_type").isin("click", "purchase"))


@query(
    "p09_long_day_list",
    "WITH "
    + DAILY_SOLD
    + """, busy AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1 HAVING count(*) >= 3)
SELECT id, date, demand FROM sold WHERE date IN (SELECT date FROM busy)""",
)
def long_day_list(spark, sf):
    """Sales on the days of a list that is a table itself; facts are kept by month, so other months are not read."""
    month = F.date_trunc("month", "date").cast("date")
    sold = retail.daily_sold(spark, sf).select("id", "date", "demand", month.alias("month"))
    sold = stage(sold.repartition("month"), "sold-by-month", by=["month"])
    orders = files.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
    busy = orders.agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("date", month.alias("month"))
    return clean.members(sold, busy, ["month", "date"]).drop("month")


@query(
    "p10_drop_nulls",
    DAILY
    + """SELECT id, date, sell_price, demand FROM daily JOIN cal USING (date)
LEFT JOIN prices USING (store_id, item_id, wm_yr_wk) WHERE sell_price IS NOT NULL""",
)
def drop_nulls(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    df = with_price_per_day(retail.daily_series(spark, sf, sold), retail.prices_of(sold))
    return df.select("id", "date", "sell_price", "demand").na.drop()


@query(
    "p11_trim_before_release",
    WEEKLY
    + """, f AS (SELECT store_id, item_id, min(wm_yr_wk) AS first_week FROM prices GROUP BY ALL)
SELECT id, date, demand, wk AS wm_yr_wk, wk - first_week AS release
FROM weekly JOIN f USING (store_id, item_id) WHERE wk >= first_week""",
)
def trim_before_release(spark, sf):
    sold = retail.staged_weekly_sold(spark, sf)
    sales = retail.weekly_series(spark, sf, sold).withColumn("wm_yr_wk", retail.week_code("date"))
    out = clean.trim_before_release(sales, retail.prices_of(sold))
    return out.select("id", "date", "demand", "wm_yr_wk", "release")


@query(
    "p12_segment_filter",
    DAILY + "SELECT id, date, demand FROM daily WHERE store_id = 'ASIA' AND cat_id = 'HIGH'",
)
def segment_filter(spark, sf):
    # The segment is cut out of the sales, before days without a sale are filled in.
    sold = retail.daily_sold(spark, sf).filter((F.col("store_id") == "ASIA") & (F.col("cat_id") == "HIGH"))
    return retail.daily_series(spark, sf, sold).select("id", "date", "demand")


_TEMPLATE = DAILY + ", template AS (SELECT id || half AS id FROM ids CROSS JOIN (VALUES ('_validation'), ('_evaluation')) h(half))\n"


@query("p13_suffix_filter", _TEMPLATE + "SELECT id FROM template WHERE id LIKE '%validation' AND id LIKE '%ASIA%'")
def suffix_filter(spark, sf):
    df = retail.template(spark, sf).select("id")
    return df.filter(F.col("id").endswith("validation") & F.col("id").contains("ASIA"))


@query(
    "p14_suffix_swap",
    _TEMPLATE + "SELECT id, regexp_replace(id, '_validation$', '_evaluation') AS swapped FROM template",
)
def suffix_swap(spark, sf):
    df = retail.template(spark, sf)
    return df.select("id", reshape.swap_suffix("id", "_validation", "_evaluation").alias("swapped"))


@query(
    "p15_fill_missing",
    DAILY
    + """SELECT id, date, coalesce(sell_price, 0) AS sell_price, coalesce(event_name_1, 'NA') AS event_name_1
FROM daily JOIN cal USING (date) LEFT JOIN prices USING (store_id, item_id, wm_yr_wk)""",
)
def fill_missing(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    df = with_price_per_day(retail.daily_series(spark, sf, sold), retail.prices_of(sold))
    df = df.join(F.broadcast(retail.calendar(spark, sold=sold).select("date", "event_name_1")), "date")
    return df.select("id", "date", "sell_price", "event_name_1").na.fill({"sell_price": 0.0, "event_name_1": "NA"})


def _narrow_sql() -> str:
    """Type per column of lineitem's numeric columns, decided by the same strict bounds."""
    ints = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    floats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = []
    for c in ints:
        old, width = ("int", 4) if c == "l_linenumber" else ("bigint", 8)
        t = (
            f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' "
            f"WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END"
        )
        rows.append(f"SELECT '{c}' AS column_name, '{old}' AS old_type, {t} AS new_type, count(*) * {width} AS old_bytes, count(*) AS n FROM lineitem")
    for c in floats:
        rows.append(f"SELECT '{c}', 'double', 'float', count(*) * 8, count(*) FROM lineitem")
    return (
        "SELECT column_name, old_type, new_type, CAST(old_bytes AS BIGINT) AS old_bytes, "
        "CAST(n * CASE new_type WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'bigint' THEN 8 ELSE 4 END AS BIGINT) AS new_bytes FROM ("
        + " UNION ALL ".join(rows)
        + ")"
    )


@query("p16_narrow_types", _narrow_sql())
def narrow_types(spark, sf):
    return clean.narrow_types(files.table(spark, sf, "lineitem"))[1]


_NARROWED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query(
    "p16_narrowed_rows",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, sum(CAST({c} AS DOUBLE)) AS total, min(CAST({c} AS DOUBLE)) AS low, max(CAST({c} AS DOUBLE)) AS high,"
        f" CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem"
        for c in _NARROWED
    ),
)
def narrowed_rows(spark, sf):
    """Checksums of every whole-number column of the narrowed table: nothing is lost with the width."""
    narrowed, _ = clean.narrow_types(files.table(spark, sf, "lineitem"))
    narrowed = stage(narrowed.select(*_NARROWED), "narrowed")
    cells = narrowed.select(*(F.col(c).cast("double").alias(c) for c in _NARROWED)).unpivot([], _NARROWED, "column_name", "x")
    x = F.col("x")
    return cells.groupBy("column_name").agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"), F.count_distinct(x).alias("n_distinct")
    )


@query(
    "p17_cast_to_schema",
    "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def cast_to_schema(spark, sf):
    like = spark.createDataFrame([], "o_orderkey int, o_totalprice double, o_orderdate date").schema
    return clean.like_schema(files.table(spark, sf, "orders"), like)


@query(
    "p18_day_number",
    DAILY + "SELECT id, 'd_' || dn AS d, dn AS from_label, dn AS from_date FROM daily JOIN cal USING (date)",
)
def day_number(spark, sf):
    df = retail.daily_series(spark, sf).withColumn("from_date", retail.day_number("date"))
    df = df.withColumn("d", F.concat(F.lit("d_"), F.col("from_date").cast("string")))
    return df.select("id", "d", reshape.number_of_label("d").alias("from_label"), "from_date")


@query(
    "p19_horizon_label",
    DAILY + f"SELECT id, date, 'F' || row_number() OVER (PARTITION BY id ORDER BY date) AS F FROM daily WHERE date > {_SPLIT}",
)
def horizon_label(spark, sf):
    df = retail.daily_window(spark, sf, _LAST28, retail.SPAN_END)
    return df.select("id", "date", reshape.horizon_label(F.row_number().over(_w())).alias("F"))


@query("p20_label_to_date", DAILY + f"SELECT id, date, demand FROM daily WHERE date > {_SPLIT}")
def label_to_date(spark, sf):
    wide = reshape.pivot(_last_28(spark, sf), ["id"], "F", _F_COLS, "demand")
    long = reshape.melt(wide, ["id"], _F_COLS, "F", "demand")
    return long.select("id", reshape.date_of_label("F", _LAST28).alias("date"), "demand")


@query(
    "p21_split_compound_id",
    DAILY + "SELECT DISTINCT id, split_part(id, '_', 1) AS item_id, split_part(id, '_', 2) AS store_id, split_part(id, '_', 2) || '/' || split_part(id, '_', 1) AS rebuilt FROM daily",
)
def split_compound_id(spark, sf):
    parts = F.split("id", "_")
    df = retail.daily_sold(spark, sf).select("id").distinct()
    return df.select(
        "id", parts[0].alias("item_id"), parts[1].alias("store_id"), F.concat_ws("/", parts[1], parts[0]).alias("rebuilt")
    )


@query(
    "p22_conditional_overwrite",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice > 400000 THEN 400000 ELSE o_totalprice END AS o_totalprice FROM orders",
)
def conditional_overwrite(spark, sf):
    price = F.col("o_totalprice")
    changed = F.when(F.col("o_orderstatus") == "P", 0.0).when(price > 400000, 400000.0).otherwise(price)
    return files.table(spark, sf, "orders").select("o_orderkey", changed.alias("o_totalprice"))


@query("p23_clamp_at_zero", "SELECT c_custkey, greatest(0, c_acctbal) AS pred FROM customer")
def clamp_at_zero(spark, sf):
    return files.table(spark, sf, "customer").select("c_custkey", clean.clamp_at_zero(F.col("c_acctbal")).alias("pred"))


@query(
    "p24_distinct_and_dedup",
    "SELECT l_orderkey, min(l_shipdate)::DATE AS first_ship, arg_min(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey",
)
def distinct_and_dedup(spark, sf):
    df = files.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber").distinct()
    df = df.withColumns({"_o": F.struct("l_shipdate", "l_linenumber"), "first_ship": F.col("l_shipdate").cast("date")})
    return clean.first_per_key(df, ["l_orderkey"], "_o", ["first_ship", "l_linenumber"])


@query(
    "p25_undo_log_difference",
    DAILY
    + """, l AS (SELECT id, date, ln(1 + demand) AS y, lag(ln(1 + demand)) OVER (PARTITION BY id ORDER BY date) AS y0 FROM daily)
SELECT id, date, round(exp(y0 + (y - y0)) - 1, 6) AS demand FROM l WHERE y0 IS NOT NULL""",
)
def undo_log_difference(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date", F.log1p("demand").alias("y"))
    df = df.withColumn("y0", F.lag("y").over(_w())).filter("y0 IS NOT NULL")
    back = clean.undo_log_difference(F.col("y0"), F.col("y") - F.col("y0"))
    return df.select("id", "date", (r6(back) + 0.0).alias("demand"))


@query(
    "p26_difference",
    DAILY
    + """, s AS (SELECT id, date, lag(demand) OVER w AS shifted_demand, demand - lag(demand) OVER w AS demand FROM daily WINDOW w AS (PARTITION BY id ORDER BY date))
SELECT s.* FROM s ANTI JOIN (SELECT DISTINCT date FROM s WHERE demand IS NULL) b USING (date)""",
)
def difference(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date", "demand")
    return clean.difference(df, "id", "date", "demand")


@query(
    "p27_cap_outliers",
    DAILY
    + """, m AS (SELECT id, greatest(2, avg(demand) + 4 * stddev_samp(demand)) AS new_max FROM daily GROUP BY id)
SELECT id, date, round(new_max, 6) AS new_max, CAST(demand > new_max AS INTEGER) AS was_capped, round(least(demand, new_max), 6) AS demand FROM daily JOIN m USING (id)""",
)
def cap_outliers(spark, sf):
    df = retail.daily_series(spark, sf).select("id", "date", "demand")
    out = clean.cap_outliers(df, "id", "demand")
    return out.select("id", "date", r6("new_max").alias("new_max"), "was_capped", r6("demand").alias("demand"))


@query(
    "p28_winsorise",
    WEEKLY
    + """, q AS (SELECT id, quantile_cont(demand, 0.01) AS lo, quantile_cont(demand, 0.99) AS hi FROM weekly GROUP BY id)
SELECT id, date, CAST(demand < lo OR demand > hi AS INTEGER) AS was_clipped, round(least(greatest(demand, lo), hi), 6) AS demand FROM weekly JOIN q USING (id)""",
)
def winsorise(spark, sf):
    df = retail.weekly_series(spark, sf).select("id", "date", "demand")
    out = clean.winsorise(df, "id", "demand")
    return out.select("id", "date", "was_clipped", r6("demand").alias("demand"))


@query(
    "p29_price_bins",
    """SELECT event_id, CAST(CASE WHEN value <= 0.80 THEN 6 WHEN value <= 1 THEN 5 WHEN value <= 10 THEN 4 WHEN value <= 20 THEN 2
WHEN value <= 40 THEN 3 WHEN value > 40 THEN 1 ELSE 0 END AS INTEGER) AS binned FROM events""",
)
def price_bins(spark, sf):
    return files.table(spark, sf, "events").select("event_id", price_bin(F.col("value")).alias("binned"))


@query("p30_drop_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def drop_columns(spark, sf):
    return clean.drop_columns(files.table(spark, sf, "part"), "p_name", "p_type", "p_retailprice")


@query(
    "p31_output_checks",
    DAILY
    + """SELECT 'null_cells' AS check_name, count(*) FILTER (WHERE sell_price IS NULL) AS violations
FROM daily JOIN cal USING (date) LEFT JOIN prices USING (store_id, item_id, wm_yr_wk)
UNION ALL SELECT 'key_mismatches', count(*) FROM (SELECT id FROM ids EXCEPT SELECT id FROM daily)
UNION ALL SELECT 'unsorted_rows', count(*) FROM (SELECT d < lag(d) OVER (PARTITION BY id ORDER BY date) AS off FROM daily JOIN cal USING (date)) WHERE off""",
)
def output_checks(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    daily = retail.daily_series(spark, sf, sold).withColumn("d", F.concat(F.lit("d_"), retail.day_number("date").cast("string")))
    priced = with_price_per_day(daily, retail.prices_of(sold))
    ids = sold.select("id").distinct()
    found = [
        checks.null_cells(priced, ["demand", "sell_price"]),
        checks.key_mismatches(daily.select("id").distinct(), ids, "id"),
        checks.unsorted_rows(daily, "id", "d", "date"),
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "p31_planted_checks",
    "WITH "
    + DAILY_SOLD
    + """, late AS (SELECT DISTINCT id FROM sold WHERE date > DATE '2001-10-28'),
early AS (SELECT id, count(*) AS n FROM sold WHERE date <= DATE '1995-02-05' GROUP BY id)
SELECT 'null_cells' AS check_name, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM early)) + (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM late)) AS violations
UNION ALL SELECT 'key_mismatches', (SELECT count(*) FROM (SELECT id FROM late EXCEPT SELECT id FROM early)) + (SELECT count(*) FROM (SELECT id FROM early EXCEPT SELECT id FROM late))""",
)
def planted_checks(spark, sf):
    """Tables with real gaps: series of the last week against those of the first five, and what an outer join leaves null."""
    sold = retail.staged_daily_sold(spark, sf)
    late = sold.where("date > DATE '2001-10-28'").select("id").distinct()
    early = sold.where("date <= DATE '1995-02-05'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    both = sold.select("id").distinct().join(early, "id", "left").join(late.withColumn("late", F.lit(True)), "id", "left")
    return checks.null_cells(both, ["n", "late"]).unionByName(checks.key_mismatches(late, early, "id"))


@query(
    "p32_history_splice",
    DAILY
    + f"""SELECT * FROM (SELECT id, date, round(CASE WHEN count(demand) OVER w = 30 THEN avg(demand) OVER w END, 6) AS rolling_mean_t30 FROM daily
WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE date > {_SPLIT}""",
)
def history_splice(spark, sf):
    # The splice keeps 60 days of history; a quarter is read.
    df = retail.daily_window(spark, sf, _LAST28 - timedelta(days=91), retail.SPAN_END).select("id", "date", "demand")
    df = stage(df, "splice-days")
    history, score = df.filter(F.col("date") < F.lit(_LAST28)), df.filter(F.col("date") >= F.lit(_LAST28))

    def features(rows):
        return with_count_rolling(rows, _w(), "demand", [("rolling_mean_t30", 0, 30, "mean")])

    out = clean.spliced(history, score, 60, "date", features)
    return out.select("id", "date", r6("rolling_mean_t30").alias("rolling_mean_t30"))
