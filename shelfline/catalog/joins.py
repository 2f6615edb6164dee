"""Joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfline.catalog.base import DAILY, PARTNERS, WEEKLY, query, r6
from shelfline.catalog.projections import _TEMPLATE
from shelfline.functions.rolling import along
from shelfline.operators import diagnostics, reshape
from shelfline.sources import files, retail


def _w():
    return along("id", "date")


@query(
    "j01_calendar_join",
    DAILY
    + 'SELECT id, demand, cal.* EXCLUDE (dn) FROM daily JOIN cal USING (date)',
)
def calendar_join(spark, sf):
    sold = retail.staged_daily_sold(spark, sf)
    df = retail.daily_series(spark, sf, sold).withColumn("d", F.concat(F.lit("d_"), retail.day_number("date").cast("string")))
    return df.select("id", "demand", "d").join(F.broadcast(retail.calendar(spark, sold=sold)), "d", "left")


@query(
    "j02_price_join",
    WEEKLY
    + """SELECT id, date, wk AS wm_yr_wk, demand, sell_price FROM weekly
LEFT JOIN prices ON prices.store_id = weekly.store_id AND prices.item_id = weekly.item_id AND prices.wm_yr_wk = weekly.wk""",
)
def price_join(spark, sf):
    sold = retail.staged_weekly_sold(spark, sf)
    df = retail.weekly_series(spark, sf, sold).withColumn("wm_yr_wk", retail.week_code("date"))
    out = df.join(retail.prices_of(sold), ["store_id", "item_id", "wm_yr_wk"], "left")
    return out.select("id", "date", "wm_yr_wk", "demand", "sell_price")


@query(
    "j03_inner_join",
    "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def inner_join(spark, sf):
    orders = files.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = files.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query(
    "j04_update_join",
    "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def update_join(spark, sf):
    docs = files.table(spark, sf, "documents").select("doc_id")
    return docs.join(files.table(spark, sf, "labels"), "doc_id", "left")


@query(
    "j05_products_onto_template",
    _TEMPLATE
    + "SELECT template.id, item_id, store_id, state_id FROM template LEFT JOIN ids ON ids.id = regexp_replace(template.id, '_(validation|evaluation)$', '')",
)
def products_onto_template(spark, sf):
    products = retail.daily_sold(spark, sf).select("id", "item_id", "store_id", "state_id").distinct()
    wanted = retail.template(spark, sf).select(
        F.col("id").alias("full_id"), reshape.swap_suffix("id", "_(validation|evaluation)", "").alias("id")
    )
    return wanted.join(products, "id", "left").select(F.col("full_id").alias("id"), "item_id", "store_id", "state_id")


@query(
    "j06_dictionary_lookup",
    "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def dictionary_lookup(spark, sf):
    names = files.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return files.table(spark, sf, "supplier").join(names, "s_nationkey", "left").select("s_suppkey", "n_name")


@query(
    "j07_align_to_keys",
    DAILY
    + """, best AS (SELECT id, max(date) AS last_sale FROM sold WHERE demand > 100 GROUP BY id)
SELECT ids.id, last_sale FROM ids LEFT JOIN best USING (id)""",
)
def align_to_keys(spark, sf):
    sold = retail.daily_sold(spark, sf)
    best = sold.filter("demand > 100").groupBy("id").agg(F.max("date").alias("last_sale"))
    return sold.select("id").distinct().join(best, "id", "left")


@query(
    "j08_semi_and_anti",
    """SELECT 'ordered' AS side, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
UNION ALL SELECT 'other', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""",
)
def semi_and_anti(spark, sf):
    customers = files.table(spark, sf, "customer").select("c_custkey")
    big = files.table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return (
        customers.join(big, "c_custkey", "left_semi")
        .select(F.lit("ordered").alias("side"), "c_custkey")
        .unionByName(customers.join(big, "c_custkey", "left_anti").select(F.lit("other").alias("side"), "c_custkey"))
    )


@query(
    "j09_forecast_vs_truth",
    DAILY
    + """, p AS (SELECT id, date, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS preds FROM daily)
SELECT p.id, p.date, preds, demand, abs(preds - demand) AS abs_error FROM p LEFT JOIN sold USING (id, date) WHERE p.date > DATE '2001-10-07'""",
)
def forecast_vs_truth(spark, sf):
    daily = retail.daily_series(spark, sf).select("id", "date", "demand")
    forecast = daily.select("id", "date", F.lag("demand", 28).over(_w()).alias("preds"))
    forecast = forecast.filter(F.col("date") >= F.lit(date(2001, 10, 8)))
    truth = retail.daily_sold(spark, sf).select("id", "date", "demand")
    out = forecast.join(truth, ["id", "date"], "left")
    return out.withColumn("abs_error", F.abs(F.col("preds") - F.col("demand")))


_LAGGED = """, anchor AS (SELECT min(id) AS id FROM ids),
x AS (SELECT dn, demand FROM daily JOIN cal USING (date) WHERE id = (SELECT id FROM anchor)),
y AS (SELECT id, dn, demand FROM daily JOIN cal USING (date) WHERE id <> (SELECT id FROM anchor)),
lags AS (SELECT CAST(k AS INTEGER) AS lag FROM range(-90, 91) t(k)),
pairs AS (SELECT y.id, lag, corr(x.demand, y.demand) AS r FROM x CROSS JOIN lags JOIN y ON y.dn = x.dn - lag GROUP BY ALL)
"""


@query("j10_lagged_correlation", DAILY + _LAGGED + "SELECT id, lag, round(r, 6) + 0.0 AS r FROM pairs")
def lagged_correlation(spark, sf):
    out = diagnostics.lagged_correlation(retail.daily_series(spark, sf), "id", "date", "demand", 90)
    return out.select("id", "lag", r6("r").alias("r"))


@query("j11_series_pairs", DAILY + PARTNERS + "SELECT id, partner, round(r, 6) + 0.0 AS r FROM best WHERE rank = 1")
def series_pairs(spark, sf):
    """The store whose sales of the same item follow a series most closely."""
    daily = retail.daily_series(spark, sf)
    return diagnostics.partners(daily, "item_id", "id", "date", "demand").select("id", "partner", (r6("r") + 0.0).alias("r"))
