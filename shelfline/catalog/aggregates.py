"""Aggregations, ordering, set operations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfline.catalog.base import DAILY, PARTNERS, WEEKLY, query, r6
from shelfline.functions.rolling import along
from shelfline.operators import diagnostics, metrics
from shelfline.operators.hierarchy import LEVELS, level_name, membership, roll_up
from shelfline.operators.quantiles import group_quantiles
from shelfline.operators.running import positions, running_total_by
from shelfline.operators.runs import zero_runs
from shelfline.plans.evaluate import SPLIT
from shelfline.sources import files, retail


def _w():
    return along("id", "date")


def _label_sql(keys: tuple[str, ...]) -> str:
    return " || '--' || ".join(keys) if keys else "'all'"


def nodes_sql(source: str, measures: str, by: str = "") -> str:
    """UNION of the twelve levels over a CTE that carries the id columns."""
    by = f", {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT '{level_name(k)}' AS level, {_label_sql(k)} AS node{by}, {measures} FROM {source} GROUP BY ALL" for k in LEVELS
    )


@query("a01_group_min", WEEKLY + "SELECT store_id, item_id, min(wm_yr_wk) AS release FROM prices GROUP BY ALL")
def group_min(spark, sf):
    return retail.weekly_prices(spark, sf).groupBy("store_id", "item_id").agg(F.min("wm_yr_wk").alias("release"))


@query(
    "a02_group_stats",
    DAILY
    + """SELECT id, round(avg(demand), 6) AS mean, round(stddev_samp(demand), 6) AS std, max(demand) AS max,
sum(demand) AS sum, count(demand) AS n FROM daily GROUP BY id""",
)
def group_stats(spark, sf):
    x = "demand"
    return retail.daily_series(spark, sf).groupBy("id").agg(
        r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.count(x).alias("n")
    )


@query(
    "a03_distinct_count",
    WEEKLY + "SELECT store_id, count(DISTINCT sell_price) AS prices, count(DISTINCT item_id) AS items FROM prices GROUP BY store_id",
)
def distinct_count(spark, sf):
    df = retail.weekly_prices(spark, sf)
    return df.groupBy("store_id").agg(F.countDistinct("sell_price").alias("prices"), F.countDistinct("item_id").alias("items"))


@query("a04_hierarchy_roll_up", WEEKLY + nodes_sql("sold", "sum(demand) AS demand", "date"))
def hierarchy_roll_up(spark, sf):
    return roll_up(retail.weekly_sold(spark, sf), {"demand": "demand"}, ["date"])


MEMBERS = " UNION ALL ".join(f"SELECT '{level_name(k)}' AS level, {_label_sql(k)} AS node, id FROM ids" for k in LEVELS)


@query("a05_membership", WEEKLY + MEMBERS)
def hierarchy_membership(spark, sf):
    products = retail.weekly_sold(spark, sf).select(*retail.IDS).distinct()
    return membership(products)


@query("a06_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return files.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a07_cumulative_share",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, n, CAST(sum(n) OVER (ORDER BY n DESC, source) AS BIGINT) AS cumsum,
round(sum(n) OVER (ORDER BY n DESC, source) / (SELECT sum(n) FROM c)::DOUBLE, 6) AS share FROM c""",
)
def cumulative_share(spark, sf):
    counts = files.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    out = running_total_by(counts, [], [F.desc("n"), F.asc("source")], "n", "cumsum")
    share = F.col("cumsum") / counts.agg(F.sum("n")).scalar()
    return out.select("source", "n", "cumsum", r6(share).alias("share"))


# Two simple forecasts per day: four weeks ago, and the mean of the four weeks before that day's week.
FORECASTS = DAILY + """, f AS (
  SELECT id, item_id, date, demand, lag(demand, 28) OVER w AS naive,
         avg(demand) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING) AS smooth
  FROM daily WINDOW w AS (PARTITION BY id ORDER BY date)),
fc AS (SELECT * FROM f WHERE date >= DATE '2001-01-01')
"""


def forecasts(spark, sf):
    """Truth with two forecasts for the last months: 28 days ago, and a 28-day mean before that."""
    frame = _w().rowsBetween(-55, -28)
    df = retail.daily_series(spark, sf).select(
        "id",
        "item_id",
        "date",
        "demand",
        F.lag("demand", 28).over(_w()).alias("naive"),
        F.avg("demand").over(frame).alias("smooth"),
    )
    return df.filter(F.col("date") >= F.lit("2001-01-01").cast("date"))


LONG = FORECASTS + """, long AS (SELECT id, date, demand, 'naive' AS "modelName", naive AS pred FROM fc
UNION ALL SELECT id, date, demand, 'smooth', smooth FROM fc)
"""


def long_forecasts(spark, sf):
    return forecasts(spark, sf).unpivot(["id", "item_id", "date", "demand"], ["naive", "smooth"], "modelName", "pred")


@query(
    "a08_metric_mean_std",
    LONG
    + """, m AS (SELECT "modelName", date_trunc('month', date) AS fold, sqrt(avg((demand - pred) * (demand - pred))) AS rmse FROM long GROUP BY ALL)
SELECT "modelName", round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std FROM m GROUP BY ALL""",
)
def metric_mean_std(spark, sf):
    df = long_forecasts(spark, sf).withColumn("fold", F.trunc("date", "month"))
    per_fold = metrics.score(df, {"rmse": metrics.rmse}, "demand", "pred", ["modelName", "fold"])
    return per_fold.groupBy("modelName").agg(r6(F.avg("rmse")).alias("rmse_mean"), r6(F.stddev_samp("rmse")).alias("rmse_std"))


@query(
    "a09_group_quantile",
    "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1",
)
def group_quantile(spark, sf):
    events = files.table(spark, sf, "events").select("event_type", "value")
    found = group_quantiles(events, "event_type", "value", {"q01": 0.01, "q99": 0.99})
    return found.select("event_type", r6("q01").alias("q01"), r6("q99").alias("q99"))


@query(
    "a10_argmax_argmin",
    DAILY
    + """, r AS (SELECT id, date, demand, row_number() OVER (PARTITION BY id ORDER BY demand DESC, date) AS top,
row_number() OVER (PARTITION BY id ORDER BY demand, date) AS low FROM daily)
SELECT id, max(date) FILTER (WHERE top = 1) AS best_day, max(date) FILTER (WHERE low = 1) AS worst_day FROM r GROUP BY id""",
)
def argmax_argmin(spark, sf):
    back = F.datediff(F.lit("2100-01-01").cast("date"), "date")
    return retail.daily_series(spark, sf).groupBy("id").agg(
        F.max_by("date", F.struct("demand", back)).alias("best_day"),
        F.min_by("date", F.struct("demand", "date")).alias("worst_day"),
    )


@query(
    "a11_strong_pair_count",
    DAILY + PARTNERS + "SELECT count(*) // 2 AS pairs, count(*) FILTER (WHERE strong) // 2 AS strong_pairs FROM best",
)
def strong_pair_count(spark, sf):
    """Pairs of stores of one item, and those whose absolute correlation exceeds 0.8."""
    found = diagnostics.partners(retail.daily_series(spark, sf), "item_id", "id", "date", "demand", 0.8)
    halves = {"pairs": "n_partners", "strong_pairs": "n_strong"}
    return found.agg(*[(F.sum(c) / 2).cast("bigint").alias(n) for n, c in halves.items()])


_RUNS = """, z AS (SELECT id, date, demand = 0 AS zero, row_number() OVER (PARTITION BY id ORDER BY date)
  - row_number() OVER (PARTITION BY id, demand = 0 ORDER BY date) AS island FROM {src}),
runs AS (SELECT id, island, count(*) AS n, max(date) AS last FROM z WHERE zero GROUP BY ALL),
ends AS (SELECT id, max(date) AS last FROM {src} GROUP BY id)
SELECT ends.id, CAST(coalesce(max(n), 0) AS INTEGER) AS max_consecutive_zeros,
CAST(coalesce(max(n), 0) = coalesce(max(n) FILTER (WHERE runs.last = ends.last), 0) AS INTEGER) AS max_consecutive_zeros_at_end
FROM ends LEFT JOIN runs USING (id) GROUP BY ends.id"""


@query("a12_zero_runs", WEEKLY + _RUNS.format(src="weekly"))
def longest_zero_runs(spark, sf):
    return zero_runs(retail.weekly_series(spark, sf).select("id", "date", "demand"), "id", "date", "demand")


@query("a12_zero_runs_daily", DAILY + _RUNS.format(src="daily"))
def longest_zero_runs_daily(spark, sf):
    return zero_runs(retail.daily_series(spark, sf).select("id", "date", "demand"), "id", "date", "demand")


@query("a13_daily_total", FORECASTS + "SELECT date, round(sum(smooth), 4) AS total FROM fc GROUP BY date")
def daily_total(spark, sf):
    return forecasts(spark, sf).groupBy("date").agg(F.round(F.sum("smooth"), 4).alias("total"))


@query(
    "a14_recent_value",
    WEEKLY
    + """SELECT id, round(sum(demand * sell_price), 4) AS value FROM sold JOIN prices
ON prices.store_id = sold.store_id AND prices.item_id = sold.item_id AND prices.wm_yr_wk = date_diff('day', DATE '1995-01-02', date) // 7 + 1
WHERE date > DATE '2001-09-03' AND date <= DATE '2001-10-01' GROUP BY id""",
)
def recent_value(spark, sf):
    sold = retail.staged_weekly_sold(spark, sf)
    weekly = sold.withColumn("wm_yr_wk", retail.week_code("date"))
    valued = metrics.leaf_value(weekly, retail.prices_of(sold), SPLIT, 28)
    return valued.groupBy("id").agg(F.round(F.sum("value"), 4).alias("value"))


@query(
    "a15_count_outside",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
SELECT event_type, count(*) FILTER (WHERE value < lo OR value > hi) AS outside FROM events JOIN q USING (event_type) GROUP BY 1""",
)
def count_outside(spark, sf):
    events = files.table(spark, sf, "events").select("event_type", "value")
    bounds = group_quantiles(events, "event_type", "value", {"lo": 0.01, "hi": 0.99})
    df = events.join(bounds, "event_type")
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return df.groupBy("event_type").agg(F.count_if(outside).alias("outside"))


# Ordering


@query(
    "o01_sorted_series",
    DAILY + "SELECT id, date, CAST(row_number() OVER (ORDER BY id, date) - 1 AS BIGINT) AS position FROM daily",
)
def sorted_series(spark, sf):
    return positions(retail.daily_series(spark, sf).select("id", "date"), ["id", "date"], "position")


@query(
    "o02_sort_by_metric",
    LONG
    + 'SELECT "modelName", id, round(sqrt(avg((demand - pred) * (demand - pred))), 6) AS rmse FROM long GROUP BY ALL ORDER BY rmse DESC, "modelName", id',
)
def sort_by_metric(spark, sf):
    scored = metrics.score(long_forecasts(spark, sf), {"rmse": metrics.rmse}, "demand", "pred", ["modelName", "id"])
    return scored.withColumn("rmse", r6("rmse")).orderBy(F.desc("rmse"), "modelName", "id")


@query(
    "o03_top_levels",
    "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 8",
)
def top_levels(spark, sf):
    counts = files.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "source").limit(8)


@query("o04_last_days", DAILY + "SELECT id, date, demand FROM daily WHERE date > (SELECT max(date) FROM daily) - 84")
def last_days(spark, sf):
    return retail.daily_window(spark, sf, retail.SPAN_END - timedelta(days=83), retail.SPAN_END).select("id", "date", "demand")


@query(
    "o05_cv_order",
    LONG
    + """SELECT "modelName", CAST(month(date) AS INTEGER) AS "foldId", round(avg(abs(demand - pred)), 6) AS mae FROM long GROUP BY ALL ORDER BY 1, 2""",
)
def cv_order(spark, sf):
    df = long_forecasts(spark, sf).withColumn("foldId", F.month("date"))
    scored = metrics.score(df, {"mae": metrics.mae}, "demand", "pred", ["modelName", "foldId"])
    return scored.withColumn("mae", r6("mae")).orderBy("modelName", "foldId")


# Set operations


@query(
    "u01_row_union",
    DAILY
    + """SELECT id || '_validation' AS id, date, demand FROM daily WHERE date > DATE '2001-10-07'
UNION ALL SELECT id || '_evaluation', date, demand FROM daily WHERE date > DATE '2001-10-07'""",
)
def row_union(spark, sf):
    df = retail.daily_window(spark, sf, date(2001, 10, 8), retail.SPAN_END)

    def half(suffix):
        return df.select(F.concat("id", F.lit(suffix)).alias("id"), "date", "demand")

    return half("_validation").unionByName(half("_evaluation"))


@query(
    "u02_union_of_segments",
    DAILY + "SELECT store_id, cat_id, date, sum(demand) AS demand FROM daily GROUP BY ALL",
)
def union_of_segments(spark, sf):
    """Per-segment results as one keyed aggregation instead of a loop over segments."""
    return retail.daily_series(spark, sf).groupBy("store_id", "cat_id", "date").agg(F.sum("demand").alias("demand"))


@query(
    "u03_sum_of_forecasts",
    LONG + "SELECT id, date, round(sum(pred * 0.5), 6) AS pred FROM long GROUP BY ALL",
)
def sum_of_forecasts(spark, sf):
    df = long_forecasts(spark, sf)
    return df.groupBy("id", "date").agg(r6(F.sum(F.col("pred") * 0.5)).alias("pred"))


@query(
    "u04_set_difference",
    "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000",
)
def set_difference(spark, sf):
    orders = files.table(spark, sf, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 250000").select("o_custkey")
    return orders.select("o_custkey").distinct().join(urgent, "o_custkey", "left_anti")
