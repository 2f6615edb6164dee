"""Metrics over the hierarchy and plain error measures."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shelfline.catalog.aggregates import FORECASTS, LONG, MEMBERS, forecasts, long_forecasts, nodes_sql
from shelfline.catalog.base import WEEKLY, query, r6
from shelfline.operators import metrics
from shelfline.operators.hierarchy import roll_up
from shelfline.plans.evaluate import weekly_score
from shelfline.sources import files, retail

_SPLIT = "DATE '2001-10-01'"

# Dense twin of the scoring job: train weeks 1..353, validation weeks 354..357.
SCORED = (
    WEEKLY
    + f""", train_nodes AS ({nodes_sql("weekly", "sum(demand) AS demand", "wk")}),
firsts AS (SELECT level, node, min(wk) AS first_wk FROM train_nodes WHERE demand <> 0 AND wk <= 353 GROUP BY ALL),
diffs AS (SELECT level, node, wk, demand - lag(demand) OVER (PARTITION BY level, node ORDER BY wk) AS diff FROM train_nodes WHERE wk <= 353),
scale AS (SELECT level, node, avg(diff * diff) FILTER (WHERE wk > first_wk) AS scale FROM firsts LEFT JOIN diffs USING (level, node) GROUP BY ALL),
valued AS (SELECT weekly.*, demand * sell_price AS value FROM weekly LEFT JOIN prices
  ON prices.store_id = weekly.store_id AND prices.item_id = weekly.item_id AND prices.wm_yr_wk = weekly.wk WHERE wk BETWEEN 350 AND 353),
value_nodes AS ({nodes_sql("valued", "sum(value) AS value")}),
weights AS (SELECT level, node, value / sum(value) OVER (PARTITION BY level) / 12 AS weight FROM value_nodes WHERE value IS NOT NULL),
err AS (SELECT t.*, t.demand - p.demand AS error FROM weekly t JOIN weekly p ON p.id = t.id AND p.wk = t.wk - 4 WHERE t.wk > 353),
err_nodes AS ({nodes_sql("err", "sum(error) AS error", "date")}),
sq AS (SELECT level, node, avg(error * error) AS mse FROM err_nodes GROUP BY ALL),
rmsse AS (SELECT level, node, scale, sqrt(mse / nullif(scale, 0)) AS rmsse FROM scale JOIN sq USING (level, node)),
parts AS (SELECT level, node, scale, rmsse, coalesce(weight, 0) AS weight, rmsse * coalesce(weight, 0) AS contribution FROM rmsse LEFT JOIN weights USING (level, node))
"""
)


@query("m01_series_scale", SCORED + "SELECT level, node, round(scale, 6) AS scale FROM scale")
def series_scale(spark, sf):
    job, _ = weekly_score(spark, sf)
    return job.scale().withColumn("scale", r6("scale"))


@query("m02_node_weights", SCORED + "SELECT level, node, round(weight, 9) AS weight, round(weight * 12, 8) AS weight_12 FROM weights")
def node_weights(spark, sf):
    job, _ = weekly_score(spark, sf)
    w = F.col("weight")
    return job.weights().select("level", "node", F.round(w / 12, 9).alias("weight"), F.round(w, 8).alias("weight_12"))


@query("m03_node_rmsse", SCORED + "SELECT level, node, round(rmsse, 6) AS rmsse FROM rmsse")
def node_rmsse(spark, sf):
    job, forecast = weekly_score(spark, sf)
    return job.rmsse(forecast).select("level", "node", r6("rmsse").alias("rmsse"))


@query("m04_wrmsse", SCORED + "SELECT round(sum(contribution), 6) AS wrmsse FROM parts")
def wrmsse(spark, sf):
    job, forecast = weekly_score(spark, sf)
    return metrics.wrmsse(job.contributors(forecast)).select(r6("wrmsse").alias("wrmsse"))


@query(
    "m04_contributors",
    SCORED + "SELECT level, node, round(rmsse, 6) AS rmsse, round(weight, 9) AS weight, round(contribution, 9) AS contribution FROM parts",
)
def contributors(spark, sf):
    job, forecast = weekly_score(spark, sf)
    return job.contributors(forecast).select(
        "level", "node", r6("rmsse").alias("rmsse"), F.round("weight", 9).alias("weight"), F.round("contribution", 9).alias("contribution")
    )


@query(
    "m05_score_matrix",
    SCORED
    + """SELECT e.level, e.node, e.date, round(error * error * weight * weight * 144 / scale, 8) AS score
FROM err_nodes e JOIN scale USING (level, node) JOIN weights USING (level, node)
WHERE error <> 0 AND scale <> 0""",
)
def score_matrix(spark, sf):
    """Only cells with an error: every other cell of the matrix is zero."""
    job, forecast = weekly_score(spark, sf)
    errors = roll_up(metrics.leaf_errors(job.truth, forecast, retail.IDS), {"error": "error"}, ["date"])
    cells = errors.filter("error <> 0").join(job.scale(), metrics.NODE).join(job.weights(), metrics.NODE)
    e, w = F.col("error"), F.col("weight")
    score = F.round(F.try_divide(e * e * w * w, F.col("scale")), 8)
    return cells.filter("scale <> 0").select("level", "node", "date", score.alias("score"))


@query(
    "m06_wrmsse_by_level",
    SCORED
    + """SELECT level, round(sum(contribution) * 12, 6) AS wrmsse FROM parts GROUP BY level
UNION ALL SELECT 'overall', round(sum(contribution), 6) FROM parts""",
)
def wrmsse_by_level(spark, sf):
    job, forecast = weekly_score(spark, sf)
    return metrics.wrmsse_by_level(job.contributors(forecast)).withColumn("wrmsse", r6("wrmsse"))


@query(
    "m06_node_history",
    SCORED
    + f""", kinds AS (
SELECT 'train' AS series_kind, * EXCLUDE (wk), DATE '1995-01-02' + CAST(7 * (wk - 1) AS INTEGER) AS date FROM train_nodes WHERE wk BETWEEN 342 AND 353
UNION ALL SELECT 'truth', * EXCLUDE (wk), DATE '1995-01-02' + CAST(7 * (wk - 1) AS INTEGER) FROM train_nodes WHERE wk > 353
UNION ALL SELECT 'forecast', * EXCLUDE (wk), DATE '1995-01-02' + CAST(7 * (wk + 3) AS INTEGER) FROM train_nodes WHERE wk BETWEEN 350 AND 353)
SELECT series_kind, level, node, CAST(date AS DATE) AS date, demand FROM kinds WHERE demand <> 0""",
)
def node_history(spark, sf):
    """Last twelve training weeks, truth and forecast of every node; empty weeks are left out."""
    job, forecast = weekly_score(spark, sf)
    recent = job.train.filter(F.col("date") > F.lit(job.split - timedelta(days=84)))
    rows = None
    for kind, df in (("train", recent), ("truth", job.truth), ("forecast", forecast)):
        part = df.select(*retail.IDS, "date", "demand", F.lit(kind).alias("series_kind"))
        rows = part if rows is None else rows.unionByName(part)
    return roll_up(rows, {"demand": "demand"}, ["series_kind", "date"]).select("series_kind", "level", "node", "date", "demand")


@query(
    "m07_leaf_sample_weight",
    SCORED
    + """, member AS ("""
    + MEMBERS
    + """)
SELECT id, round(sum(weight / sqrt(nullif(scale, 0))), 8) AS sample_weight FROM member
LEFT JOIN (SELECT level, node, weight, scale FROM weights JOIN scale USING (level, node)) USING (level, node) GROUP BY id""",
)
def leaf_sample_weight(spark, sf):
    job, _ = weekly_score(spark, sf)
    products = job.sold.select(*retail.IDS).distinct()
    out = metrics.leaf_sample_weight(products, job.weights(), job.scale())
    return out.withColumn("sample_weight", F.round("sample_weight", 8))


@query(
    "m08_loss_gradient",
    FORECASTS + "SELECT id, date, round(-2 * (1 + month(date)) * (demand - naive), 6) + 0.0 AS grad, CAST(2 * (1 + month(date)) AS DOUBLE) AS hess FROM fc",
)
def loss_gradient(spark, sf):
    weight = (1 + F.month("date")).cast("double")
    cols = metrics.loss_gradient(F.col("demand"), F.col("naive"), weight)
    return forecasts(spark, sf).select("id", "date", (r6(cols["grad"]) + 0.0).alias("grad"), cols["hess"].alias("hess"))


def _rmse_sql(key: str | None) -> str:
    head = f"{key}, " if key else ""
    tail = f" GROUP BY {key}" if key else ""
    return (
        FORECASTS
        + f"SELECT {head}round(sqrt(avg((demand - naive) * (demand - naive))), 6) AS naive_rmse, round(sqrt(avg((demand - smooth) * (demand - smooth))), 6) AS smooth_rmse FROM fc{tail}"
    )


def _rmse_by(key: str | None):
    def run(spark, sf):
        y = F.col("demand")
        return forecasts(spark, sf).groupBy(*([key] if key else [])).agg(
            r6(metrics.rmse(y, F.col("naive"))).alias("naive_rmse"), r6(metrics.rmse(y, F.col("smooth"))).alias("smooth_rmse")
        )

    return run


query("m09_rmse_overall", _rmse_sql(None))(_rmse_by(None))
query("m09_rmse_by_date", _rmse_sql("date"))(_rmse_by("date"))
query("m09_rmse_by_item", _rmse_sql("item_id"))(_rmse_by("item_id"))
query("m09_rmse_by_id", _rmse_sql("id"))(_rmse_by("id"))


@query(
    "m10_best_of_two",
    FORECASTS + "SELECT id, date, round(CASE WHEN abs(naive - demand) <= abs(smooth - demand) THEN naive ELSE smooth END, 6) AS best FROM fc",
)
def best_of_two(spark, sf):
    best = metrics.best_of_two(F.col("demand"), F.col("naive"), F.col("smooth"))
    return forecasts(spark, sf).select("id", "date", r6(best).alias("best"))


@query(
    "m11_r2",
    LONG + """SELECT "modelName", round(100 * (1 - sum((demand - pred) * (demand - pred)) / (var_pop(demand) * count(*))), 6) AS r2 FROM long GROUP BY ALL""",
)
def r2(spark, sf):
    return metrics.score(long_forecasts(spark, sf), {"r2": metrics.r2}, "demand", "pred", ["modelName"]).withColumn("r2", r6("r2"))


@query(
    "m12_cohen_kappa",
    """WITH t AS (SELECT quality AS a, toxic AS b FROM labels), n AS (SELECT count(*)::DOUBLE AS n FROM t),
pe AS (SELECT sum(x.c * y.c) / (SELECT n * n FROM n) AS pe FROM (SELECT a, count(*) AS c FROM t GROUP BY a) x JOIN (SELECT b, count(*) AS c FROM t GROUP BY b) y ON a = b),
po AS (SELECT count(*) / (SELECT n FROM n) AS po FROM t WHERE a = b)
SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM po, pe""",
)
def cohen_kappa(spark, sf):
    out = metrics.cohen_kappa(files.table(spark, sf, "labels"), "quality", "toxic")
    return out.select(r6("kappa").alias("kappa"))


@query(
    "m13_quadratic_kappa",
    """WITH t AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS a, CAST(least(5, floor(o_totalprice / 100000) + 1) AS INTEGER) AS b FROM orders),
o AS (SELECT a, b, count(*)::DOUBLE AS c FROM t GROUP BY ALL), ra AS (SELECT a, sum(c) AS c FROM o GROUP BY a), rb AS (SELECT b, sum(c) AS c FROM o GROUP BY b),
n AS (SELECT sum(c) AS n FROM o)
SELECT round(1 - (SELECT sum((a - b) ** 2 * c) FROM o) / (SELECT sum((a - b) ** 2 * ra.c * rb.c) / (SELECT n FROM n) FROM ra CROSS JOIN rb), 6) AS qwk""",
)
def quadratic_kappa(spark, sf):
    a = F.substring("o_orderpriority", 1, 1).cast("int")
    b = F.least(F.lit(5), F.floor(F.col("o_totalprice") / 100000) + 1)
    return files.table(spark, sf, "orders").agg(r6(metrics.quadratic_kappa(a, b)).alias("qwk"))


@query(
    "m14_metric_list",
    LONG
    + """SELECT "modelName", CAST(month(date) AS INTEGER) AS "foldId", round(sqrt(avg((demand - pred) * (demand - pred))), 6) AS rmse, round(avg(abs(demand - pred)), 6) AS mae,
round(100 * (1 - sum((demand - pred) * (demand - pred)) / (var_pop(demand) * count(*))), 6) AS r2 FROM long GROUP BY ALL
UNION ALL SELECT "modelName", -1, round(sqrt(avg((demand - pred) * (demand - pred))), 6), round(avg(abs(demand - pred)), 6),
round(100 * (1 - sum((demand - pred) * (demand - pred)) / (var_pop(demand) * count(*))), 6) FROM long GROUP BY "modelName" """,
)
def metric_list(spark, sf):
    """Every metric per model and fold, and over the whole data set as fold -1."""
    df = long_forecasts(spark, sf).withColumn("foldId", F.month("date"))
    chosen = {"rmse": metrics.rmse, "mae": metrics.mae, "r2": metrics.r2}
    per_fold = metrics.score(df, chosen, "demand", "pred", ["modelName", "foldId"])
    whole = metrics.score(df, chosen, "demand", "pred", ["modelName"]).withColumn("foldId", F.lit(-1))
    return per_fold.unionByName(whole).select("modelName", "foldId", *[r6(m).alias(m) for m in chosen])
