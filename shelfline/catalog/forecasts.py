"""Recursive forecasts, blends, backtest, submission, series diagnostics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shelfline.catalog.aggregates import FORECASTS, forecasts, nodes_sql
from shelfline.catalog.base import DAILY, PARTNERS, WEEKLY, query, r6
from shelfline.catalog.joins import _LAGGED
from shelfline.operators import checks, diagnostics
from shelfline.operators.reshape import horizon_label, pivot
from shelfline.plans import evaluate
from shelfline.plans.forecast import (
    ALPHAS,
    blend,
    mean_of_lags,
    mirrored_submission,
    recursive_closed_form,
    replace_horizon_column,
    submission,
)
from shelfline.sources import retail

LAGS = [7, 14, 21, 28]
SPLIT = retail.SPAN_END - timedelta(days=28)


def _recursion_sql(alphas: list[float]) -> str:
    """Recursive CTE over an array history; one row per (id, alpha, step)."""
    mean = " + ".join(f"h[len(h) - {k - 1}]" for k in LAGS)
    values = ", ".join(f"({a}::DOUBLE)" for a in alphas)
    return (
        DAILY.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", hist AS (SELECT id, list(demand ORDER BY date) AS h FROM daily WHERE date > DATE '2001-10-07' - 28 AND date <= DATE '2001-10-07' GROUP BY id),
steps AS (
  SELECT id, alpha, 0 AS step, h, NULL::DOUBLE AS pred FROM hist CROSS JOIN (VALUES {values}) a(alpha)
  UNION ALL
  SELECT id, alpha, step + 1, list_append(h, alpha * (({mean}) / 4)), alpha * (({mean}) / 4) FROM steps WHERE step < 28),
fc AS (SELECT id, alpha, CAST(DATE '2001-10-07' + step AS DATE) AS date, pred FROM steps WHERE step > 0)
"""
    )


def _recursive(spark, sf, alphas):
    daily = retail.daily_series(spark, sf).select("id", "date", "demand")
    return recursive_closed_form(daily, SPLIT, 28, 28, mean_of_lags(LAGS), alphas)


@query("g14_recursive_mean_of_lags", _recursion_sql([1.0]) + "SELECT id, date, round(pred, 6) AS pred FROM fc")
def recursive_mean_of_lags(spark, sf):
    return _recursive(spark, sf, [1.0]).select("id", "date", r6("pred").alias("pred"))


@query(
    "g15_alpha_blend",
    _recursion_sql(ALPHAS) + "SELECT id, date, round(sum(pred / 3), 6) AS pred FROM fc GROUP BY ALL",
)
def alpha_blend(spark, sf):
    out = blend(_recursive(spark, sf, ALPHAS), len(ALPHAS))
    return out.select("id", "date", r6("pred").alias("pred"))


_F_SQL = ", ".join(f"round(coalesce(max(CASE WHEN date = DATE '2001-10-07' + {n} THEN pred END), 0), 6) AS F{n}" for n in range(1, 29))
_ZERO = ", ".join("0" for _ in range(28))


@query(
    "g20_submission",
    _recursion_sql([1.0])
    + f"SELECT id || '_validation' AS id, {_F_SQL} FROM fc GROUP BY id UNION ALL SELECT id || '_evaluation', {_ZERO} FROM ids",
)
def full_submission(spark, sf):
    template = retail.template(spark, sf)
    out = submission(_recursive(spark, sf, [1.0]), template, SPLIT + timedelta(days=1), 28)
    return out.select("id", *[r6(f"F{n}").alias(f"F{n}") for n in range(1, 29)])


@query(
    "g20_mirrored_submission",
    _recursion_sql([1.0])
    + f"""SELECT id || '_validation' AS id, {_F_SQL} FROM fc GROUP BY id
UNION ALL SELECT id || '_evaluation' AS id, {_F_SQL} FROM fc GROUP BY id""",
)
def both_halves(spark, sf):
    out = mirrored_submission(_recursive(spark, sf, [1.0]), SPLIT + timedelta(days=1), 28)
    return out.select("id", *[r6(f"F{n}").alias(f"F{n}") for n in range(1, 29)])


@query(
    "g20_replace_column",
    DAILY
    + ", old AS (SELECT id, "
    + ", ".join(f"max(CASE WHEN date = DATE '2001-10-07' + {n} THEN demand END) AS F{n}" for n in range(1, 29))
    + """ FROM daily WHERE date > DATE '2001-10-07' GROUP BY id)
SELECT old.* REPLACE (coalesce(sold.demand, 0) AS F1) FROM old LEFT JOIN sold ON sold.id = old.id AND sold.date = DATE '2001-10-07'""",
)
def replace_column(spark, sf):
    daily = retail.daily_window(spark, sf, SPLIT + timedelta(days=1), retail.SPAN_END)
    late = daily.select("id", "date", F.col("demand").alias("pred"))
    labelled = late.withColumn("F", horizon_label(F.datediff("date", F.lit(SPLIT))))
    old = pivot(labelled, ["id"], "F", [f"F{n}" for n in range(1, 29)], "pred")
    sold = retail.daily_sold(spark, sf).filter(F.col("date") == F.lit(SPLIT))
    return replace_horizon_column(old, sold.select("id", F.col("demand").alias("F1")), "F1")


@query(
    "g20_submission_checks",
    DAILY + "SELECT 'null_cells' AS check_name, count(*) FILTER (WHERE id IS NULL) AS violations FROM ids UNION ALL SELECT 'key_mismatches', count(*) FILTER (WHERE id IS NULL) FROM ids",
)
def submission_checks(spark, sf):
    template = retail.template(spark, sf)
    out = submission(_recursive(spark, sf, [1.0]), template, SPLIT + timedelta(days=1), 28)
    nulls = checks.null_cells(out, [f"F{n}" for n in range(1, 29)])
    return nulls.unionByName(checks.key_mismatches(out, template, "id"))


@query(
    "g20_planted_checks",
    DAILY
    + """SELECT 'null_cells' AS check_name, 28 * count(*) FILTER (WHERE store_id = 'EUROPE') AS violations FROM ids
UNION ALL SELECT 'key_mismatches', 2 * count(*) FILTER (WHERE store_id = 'ASIA') + 1 FROM ids""",
)
def planted_submission_checks(spark, sf):
    """A submission without one store, with empty cells for another and with a surplus id."""
    template = retail.template(spark, sf)
    labels = [f"F{n}" for n in range(1, 29)]
    whole = submission(_recursive(spark, sf, [1.0]), template, SPLIT + timedelta(days=1), 28)
    surplus = whole.limit(1).withColumn("id", F.lit("surplus_validation"))
    some = whole.where("id NOT LIKE '%_ASIA_%'").unionByName(surplus.na.fill(0.0, labels))
    empty = F.col("id").like("%_EUROPE_validation")
    broken = some.withColumns({c: F.when(~empty, F.col(c)) for c in labels})
    return checks.null_cells(broken, labels).unionByName(checks.key_mismatches(broken, template, "id"))


_BT_FOLDS, _BT_TRAIN, _BT_TEST, _BT_LAST, _BT_LINE = 10, 104, 4, 357, 26


def _backtest_sql() -> str:
    """Dense twin of the backtest: per fold and process the error by date and the score."""
    ctes, outs = [], []
    for f in range(_BT_FOLDS):
        split = _BT_LAST - (_BT_FOLDS - f) * _BT_TEST
        low = split - _BT_TRAIN
        ctes += [
            # Series that sold nothing inside the fold have no error, but count in the mean.
            f"all{f} AS (SELECT count(DISTINCT id) AS n FROM weekly WHERE demand > 0 AND wk <= {split + _BT_TEST})",
            f"live{f} AS (SELECT DISTINCT id FROM weekly WHERE demand > 0 AND wk > {low} AND wk <= {split + _BT_TEST})",
            f"w{f} AS (SELECT weekly.* FROM weekly JOIN live{f} USING (id) WHERE wk > {low} AND wk <= {split + _BT_TEST})",
            f"tn{f} AS ({nodes_sql(f'w{f}', 'sum(demand) AS demand', 'wk')})",
            f"first{f} AS (SELECT level, node, min(wk) AS first_wk FROM tn{f} WHERE demand <> 0 AND wk <= {split} GROUP BY ALL)",
            f"diff{f} AS (SELECT level, node, wk, demand - lag(demand) OVER (PARTITION BY level, node ORDER BY wk) AS diff FROM tn{f} WHERE wk <= {split})",
            f"scale{f} AS (SELECT level, node, avg(diff * diff) FILTER (WHERE wk > first_wk) AS scale FROM first{f} JOIN diff{f} USING (level, node) GROUP BY ALL)",
            f"val{f} AS (SELECT w.*, demand * sell_price AS value FROM w{f} w LEFT JOIN prices ON prices.store_id = w.store_id AND prices.item_id = w.item_id AND prices.wm_yr_wk = w.wk WHERE wk > {split - _BT_TEST} AND wk <= {split})",
            f"vn{f} AS ({nodes_sql(f'val{f}', 'sum(value) AS value')})",
            f"wt{f} AS (SELECT level, node, value / sum(value) OVER (PARTITION BY level) / 12 AS weight FROM vn{f} WHERE value IS NOT NULL)",
            f"pn{f}_naive AS (SELECT t.*, t.demand - p.demand AS error FROM w{f} t JOIN w{f} p ON p.id = t.id AND p.wk = t.wk - {_BT_TEST} WHERE t.wk > {split})",
            f"pn{f}_mean AS (SELECT t.*, t.demand - p.m AS error FROM w{f} t JOIN (SELECT id, sum(demand) / {_BT_TEST} AS m FROM w{f} WHERE wk > {split - _BT_TEST} AND wk <= {split} GROUP BY id) p USING (id) WHERE t.wk > {split})",
            f"pn{f}_log_line AS (SELECT t.*, t.demand - (exp(greatest(a + b * t.wk, 0)) - 1) AS error FROM w{f} t JOIN (SELECT id, regr_slope(ln(1 + demand), wk) AS b, regr_intercept(ln(1 + demand), wk) AS a FROM w{f} WHERE wk > {split - _BT_LINE} AND wk <= {split} GROUP BY id) p USING (id) WHERE t.wk > {split})",
        ]
        for process in ("naive", "mean", "log_line"):
            ctes += [
                f"en{f}_{process} AS ({nodes_sql(f'pn{f}_{process}', 'sum(error) AS error', 'wk')})",
                f"sc{f}_{process} AS (SELECT sum(sqrt(mse / scale) * coalesce(weight, 0)) AS s FROM (SELECT level, node, avg(error * error) AS mse FROM en{f}_{process} GROUP BY ALL) JOIN scale{f} USING (level, node) LEFT JOIN wt{f} USING (level, node) WHERE scale <> 0)",
            ]
            outs.append(
                f"SELECT '{process}' AS process_name, {f} AS fold_idx, date, round(sqrt(sum(error * error) / (SELECT n FROM all{f})), 6) AS preds_rmse, (SELECT round(s, 6) FROM sc{f}_{process}) AS wrmsse FROM pn{f}_{process} GROUP BY date"
            )
    return WEEKLY + ", " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(outs)


@query("g17_backtest", _backtest_sql())
def backtest(spark, sf):
    sold = retail.weekly_sold(spark, sf)
    processes = [
        evaluate.Process("naive", evaluate.naive_forecast),
        evaluate.Process("mean", evaluate.recent_mean),
        evaluate.Process("log_line", evaluate.log_line(_BT_LINE), F.expm1),
    ]
    out = evaluate.backtest(
        sold.drop("cents"), retail.prices_of(sold), processes, retail.LAST_WEEK, _BT_FOLDS, _BT_TRAIN, _BT_TEST
    )
    return out.select("process_name", "fold_idx", "date", r6("preds_rmse").alias("preds_rmse"), r6("wrmsse").alias("wrmsse"))


# Series diagnostics


def _acf_sql(lags: int) -> str:
    moved = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, lags + 1))
    sums = ", ".join(f"sum(c * c{k})" for k in range(1, lags + 1))
    return (
        DAILY
        + f""", c AS (SELECT id, date, demand - avg(demand) OVER (PARTITION BY id) AS c FROM daily),
m AS (SELECT id, c, {moved} FROM c WINDOW w AS (PARTITION BY id ORDER BY date)),
p AS (SELECT id, unnest(range(1, {lags + 1})) AS lag, unnest([{sums}]) AS s FROM m GROUP BY id),
v AS (SELECT id, sum(c * c) AS v FROM c GROUP BY id),
acf AS (SELECT id, CAST(lag AS INTEGER) AS lag, s / nullif(v, 0) AS acf FROM p JOIN v USING (id))
"""
    )


@query("d01_autocorrelation", _acf_sql(40) + "SELECT id, lag, round(acf, 6) + 0.0 AS acf FROM acf")
def autocorrelation(spark, sf):
    df = diagnostics.autocorrelation(retail.daily_series(spark, sf), "id", "date", "demand", 40)
    return df.select("id", "lag", r6("acf").alias("acf"))


@query(
    "d01_best_lag_histogram",
    _acf_sql(40)
    + """, b AS (SELECT id, lag, row_number() OVER (PARTITION BY id ORDER BY acf DESC, lag) AS r FROM acf)
SELECT lag AS argmax_autocorr, count(*) AS n FROM b WHERE r = 1 GROUP BY lag""",
)
def best_lag_histogram(spark, sf):
    acf = diagnostics.autocorrelation(retail.daily_series(spark, sf), "id", "date", "demand", 40)
    best = diagnostics.best_autocorrelation(acf, "id")
    return best.groupBy("argmax_autocorr").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d02_partial_autocorrelation",
    "WITH RECURSIVE "
    + _acf_sql(20).removeprefix("WITH ")
    + """, rho AS (SELECT id, list(acf ORDER BY lag) AS rho FROM acf GROUP BY id),
pac(id, k, phi, pacf) AS (
  SELECT id, 1, [rho[1]], rho[1] FROM rho
  UNION ALL
  SELECT id, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - step * phi[k + 1 - j]), step), step
  FROM (SELECT pac.id, k, phi, (rho[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[k + 1 - j])))
               / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * rho[j]))) AS step
        FROM pac JOIN rho ON rho.id = pac.id WHERE k < 20)
)
SELECT id, k AS lag, round(pacf, 6) + 0.0 AS pacf FROM pac""",
)
def partial_autocorrelation(spark, sf):
    acf = diagnostics.autocorrelation(retail.daily_series(spark, sf), "id", "date", "demand", 20)
    return diagnostics.partial_autocorrelation(acf, "id").withColumn("pacf", r6("pacf") + 0.0)


@query(
    "d03_best_cross_lag",
    DAILY
    + _LAGGED
    + """, b AS (SELECT id, lag, r, row_number() OVER (PARTITION BY id ORDER BY r DESC, lag) AS top, row_number() OVER (PARTITION BY id ORDER BY r, lag) AS low FROM pairs)
SELECT id, round(max(r), 6) + 0.0 AS max_cross_corr, round(min(r), 6) + 0.0 AS min_cross_corr, max(lag) FILTER (WHERE top = 1) AS offset_max, max(lag) FILTER (WHERE low = 1) AS offset_min FROM b GROUP BY id""",
)
def best_cross_lag(spark, sf):
    pairs = diagnostics.lagged_correlation(retail.daily_series(spark, sf), "id", "date", "demand", 90)
    out = diagnostics.best_lags(pairs, "id")
    return out.withColumns({c: r6(c) for c in ("max_cross_corr", "min_cross_corr")})


@query(
    "d04_decomposition",
    DAILY
    + """, t AS (SELECT id, date, demand, CASE WHEN count(demand) OVER w = 7 THEN avg(demand) OVER w END AS trend FROM daily
WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT *, avg(demand - trend) OVER (PARTITION BY id, isodow(date)) AS seasonality FROM t)
SELECT id, date, round(trend, 6) AS trend, round(seasonality, 6) AS seasonality, round(demand - trend - seasonality, 6) + 0.0 AS residual FROM s""",
)
def decomposition(spark, sf):
    df = diagnostics.decompose(retail.daily_series(spark, sf).select("id", "date", "demand"), "id", "date", "demand")
    return df.select(
        "id", "date", r6("trend").alias("trend"), r6("seasonality").alias("seasonality"), (r6("residual") + 0.0).alias("residual")
    )


@query(
    "d05_strong_pairs",
    DAILY + PARTNERS + "SELECT id, count(*) AS n_partners, count(*) FILTER (WHERE strong) AS n_strong FROM best GROUP BY id",
)
def strong_pairs(spark, sf):
    """Per series the stores of the same item, and how many of them it follows closely."""
    found = diagnostics.partners(retail.daily_series(spark, sf), "item_id", "id", "date", "demand", 0.8)
    return found.select("id", "n_partners", "n_strong")


@query(
    "d06_item_mean_series",
    FORECASTS + "SELECT item_id, date, round(avg(demand), 6) AS demand, round(avg(naive), 6) AS naive, round(avg(smooth), 6) AS smooth FROM fc GROUP BY ALL",
)
def item_mean_series(spark, sf):
    return forecasts(spark, sf).groupBy("item_id", "date").agg(
        *[r6(F.avg(c)).alias(c) for c in ("demand", "naive", "smooth")]
    )
