"""Model jobs. Trees and linear models are not expressible in SQL: a query returns what is known
of a job's outcome (which rows are predicted, sums that must agree), the predictions themselves
come from the functions of ``plans.model``."""

from __future__ import annotations

from datetime import date, timedelta
from functools import partial, reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.catalog.base import DAILY, query, r6
from shelfline.functions.rolling import along, with_count_rolling
from shelfline.lineage import fresh_path, stage
from shelfline.operators import folds, metrics
from shelfline.operators.reshape import add_horizon
from shelfline.operators.running import positions
from shelfline.plans import boosting, grouped, model as ml, validation
from shelfline.plans.evaluate import HierarchyScore
from shelfline.plans.forecast import recursive_with_arrays
from shelfline.plans.scoring import as_arrays
from shelfline.plans.steps import Step, StepPipeline
from shelfline.sources import files, retail

COLUMNS = ["lag_28", "lag_35", "mean_28_7", "mean_28_28", "std_28_28", "dow", "month"]
SPLIT = retail.SPAN_END - timedelta(days=28)


def direct_features(df: DataFrame) -> DataFrame:
    """Features that look back 28 days or more, so a whole horizon can be scored at once."""
    w = along("id", "date")
    out = with_count_rolling(
        df, w, "demand", [("mean_28_7", 28, 7, "mean"), ("mean_28_28", 28, 28, "mean"), ("std_28_28", 28, 28, "std")]
    )
    out = out.withColumns({f"lag_{k}": F.lag("demand", k).over(w) for k in (28, 35)})
    out = out.withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    return ml.filled(out, COLUMNS)


def _table(spark, sf) -> DataFrame:
    daily = retail.daily_series(spark, sf).select("id", "store_id", "date", "demand")
    return stage(direct_features(daily), "model-features")


_LATE = DAILY + " SELECT id, date, demand, true AS predicted FROM daily WHERE date > DATE '2001-10-07'"


def _usable(prediction: str) -> Column:
    """Whether a prediction is there, finite and not negative; what a model job can be held to in SQL."""
    p = F.col(prediction)
    return (p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < float("inf"))).alias("predicted")


def _train_test(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = _table(spark, sf)
    return df.filter(F.col("date") <= F.lit(SPLIT)), df.filter(F.col("date") > F.lit(SPLIT))


def _poisson():
    return ml.count_regression(COLUMNS, "demand", "poisson", reg=0.01)


@query("g08_predictions")
def tree_predictions(spark, sf):
    """Weighted boosting with early stopping on the last 28 training days."""
    train, test = _train_test(spark, sf)
    train = train.withColumns(
        {
            "is_validation": F.col("date") > F.lit(SPLIT - timedelta(days=28)),
            "w": 1.0 + F.year("date") - F.lit(1995),
        }
    )
    fitted = ml.boosted_trees(COLUMNS, "demand", "w", "is_validation", ["dow", "month"], maxIter=10, maxDepth=4).fit(train)
    return fitted.transform(test).select("id", "date", "demand", "prediction")


@query("g08_boosted_trees", _LATE)
def boosted_trees(spark, sf):
    return tree_predictions(spark, sf).select("id", "date", "demand", _usable("prediction"))


@query(
    "g08_importances",
    f"SELECT unnest({COLUMNS}) AS feature, true AS is_share, true AS add_up",
)
def tree_importances(spark, sf):
    found = importance_shares(spark, sf)
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", F.col("importance").between(0, 1).alias("is_share"), F.lit(abs(total - 1) < 1e-9).alias("add_up"))


@query("g08_importance_shares")
def importance_shares(spark, sf):
    """The share of every feature in the gain of the trees."""
    train, _ = _train_test(spark, sf)
    fitted = ml.boosted_trees(COLUMNS, "demand", categories=["dow", "month"], maxIter=5, maxDepth=4).fit(train)
    return ml.importances(fitted, COLUMNS, train)


@query("g09_tweedie_predictions")
def tweedie_predictions(spark, sf):
    train, test = _train_test(spark, sf)
    fitted = ml.count_regression(COLUMNS, "demand", "tweedie", 1.1).fit(train)
    return fitted.transform(test).select("id", "date", "demand", "prediction")


@query("g09_tweedie_regression", _LATE)
def tweedie_regression(spark, sf):
    return tweedie_predictions(spark, sf).select("id", "date", "demand", _usable("prediction"))


@query("g09_poisson_regression", DAILY + " SELECT sum(demand) AS demand, true AS adds_up FROM daily WHERE date <= DATE '2001-10-07'")
def poisson_regression(spark, sf):
    """With a log link and an intercept, the fitted means add up to the training total."""
    train, _ = _train_test(spark, sf)
    fitted = ml.count_regression(COLUMNS, "demand", "poisson").fit(train)
    sums = fitted.transform(train).agg(F.sum("demand").alias("demand"), F.sum("prediction").alias("p"))
    return sums.select("demand", (F.abs(F.col("p") / F.col("demand") - 1) < 1e-6).alias("adds_up"))


def _weighted(spark, sf) -> DataFrame:
    """Feature rows of the daily series with the sample weight of their leaf in the hierarchy's score."""
    sold = retail.staged_daily_sold(spark, sf)
    job = HierarchyScore(sold, retail.prices_of(sold), SPLIT, 28, 1)
    weights = metrics.leaf_sample_weight(sold.select(*retail.IDS).distinct(), job.weights(), job.scale())
    daily = retail.daily_series(spark, sf, sold).select("id", "store_id", "date", "demand")
    rows = direct_features(daily.where(F.col("date") > F.lit(SPLIT - timedelta(days=364 + 56))))
    rows = rows.where(F.col("date") > F.lit(SPLIT - timedelta(days=364)))
    return stage(rows.join(weights, "id"), "weighted-features")


def _tweedie_trees(rows: DataFrame) -> boosting.Boosted:
    train = rows.where(F.col("date") <= F.lit(SPLIT)).withColumn("late", F.col("date") > F.lit(SPLIT - timedelta(days=28)))
    return boosting.boost(train, COLUMNS, "demand", boosting.tweedie(1.1), "sample_weight", "late", rounds=12, step=0.2, depth=4)


@query("g09_tweedie_trees")
def tweedie_trees(spark, sf):
    """Trees boosted for the weighted Tweedie loss; every leaf counts by its weight in the hierarchy's score."""
    rows = _weighted(spark, sf)
    return _tweedie_trees(rows).transform(rows.where(F.col("date") > F.lit(SPLIT))).select("id", "date", "demand", "sample_weight", "prediction")


@query("g09_tweedie_curve", "SELECT true AS starts_at_0, true AS train_loss_falls, true AS best_is_kept")
def tweedie_curve(spark, sf):
    """The training loss falls with every round, and the rounds that stay end at the least validation loss."""
    fitted = _tweedie_trees(_weighted(spark, sf))
    train, valid = [c[1] for c in fitted.curve], [c[2] for c in fitted.curve]
    falls = all(b < a for a, b in zip(train, train[1:]))
    found = (fitted.curve[0][0] == 0, falls, valid[len(fitted.trees)] == min(valid))
    return spark.createDataFrame([found], "starts_at_0 boolean, train_loss_falls boolean, best_is_kept boolean")


@query(
    "g09_boosting_round",
    DAILY
    + """, t AS (SELECT CAST(isodow(date) >= 6 AS DOUBLE) AS weekend, demand AS y, 1.0 + year(date) - 1995 AS w FROM daily WHERE date <= DATE '2001-10-07'),
f AS (SELECT ln(sum(w * y) / sum(w)) AS f FROM t),
s AS (SELECT weekend, count(*) AS n, sum(w * (exp(0.9 * f) - y * exp(-0.1 * f))) AS g, sum(w * (0.9 * exp(0.9 * f) + 0.1 * y * exp(-0.1 * f))) AS h FROM t, f GROUP BY weekend)
SELECT weekend, n, round(g, 4) AS grad, round(h, 4) AS hess, round(-g / h, 8) AS leaf_value, round(exp(f - g / h), 8) AS prediction FROM s, f""",
)
def boosting_round(spark, sf):
    """One weighted Tweedie round on a single split: its leaf sums, leaf values and means."""
    daily = retail.daily_series(spark, sf).where(F.col("date") <= F.lit(SPLIT))
    rows = daily.select((F.weekday("date") >= 5).cast("double").alias("weekend"), "demand", (1.0 + F.year("date") - 1995).alias("w"))
    rows = stage(rows, "round-rows")
    loss = boosting.tweedie(1.1)
    fitted = boosting.boost(rows, ["weekend"], "demand", loss, "w", rounds=1, step=1.0, depth=1)
    steps = loss.steps(F.col("demand"), F.lit(fitted.start), F.col("w"))
    leaf = boosting.choose(fitted.trees[0], ["weekend"], lambda n: F.lit(float(fitted.trees[0].value[n])))
    sums = fitted.transform(rows.withColumns(steps)).groupBy("weekend", leaf.alias("leaf_value"), "prediction")
    out = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("grad").alias("grad"), F.sum("hess").alias("hess"))
    rounded = {"grad": 4, "hess": 4, "leaf_value": 8, "prediction": 8}
    return out.select("weekend", "n", *(F.round(c, d).alias(c) for c, d in rounded.items()))


_DOC_COLUMNS = ["n_chars", "n_words", "word_length"]


def _documents(spark, sf) -> DataFrame:
    docs = files.table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    words = F.size(F.split("text", r"\s+"))
    docs = docs.select("doc_id", "n_chars", words.alias("n_words"), (F.col("n_chars") / words).alias("word_length"))
    labels = files.table(spark, sf, "labels")
    out = docs.join(labels, "doc_id").withColumn("grade", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    return stage(ml.filled(out, _DOC_COLUMNS), "labelled-documents")


@query(
    "g10_classification",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS grade, true AS adds_up, true AS decoded FROM documents JOIN labels USING (doc_id)""",
)
def classification(spark, sf):
    """Probabilities add up, and the decoded label is the likelier one."""
    out = class_predictions(spark, sf)
    # Labels are numbered in order of names: class 0 is "good".
    likely = F.when(F.col("class_0") >= F.col("class_1"), "good").otherwise("poor")
    sums = F.abs(F.col("class_0") + F.col("class_1") - 1) < 1e-9
    return out.select("doc_id", "grade", sums.alias("adds_up"), (F.col("predicted") == likely).alias("decoded"))


@query("g10_class_predictions")
def class_predictions(spark, sf):
    """Class probabilities and decoded labels for every labelled document, out of fold."""
    docs = folds.random_folds(_documents(spark, sf), "doc_id", 2, [5])
    parts = []
    for fold in (0, 1):
        train = docs.filter(F.col("fold") != fold)
        fitted = ml.classifier(_DOC_COLUMNS, "grade", docs, numTrees=20, maxDepth=5).fit(train)
        scored = ml.with_class_probabilities(fitted.transform(docs.filter(F.col("fold") == fold)), 2)
        parts.append(scored.select("doc_id", "grade", "predicted", "class_0", "class_1"))
    return reduce(DataFrame.unionByName, parts)


def _curve(spark, sf) -> tuple[int, DataFrame]:
    docs = _documents(spark, sf).withColumn("label", F.col("quality").cast("double"))
    folded = validation.split(docs, "random", "doc_id", 3, (5,))
    return ml.round_curve(folded, ml.boosted_trees(_DOC_COLUMNS, "label", maxDepth=3, maxIter=100), _DOC_COLUMNS, "label", range(3))


@query("g11_rounds_by_cross_validation", "SELECT CAST(i AS INTEGER) AS rounds, true AS has_error, true AS chosen_is_least FROM range(1, 101) t(i)")
def rounds_by_cross_validation(spark, sf):
    best, table = _curve(spark, sf)
    least = table.agg(F.min_by("rounds", F.struct("cv_rmse", "rounds"))).first()[0]
    return table.select("rounds", (F.col("cv_rmse") > 0).alias("has_error"), F.lit(best == least).alias("chosen_is_least"))


@query("g11_round_curve")
def round_curve(spark, sf):
    """The mean error of every number of rounds up to 100, from one fit per fold."""
    best, table = _curve(spark, sf)
    return table.select("rounds", "cv_rmse", (F.col("rounds") == best).alias("chosen"))


def _segments(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Coefficients of one Poisson regression per store, all fitted together, and the rows they score."""
    train, test = _train_test(spark, sf)
    return grouped.fit_groups(train, ["store_id"], COLUMNS, "demand", "poisson", reg=0.01), test


@query(
    "g12_model_per_segment",
    DAILY + " SELECT store_id, id, date, true AS predicted FROM daily WHERE date > DATE '2001-10-07'",
)
def model_per_segment(spark, sf):
    fitted, test = _segments(spark, sf)
    out = grouped.predict_groups(test, fitted, ["store_id"], COLUMNS, "poisson")
    return out.select("store_id", "id", "date", _usable("prediction"))


@query("g12_segment_coefficients")
def segment_coefficients(spark, sf):
    fitted, _ = _segments(spark, sf)
    return fitted.select("store_id", "n", F.posexplode("b").alias("place", "coefficient")).withColumn(
        "name", F.element_at(F.array(F.lit("intercept"), *map(F.lit, COLUMNS)), F.col("place") + 1)
    )


@query("g12_segment_predictions")
def segment_predictions(spark, sf):
    fitted, test = _segments(spark, sf)
    return grouped.predict_groups(test, fitted, ["store_id"], COLUMNS, "poisson").select("store_id", "id", "date", "demand", "prediction")


@query(
    "g12_segment_lines",
    DAILY
    + """, t AS (SELECT store_id, dept_id, date, demand AS y, CAST(isodow(date) - 1 AS DOUBLE) AS x FROM daily),
f AS (SELECT store_id, dept_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM t WHERE date <= DATE '2001-10-07' GROUP BY ALL)
SELECT store_id, dept_id, round(a, 6) AS intercept, round(b, 6) AS slope, any_value(n) AS n, round(sqrt(avg((y - a - b * x) ** 2)), 6) AS rmse
FROM t JOIN f USING (store_id, dept_id) WHERE date > DATE '2001-10-07' GROUP BY store_id, dept_id, a, b""",
)
def segment_lines(spark, sf):
    """A line over the day of the week per store and department, and its error on the last 28 days."""
    daily = stage(retail.daily_series(spark, sf).select("store_id", "dept_id", "date", "demand", F.weekday("date").alias("dow")), "segment-days")
    by = ["store_id", "dept_id"]
    fitted = grouped.fit_groups(daily.where(F.col("date") <= F.lit(SPLIT)), by, ["dow"], "demand")
    scored = grouped.predict_groups(daily.where(F.col("date") > F.lit(SPLIT)), fitted, by, ["dow"])
    errors = scored.groupBy(*by).agg(r6(metrics.rmse(F.col("demand"), F.col("prediction"))).alias("rmse"))
    return fitted.join(errors, by).select(*by, r6(F.col("b")[0]).alias("intercept"), r6(F.col("b")[1]).alias("slope"), "n", "rmse")


@query(
    "g13_direct_forecast",
    DAILY + " SELECT id, CAST(DATE '2001-11-04' + CAST(n AS INTEGER) AS DATE) AS date, true AS predicted FROM ids, range(1, 29) t(n)",
)
def direct_forecast(spark, sf):
    return direct_predictions(spark, sf).select("id", "date", _usable("prediction"))


@query("g13_direct_predictions")
def direct_predictions(spark, sf):
    """All 28 days after the end of the data at once."""
    daily = retail.daily_series(spark, sf).select("id", "date", "demand")
    rows = stage(direct_features(add_horizon(daily, ["id"], retail.SPAN_END, 28)), "direct-features")
    fitted = _poisson().fit(rows.filter("demand IS NOT NULL"))
    ahead = fitted.transform(rows.filter("demand IS NULL"))
    return ahead.select("id", "date", "prediction")


_SHORT = ["lag_1", "lag_7", "mean_1_7", "dow"]


def short_features(df: DataFrame) -> DataFrame:
    """Features that look back one day or more; a horizon must be scored day by day."""
    w = along("id", "date")
    out = with_count_rolling(df, w, "demand", [("mean_1_7", 1, 7, "mean")])
    out = out.withColumns({"lag_1": F.lag("demand", 1).over(w), "lag_7": F.lag("demand", 7).over(w), "dow": F.weekday("date")})
    return ml.filled(out, _SHORT)


def short_matrix(state: np.ndarray, day: date) -> np.ndarray:
    """``short_features`` of the day after the newest column of ``state``."""
    return np.stack([state[:, -1], state[:, -7], state[:, -7:].mean(1), np.full(len(state), day.weekday())], axis=1)


@query("g14_recursive_model_28_days", DAILY + " SELECT id, date, true AS predicted FROM daily WHERE date > DATE '2001-10-07'")
def recursive_model_28_days(spark, sf):
    """The whole horizon is there, finite and not negative."""
    return recursive_model(spark, sf).select("id", "date", _usable("pred"))


@query("g14_recursive_model")
def recursive_model(spark, sf):
    """Twenty-eight days, each from the forecasts of the days before, in one pass over the series' last fortnight."""
    daily = stage(retail.daily_series(spark, sf).select("id", "date", "demand"), "daily")
    train = daily.filter(F.col("date") <= F.lit(SPLIT))
    fitted = ml.count_regression(_SHORT, "demand", "poisson", reg=0.01).fit(short_features(train))
    return recursive_with_arrays(train, SPLIT, 28, 14, short_matrix, as_arrays(fitted))


def _ensemble(spark, sf, make) -> tuple[DataFrame, list, DataFrame]:
    train, test = _train_test(spark, sf)
    folded = folds.sliding_time_folds(train, "date", 3, 730, 56)
    return *ml.fold_ensemble(folded, test, 3, make, ["id", "date"]), train


@query("g16_fold_ensemble", DAILY + " SELECT id, date, true AS predicted FROM daily WHERE date > DATE '2001-10-07'")
def fold_ensemble(spark, sf):
    return ensemble_predictions(spark, sf).select("id", "date", _usable("prediction"))


@query("g16_ensemble_predictions")
def ensemble_predictions(spark, sf):
    """The mean of the models of three sliding training windows."""
    return _ensemble(spark, sf, _poisson)[0]


@query("g16_mean_importances")
def ensemble_importances(spark, sf):
    """The mean share of every feature over the trees of the three windows."""
    _, models, train = _ensemble(spark, sf, lambda: ml.boosted_trees(COLUMNS, "demand", categories=["dow", "month"], maxIter=5, maxDepth=4))
    return ml.mean_importances(models, COLUMNS, train)


_ORDER_COLUMNS = ["month", "dow", "priority"]


def _orders(spark, sf) -> DataFrame:
    df = files.table(spark, sf, "orders").select(
        "o_orderkey",
        F.month("o_orderdate").cast("double").alias("month"),
        F.weekday("o_orderdate").cast("double").alias("dow"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        "o_totalprice",
    )
    return df


def _linear(reg: float = 0.0, mix: float = 0.0, weight: str | None = None):
    line = LinearRegression(labelCol="o_totalprice", regParam=reg, elasticNetParam=mix, maxIter=20)
    if weight:
        line = line.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=_ORDER_COLUMNS, outputCol="features"), line])


def _cv(spark, sf) -> validation.CrossValidation:
    folded = validation.split(_orders(spark, sf), "random", "o_orderkey", 3, (11, 23))
    candidates = {"plain": _linear, "ridge": lambda: _linear(reg=1000.0)}
    measures = [validation.of_predictions("rmse", metrics.rmse), validation.of_predictions("mae", metrics.mae)]
    return validation.cross_validate(folded, candidates, "o_totalprice", measures, ["o_orderkey"])


@query("g18_cross_validation", "SELECT unnest(['plain', 'ridge']) AS \"modelName\", 6::BIGINT AS n_folds, true AS agrees")
def cross_validation(spark, sf):
    """Mean errors of the statistics equal those computed from the stored predictions."""
    found = _cv(spark, sf)
    out = found.summary(["rmse", "mae"])
    error = F.col("o_totalprice") - F.col("predictions")
    folds_ = found.predictions.groupBy("modelName", "mc_seed", "fold").agg(F.sqrt(F.avg(error * error)).alias("r"), F.avg(F.abs(error)).alias("m"))
    again = folds_.groupBy("modelName").agg(F.avg("r").alias("r"), F.avg("m").alias("m"))
    near = lambda a, b: F.abs(F.col(a) / F.col(b) - 1) < 1e-9
    return out.join(again, "modelName").select("modelName", "n_folds", (near("rmse_mean", "r") & near("mae_mean", "m")).alias("agrees"))


@query("g18_cv_predictions", "SELECT m AS \"modelName\", o_orderkey, 2::BIGINT AS n_predictions FROM orders CROSS JOIN (VALUES ('plain'), ('ridge')) t(m)")
def cv_predictions(spark, sf):
    """Every row is predicted exactly once per model and seed."""
    return _cv(spark, sf).predictions.groupBy("modelName", "o_orderkey").agg(F.count("predictions").alias("n_predictions"))


def _line(column: str):
    """Least squares on one column: what SQL can fit too."""
    line = LinearRegression(labelCol="o_totalprice", solver="normal", maxIter=20)
    return lambda: Pipeline(stages=[VectorAssembler(inputCols=[column], outputCol="features"), line.copy()])


def _cv_sql(folded: str) -> str:
    """Least squares per fold by the closed form; ``folded`` gives (fold, role, place, x columns, y)."""
    return f"""{folded},
long AS (SELECT fold, role, place, m AS "modelName", CASE m WHEN 'by_day' THEN day ELSE priority END AS x, y FROM folded, (VALUES ('by_day'), ('by_priority')) t(m)),
fit AS (SELECT fold, "modelName", regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n_train, max(place) AS train_to FROM long WHERE role = 'train' GROUP BY ALL),
err AS (SELECT fold, "modelName", y - a - b * x AS e, n_train, train_to, place FROM long JOIN fit USING (fold, "modelName") WHERE role = 'test')
SELECT "modelName", CAST(fold AS INTEGER) AS fold, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, count(*) AS n_test,
       any_value(n_train) AS n_train, any_value(train_to) < min(place) AS train_before_test, 'maxIter = 20; solver = normal' AS params
FROM err GROUP BY fold, "modelName"
UNION ALL
SELECT "modelName", -1, round(sqrt(avg(e * e)), 2), round(avg(abs(e)), 2), count(*), NULL, NULL, NULL FROM err GROUP BY "modelName" """


_ROWS_SQL = """WITH r AS (
  SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS n, o_totalprice AS y,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS day, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority
  FROM orders
)"""


def _dated_orders(spark, sf) -> DataFrame:
    orders = files.table(spark, sf, "orders")
    rows = orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice",
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
    )
    return positions(rows, ["date", "o_orderkey"], "place")


def _cv_scores(folded: DataFrame) -> DataFrame:
    """Scores of two lines on every fold beside the sizes and the order of its rows."""
    folded = stage(folded, "g18-folds")
    measures = [validation.of_predictions("rmse", metrics.rmse), validation.of_predictions("mae", metrics.mae)]
    candidates = {"by_day": _line("day"), "by_priority": _line("priority")}
    found = validation.cross_validate(folded, candidates, "o_totalprice", measures, ["o_orderkey"])
    tested = validation.with_whole(found.predictions).groupBy("modelName", "fold").agg(F.count(F.lit(1)).alias("n_test"))
    if "role" in folded.columns:
        train, test = F.col("role") == "train", F.col("role") == "test"
        about = folded.groupBy("fold").agg(F.count_if(train).alias("n_train"), (F.max(F.when(train, F.col("place"))) < F.min(F.when(test, F.col("place")))).alias("train_before_test"))
    else:
        per_fold = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("own"))
        total = per_fold.agg(F.sum("own")).scalar()
        about = per_fold.select("fold", (total - F.col("own")).alias("n_train"), F.lit(False).alias("train_before_test"))
    out = found.statistics.join(tested, ["modelName", "fold"]).join(about, "fold", "left")
    return out.select("modelName", "fold", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), "n_test", "n_train", "train_before_test", "params")


@query(
    "g18_time_folds",
    _cv_sql(
        _ROWS_SQL
        + """,
f AS (SELECT f AS fold FROM range(0, (SELECT (max(n) - max(n) // 2) // (max(n) // 8) FROM r)) t(f)),
folded AS (
  SELECT fold, 'train' AS role, place, day, priority, y FROM r JOIN f ON place >= fold * (n // 8) AND place < fold * (n // 8) + n // 2
  UNION ALL
  SELECT fold, 'test', place, day, priority, y FROM r JOIN f ON place >= fold * (n // 8) + n // 2 AND place < fold * (n // 8) + n // 2 + n // 8
)"""
    ),
)
def time_folds(spark, sf):
    """Rolling windows along the order dates: half of the rows train, the next eighth is scored."""
    rows = stage(_dated_orders(spark, sf), "g18-rows")
    n = rows.count()
    return _cv_scores(validation.split(rows, "time", "o_orderkey", order=["date", "o_orderkey"], train_window=n // 2, test_window=n // 8))


@query(
    "g18_group_folds",
    _cv_sql(
        _ROWS_SQL
        + """,
g AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) - 1 AS pos FROM orders GROUP BY 1),
k AS (SELECT r.*, CASE WHEN (pos // 4) % 2 = 0 THEN pos % 4 ELSE 3 - pos % 4 END AS own FROM r JOIN g USING (o_custkey)),
folded AS (SELECT fold, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS role, place, day, priority, y FROM k, range(0, 4) t(fold))"""
    ),
)
def group_folds(spark, sf):
    """Folds that keep all orders of a customer together."""
    return _cv_scores(validation.split(_dated_orders(spark, sf), "feature", "o_orderkey", 4, feature="o_custkey"))


@query("g18_stored_predictions")
def stored_predictions(spark, sf):
    """Every stored prediction of the random folds, as it was made."""
    return _cv(spark, sf).predictions


_RATES_SQL = """WITH d AS (
  SELECT doc_id, quality, ('0x' || substr(md5('5|' || doc_id), 1, 8))::BIGINT % 3 AS fold, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
),
long AS (SELECT doc_id, quality, fold, m, CASE m WHEN 'lang' THEN lang WHEN 'source' THEN source ELSE 'all' END AS c FROM d, (VALUES ('lang'), ('source'), ('all')) t(m)),
sums AS (SELECT m, c, fold, sum(quality) AS s, count(*) AS n FROM long GROUP BY ALL),
p AS (
  SELECT long.*, (coalesce((SELECT sum(s) FROM sums o WHERE o.m = long.m AND o.c = long.c AND o.fold <> long.fold), 0) + 5.0)
         / (coalesce((SELECT sum(n) FROM sums o WHERE o.m = long.m AND o.c = long.c AND o.fold <> long.fold), 0) + 10.0) AS p
  FROM long
),
lev AS (SELECT m, f AS fold, quality, p FROM p, unnest([p.fold, -1]) t(f)),
ranked AS (SELECT *, rank() OVER (PARTITION BY m, fold ORDER BY p) + (count(*) OVER (PARTITION BY m, fold, p) - 1) / 2.0 AS mid FROM lev)
"""


@query(
    "m14_probabilities",
    _RATES_SQL
    + """SELECT m AS "modelName", CAST(fold AS INTEGER) AS fold, count(*) AS n,
round((sum(CASE WHEN quality = 1 THEN mid END) - sum(CAST(quality = 1 AS BIGINT)) * (sum(CAST(quality = 1 AS BIGINT)) + 1) / 2.0)
  / (sum(CAST(quality = 1 AS BIGINT)) * sum(CAST(quality <> 1 AS BIGINT))), 9) AS auc,
round(-avg(ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END)), 9) AS log_loss FROM ranked GROUP BY m, fold""",
)
def probability_metrics(spark, sf):
    """Exact AUC and log loss per model and fold; a rate over all rows gives one score per fold."""
    docs = files.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(files.table(spark, sf, "labels").where("quality IS NOT NULL"), "doc_id")
    names = {"lang": F.coalesce("lang", F.lit("(none)")), "source": F.coalesce("source", F.lit("(none)")), "all": F.lit("all")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("modelName"), c.alias("c")) for m, c in names.items()))).alias("v")
    folded = validation.split(labelled, "random", "doc_id", 3, (5,)).select("doc_id", "quality", "mc_seed", "fold", each)
    long = stage(folded.select("doc_id", "quality", "mc_seed", "fold", "v.modelName", "v.c"), "m14-long")
    # The rate of a group outside a fold is its total less the fold's own.
    own = long.groupBy("modelName", "c", "fold").agg(F.sum("quality").alias("s"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("modelName", "c")
    rate = (F.sum("s").over(over) - F.col("s") + 5.0) / (F.sum("n").over(over) - F.col("n") + 10.0)
    scored = long.join(own.select("modelName", "c", "fold", rate.alias("p")), ["modelName", "c", "fold"])
    scored = scored.withColumn("probabilities", F.array(1 - F.col("p"), F.col("p")))
    found = validation.statistics(stage(scored, "m14-scored"), [validation.ROC_AUC, validation.LOG_LOSS], "quality")
    sizes = validation.with_whole(scored).groupBy("modelName", "fold").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, ["modelName", "fold"]).select("modelName", "fold", "n", F.round("auc", 9).alias("auc"), F.round("log_loss", 9).alias("log_loss"))


@query("g18_probabilities")
def cross_validated_probabilities(spark, sf):
    """AUC, log loss and accuracy of a forest on stratified folds, with its rounds and settings, and over each whole seed."""
    docs = _documents(spark, sf).withColumn("label", F.col("quality").cast("double"))
    folded = validation.split(docs, "random", "doc_id", 2, (3, 4), stratified=True, label="quality")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", seed=7, numTrees=10, maxDepth=4)
    candidates = {
        "forest": lambda: Pipeline(stages=[VectorAssembler(inputCols=_DOC_COLUMNS, outputCol="features"), forest.copy()]),
        "logistic": lambda: Pipeline(stages=[VectorAssembler(inputCols=_DOC_COLUMNS, outputCol="features"), LogisticRegression(labelCol="label", maxIter=20)]),
    }
    right = validation.of_predictions("accuracy", lambda y, p: F.avg((y == p).cast("double")))
    return validation.cross_validate(folded, candidates, "label", [right, validation.ROC_AUC, validation.LOG_LOSS], ["doc_id"]).statistics


@query("g19_search_table")
def search_table(spark, sf):
    """All hundred tries with their settings and scores, best first."""
    df = folds.evaluation_split(_orders(spark, sf), "random", "o_orderkey", 0.25, 3)
    return ml.random_search(
        ml.same_moments(df.filter("NOT is_validation"), [*_ORDER_COLUMNS, "o_totalprice"], "weight"),
        df.filter("is_validation"),
        partial(_linear, weight="weight"),
        {"reg": (0.0, 5000.0), "mix": (0.0, 1.0)},
        100,
        "o_totalprice",
        metrics.rmse,
    )


@query("g19_random_search", "SELECT i::BIGINT AS place, true AS in_range, true AS ranked FROM range(1, 101) t(i)")
def random_search(spark, sf):
    found = search_table(spark, sf)
    # A row per try: the table of tries is as long as their number.
    by = Window.orderBy("score", "iteration")
    inside = F.col("reg").between(0, 5000) & F.col("mix").between(0, 1) & (F.col("score") > 0)
    ranked = F.coalesce(F.lag("score").over(by) <= F.col("score"), F.lit(True))
    return found.select(F.row_number().over(by).cast("bigint").alias("place"), inside.alias("in_range"), ranked.alias("ranked"))


def _lagged(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("lagged", F.lag("demand", days).over(along("id", "date")))


def _recent(df: DataFrame, since: str) -> DataFrame:
    return df.filter(F.col("date") >= F.lit(since).cast("date"))


@query(
    "g07_step_pipeline",
    DAILY
    + """, l AS (SELECT id, date, demand, lag(demand, 28) OVER (PARTITION BY id ORDER BY date) AS lagged FROM daily)
SELECT id, date, demand, lagged, 'recent' AS recomputed FROM l WHERE date >= DATE '2001-06-01'""",
)
def step_pipeline(spark, sf):
    """Runs twice with one changed step; only that step is computed the second time."""
    folder = fresh_path(spark, "steps")
    daily = retail.daily_series(spark, sf).select("id", "date", "demand")

    def pipeline(since: str) -> StepPipeline:
        return StepPipeline([Step("lagged", _lagged, {"days": 28}), Step("recent", _recent, {"since": since})], folder, sf)

    pipeline("2001-01-01").run(daily)
    second = pipeline("2001-06-01")
    out = second.run(daily)
    return out.withColumn("recomputed", F.lit(",".join(second.computed)))


@query("s08_model_save_load", "SELECT count(*) AS n, 0::BIGINT AS changed FROM orders")
def model_save_load(spark, sf):
    """Predictions of a reloaded model equal those of the fitted one."""
    df = _orders(spark, sf)
    fitted = _linear().fit(df)
    again = ml.save_and_load(fitted, fresh_path(spark, "model"))
    both = again.transform(fitted.transform(df).select(*df.columns, F.col("prediction").alias("before")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") != F.col("prediction")).alias("changed"))
