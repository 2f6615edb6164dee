"""Cross-validation and metrics of probabilities against small plain versions."""

import math
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from shelfline.operators import metrics
from shelfline.plans import validation


def plain_auc(rows):
    pos = [s for s, y in rows if y == 1 and s is not None]
    neg = [s for s, y in rows if y == 0 and s is not None]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_hot_scores_and_nulls(spark):
    rng = random.Random(1)
    groups = {
        "spread": [(rng.random(), rng.randrange(2)) for _ in range(300)],
        "ties": [(rng.randrange(4) / 4, rng.randrange(2)) for _ in range(300)],
        "hot": [(0.5, rng.randrange(2)) for _ in range(500)] + [(0.1, 1), (0.9, 0)],
        "nulls": [(None, 1), (None, 0), (0.3, 1), (0.2, 0), (0.3, 0), (0.1, None)],
        "one class": [(0.1, 1), (0.2, 1)],
    }
    rows = [(g, s, y) for g, some in groups.items() for s, y in some]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(5)
    got = {r.g: r.auc for r in validation.roc_auc(df, ["g"], "y", "s").collect()}
    for g, some in groups.items():
        want = plain_auc(some)
        assert got[g] == want or math.isclose(got[g], want, rel_tol=1e-12), g


def test_log_loss_of_many_classes(spark):
    rows = [(0, [0.5, 0.3, 0.2]), (1, [0.1, 0.8, 0.1]), (2, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    got = df.agg(validation.log_loss_of(F.col("y"), F.col("p"))).first()[0]
    assert math.isclose(got, -(math.log(0.5) + math.log(0.8) + math.log(1e-15)) / 3)


def _rows(spark, n=400):
    rng = random.Random(2)
    rows = [(i, i % 7, float(rng.random()), float(i % 5)) for i in range(n)]
    return spark.createDataFrame([(*r, 2 * r[2] + r[3] + rng.gauss(0, 0.1), float(r[2] + rng.gauss(0, 0.3) > 0.5)) for r in rows], "id long, g long, a double, b double, y double, c double")


def _line(**options):
    return lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(labelCol="y", **options)])


def test_every_row_is_scored_once_by_a_model_that_did_not_see_it(spark):
    df = _rows(spark)
    folded = validation.split(df, "random", "id", 4, (1, 2))
    found = validation.cross_validate(folded, {"line": _line()}, "y", [validation.of_predictions("rmse", metrics.rmse)], ["id"])
    assert found.predictions.groupBy("id").count().where("count <> 2").isEmpty() and found.predictions.count() == 800
    # One fold again by hand.
    own = folded.where("mc_seed = 2")
    model = _line()().fit(own.where("fold <> 5"))
    want = {r.id: r.prediction for r in model.transform(own.where("fold = 5")).collect()}
    got = {r.id: r.predictions for r in found.predictions.where("mc_seed = 2 AND fold = 5").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
    scores = {(r.mc_seed, r.fold): r for r in found.statistics.collect()}
    assert len(scores) == 10 and scores[1, validation.WHOLE].rounds is None
    whole = found.predictions.where("mc_seed = 1").agg(metrics.rmse(F.col("y"), F.col("predictions"))).first()[0]
    assert math.isclose(scores[1, validation.WHOLE].rmse, whole)
    assert found.summary(["rmse"]).first().n_folds == 8


def test_time_folds_never_train_on_later_rows(spark):
    folded = validation.split(_rows(spark), "time", "id", order=["id"], train_window=200, test_window=50)
    assert sorted(r.fold for r in folded.select("fold").distinct().collect()) == [0, 1, 2, 3]
    ends = folded.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("id"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("id"))).alias("b"))
    assert ends.where("a >= b").isEmpty()
    found = validation.cross_validate(folded, {"line": _line()}, "y", [validation.of_predictions("mae", metrics.mae)], ["id"])
    assert sorted(r.id for r in found.predictions.collect()) == list(range(200, 400))


def test_feature_folds_keep_groups_whole(spark):
    folded = validation.split(_rows(spark), "feature", "id", 3, feature="g")
    assert folded.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()


def test_rounds_settings_and_probabilities(spark):
    trees = lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=3, maxDepth=2)])
    found = validation.cross_validate(validation.split(_rows(spark), "random", "id", 2), {"trees": trees}, "y", [validation.of_predictions("mae", metrics.mae)], ["id"])
    row = found.statistics.where("fold = 0").first()
    assert row.rounds == 3 and row.params == "maxDepth = 2; maxIter = 3"
    judge = lambda: Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LogisticRegression(labelCol="c")])
    folded = validation.split(_rows(spark), "random", "id", 2, stratified=True, label="c")
    found = validation.cross_validate(folded, {"j": judge}, "c", [validation.ROC_AUC, validation.LOG_LOSS], ["id"])
    rows = found.predictions.where("fold = 1").collect()
    score = found.statistics.where("fold = 1").first()
    assert math.isclose(score.auc, plain_auc([(r.probabilities[1], r.c) for r in rows]), rel_tol=1e-12)
    assert math.isclose(score.log_loss, -sum(math.log(r.probabilities[int(r.c)]) for r in rows) / len(rows), rel_tol=1e-9)


def test_jobs_read_only_their_folders(spark):
    from shelfline.lineage import stage

    rows = stage(validation.split(_rows(spark), "time", "id", order=["id"], train_window=200, test_window=50), "t", by=["mc_seed", "fold", "role"])
    plan = rows.where("mc_seed = 0 AND fold = 2 AND role = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mc_seed" in plan and "DataFilters: []" in plan


def test_arguments_are_checked(spark):
    df = _rows(spark)
    for options in ({"split_type": "other"}, {"split_type": "random", "n_folds": 1}, {"split_type": "time", "train_window": 5}):
        with pytest.raises(ValueError):
            validation.split(df, key="id", **options)
    with pytest.raises(TypeError):
        validation.split(df, "random", "id", stratified="yes")
