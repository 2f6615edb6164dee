"""Grouped fits against one MLlib fit per group, and models as arrays against the models."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from shelfline.plans import grouped, scoring


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        g = ["a", "b", "c", None][0 if i % 3 else (i // 3) % 4]  # most rows are of one group
        x, z = float(rng.random() * 3), float(rng.integers(0, 7))
        out.append((g, "k", x, z, float(rng.poisson(np.exp(0.3 * x + 0.05 * z + (g == "b")))), float(rng.random() + 0.5)))
    out += [("a", "k", None, 1.0, 2.0, 1.0), ("a", "k", 1.0, 1.0, None, 1.0), ("e", "k", None, None, None, 1.0)]
    return spark.createDataFrame(out, "g string, h string, x double, z double, y double, w double").repartition(4).cache()


def separate(rows, group, estimator, weight):
    own = rows.where(F.col("g").eqNullSafe(F.lit(group))).dropna(subset=["x", "z", "y"])
    estimator = estimator.setWeightCol("w") if weight else estimator
    model = Pipeline(stages=[VectorAssembler(inputCols=["x", "z"], outputCol="features"), estimator]).fit(own).stages[-1]
    return [model.intercept, *model.coefficients], own.count()


@pytest.mark.parametrize("family,reg,weight", [("gaussian", 0.0, False), ("gaussian", 0.0, True), ("poisson", 0.0, True), ("poisson", 0.01, False), ("tweedie", 0.0, False)])
def test_equals_separate_fits(rows, family, reg, weight):
    fitted = grouped.fit_groups(rows, ["g", "h"], ["x", "z"], "y", family, 1.1, "w" if weight else None, reg)
    got = {r.g: (r.b, r.n) for r in fitted.collect()}
    assert set(got) == {"a", "b", "c", None}
    for group, (b, n) in got.items():
        if family == "gaussian":
            estimator = LinearRegression(labelCol="y", solver="normal")
        else:
            options = {"variancePower": 1.1, "linkPower": 0.0} if family == "tweedie" else {"link": "log"}
            estimator = GeneralizedLinearRegression(family=family, labelCol="y", maxIter=50, tol=1e-10, regParam=reg, **options)
        want, size = separate(rows, group, estimator, weight)
        assert n == size and np.allclose(b, want, rtol=1e-6, atol=1e-8), (group, b, want)


def test_many_groups_without_broadcast(rows, monkeypatch):
    want = {r.g: r.b for r in grouped.fit_groups(rows, ["g"], ["x"], "y", "poisson").collect()}
    monkeypatch.setattr(grouped, "MOST_BROADCAST", 0)
    got = {r.g: r.b for r in grouped.fit_groups(rows, ["g"], ["x"], "y", "poisson").collect()}
    assert all(np.allclose(got[g], want[g], rtol=1e-12) for g in want)


def test_undetermined_groups_and_predictions(spark):
    df = spark.createDataFrame([("one", 2.0, 4.0), ("flat", 1.0, 3.0), ("flat", 1.0, 5.0), ("line", 0.0, 1.0), ("line", 2.0, 5.0)], "g string, x double, y double")
    fitted = grouped.fit_groups(df, ["g"], ["x"], "y")
    more = df.select("g", "x").union(spark.createDataFrame([("line", 10.0), ("line", None), ("new", 1.0), (None, 1.0)], "g string, x double"))
    got = {(r.g, r.x): r.prediction for r in grouped.predict_groups(more, fitted, ["g"], ["x"]).collect()}
    want = {("one", 2.0): 4.0, ("flat", 1.0): 4.0, ("line", 0.0): 1.0, ("line", 2.0): 5.0, ("line", 10.0): 21.0}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert got["line", None] is None and got["new", 1.0] is None and got[None, 1.0] is None
    with pytest.raises(ValueError):
        grouped.fit_groups(df, ["g"], ["x"], "y", "gamma")


def test_models_as_arrays(spark, rows):
    rng = random.Random(3)
    data = [(rng.random(), rng.choice("pqrst"), float(rng.randrange(5)), rng.random()) for _ in range(400)]
    df = spark.createDataFrame(data, "x double, c string, z double, e double").withColumn("y", F.expr("5 * x * x + (CASE WHEN c IN ('p', 's') THEN 2 ELSE 0 END) + z * e"))
    df = StringIndexer(inputCol="c", outputCol="k", stringOrderType="alphabetAsc").fit(df).transform(df)
    assembled = VectorAssembler(inputCols=["x", "k", "z"], outputCol="features")
    matrix = np.array([(r.x, r.k, r.z) for r in df.select("x", "k", "z").collect()])
    for last in (
        GBTRegressor(labelCol="y", maxIter=12, maxDepth=4, seed=1), DecisionTreeRegressor(labelCol="y", maxDepth=5),
        LinearRegression(labelCol="y"), GeneralizedLinearRegression(family="poisson", labelCol="y", link="log"),
        GeneralizedLinearRegression(family="tweedie", variancePower=1.2, linkPower=0.0, labelCol="y"), GeneralizedLinearRegression(labelCol="y"),
    ):
        model = Pipeline(stages=[assembled, last]).fit(df)
        want = [r.prediction for r in model.transform(df).collect()]
        assert np.allclose(scoring.as_arrays(model).predict(matrix), want, rtol=1e-12)
    with pytest.raises(ValueError):
        scoring.as_arrays(Pipeline(stages=[assembled, GeneralizedLinearRegression(labelCol="y", link="inverse")]).fit(df.withColumn("y", F.col("y") + 1)))


def test_round_curve_equals_separate_fits(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.random(), rng.random(), rng.random()) for _ in range(300)], "x double, z double, e double")
    df = df.withColumn("y", F.expr("3 * x + CASE WHEN z > 0.5 THEN 1 ELSE 0 END + 0.2 * e")).repartition(3)
    fit = lambda n: Pipeline(stages=[VectorAssembler(inputCols=["x", "z"], outputCol="features"), GBTRegressor(labelCol="y", maxIter=n, maxDepth=3, seed=2)]).fit(df)
    curve = {r.round: r.squares / r.n for r in scoring.prefix_errors(df, scoring.as_arrays(fit(20)), ["x", "z"], "y").collect()}
    assert sorted(curve) == list(range(1, 21))
    for n in (1, 7, 20):
        error = fit(n).transform(df).agg(F.avg(F.expr("(y - prediction) * (y - prediction)"))).first()[0]
        assert abs(curve[n] - error) < 1e-12
