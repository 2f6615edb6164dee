"""Boosting for a loss and recursion in one job, against plain versions."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from shelfline.catalog.models import short_features, short_matrix
from shelfline.plans import boosting, model as ml
from shelfline.plans.forecast import recursive_with_arrays, recursive_with_model
from shelfline.plans.scoring import as_arrays

TRUTH = {
    "squared": (boosting.SQUARED, lambda y, f, w: w * (y - f) ** 2),
    "poisson": (boosting.POISSON, lambda y, f, w: w * (np.exp(f) - y * f)),
    "tweedie": (boosting.tweedie(1.3), lambda y, f, w: w * (np.exp(0.7 * f) / 0.7 + y * np.exp(-0.3 * f) / 0.3)),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(600):
        x, z = rng.random(2)
        out.append((i, float(x), float(z), float(rng.poisson(np.exp(1.5 * (x > 0.4) + z))), float(rng.random() + 0.1), i % 5 == 0))
    out += [(600, 0.5, 0.5, None, 1.0, False), (601, 0.5, 0.5, 1.0, None, False), (602, 0.5, 0.5, 1e9, 0.0, False)]
    return spark.createDataFrame(out, "id long, x double, z double, y double, w double, valid boolean").repartition(3).cache()


@pytest.mark.parametrize("name", TRUTH)
def test_gradients(spark, name):
    loss, plain = TRUTH[name]
    points = [(y, f, w) for y in (0.0, 1.0, 7.0) for f in (0.2, 1.0, 2.5) for w in (0.5, 2.0)]
    df = spark.createDataFrame(points, "y double, f double, w double")
    y, f, w = F.col("y"), F.col("f"), F.col("w")
    e = 1e-4
    for r in df.select("*", loss.value(y, f, w).alias("v"), *(c.alias(n) for n, c in loss.steps(y, f, w).items())).collect():
        down, here, up = (plain(r.y, r.f + s, r.w) for s in (-e, 0, e))
        assert np.isclose(r.v, here) and np.isclose(r.grad, (up - down) / 2 / e, rtol=1e-5, atol=1e-6) and np.isclose(r.hess, (up - 2 * here + down) / e / e, rtol=1e-3)


@pytest.mark.parametrize("name", TRUTH)
def test_every_round_is_a_newton_step_of_its_leaves(rows, name):
    loss, plain = TRUTH[name]
    fitted = boosting.boost(rows, ["x", "z"], "y", loss, "w", rounds=7, step=0.3, depth=2, reg=0.5)
    data = [r for r in rows.collect() if r.y is not None and r.w]
    x, y, w = np.array([(r.x, r.z) for r in data]), np.array([r.y for r in data]), np.array([r.w for r in data])
    f = np.full(len(y), loss.start((y * w).sum() / w.sum()))
    grad, hess = {
        "squared": (lambda f: -2 * w * (y - f), lambda f: 2 * w),
        "poisson": (lambda f: w * (np.exp(f) - y), lambda f: w * np.exp(f)),
        "tweedie": (lambda f: w * (np.exp(0.7 * f) - y * np.exp(-0.3 * f)), lambda f: w * (0.7 * np.exp(0.7 * f) + 0.3 * y * np.exp(-0.3 * f))),
    }[name]
    assert len(fitted.trees) == 7 and [c[0] for c in fitted.curve] == list(range(8))
    for n, tree in enumerate(fitted.trees):
        assert np.isclose(fitted.curve[n][1], plain(y, f, w).sum() / w.sum())
        leaf = tree.leaves(x)
        for node in np.unique(leaf):
            own = leaf == node
            assert np.isclose(tree.value[node], -grad(f)[own].sum() / (hess(f)[own].sum() + 0.5))
        f = f + 0.3 * tree.predict(x)
    losses = [c[1] for c in fitted.curve]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    got = {r.id: r.prediction for r in fitted.transform(rows).collect()}
    want = np.exp(f) if loss.log else f
    assert np.allclose([got[r.id] for r in data], want) and np.allclose(fitted.predict(x), want)


def test_early_stop_keeps_the_best_rounds(rows):
    fitted = boosting.boost(rows, ["x", "z"], "y", boosting.POISSON, "w", "valid", rounds=40, step=0.8, depth=5, patience=3)
    valid = [c[2] for c in fitted.curve]
    assert len(fitted.trees) == int(np.argmin(valid)) == len(valid) - 1 - 3
    with pytest.raises(ValueError):
        boosting.boost(rows.where("false"), ["x"], "y", boosting.POISSON)


def test_recursion_in_one_job_equals_the_staged_days(spark):
    rng = random.Random(5)
    start, last = date(2001, 1, 1), date(2001, 3, 11)
    rows = [(f"s{i}", start + timedelta(days=d), float(rng.randrange(0, 9))) for i in range(7) for d in range((last - start).days + 1)]
    history = spark.createDataFrame(rows, "id string, date date, demand double")
    columns = ["lag_1", "lag_7", "mean_1_7", "dow"]
    train = short_features(history)
    trees = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTRegressor(labelCol="demand", maxIter=4, maxDepth=3, seed=1)])
    for make in (ml.count_regression(columns, "demand", "poisson", reg=0.01), trees):
        fitted = make.fit(train)
        want = {(r.id, r.date): r.pred for r in recursive_with_model(history, last, 5, 14, short_features, fitted, 1.02).collect()}
        found = recursive_with_arrays(history, last, 5, 14, short_matrix, as_arrays(fitted), 1.02)
        got = {(r.id, r.date): r.pred for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    sparse = recursive_with_arrays(history.where("demand > 0"), last, 3, 14, lambda h, day: h[:, -1:], as_arrays(fitted_sum(spark)))
    dense = recursive_with_arrays(history, last, 3, 14, lambda h, day: h[:, -1:], as_arrays(fitted_sum(spark)))
    assert sorted(map(tuple, sparse.collect())) == sorted(map(tuple, dense.collect()))
    assert recursive_with_arrays(history.where("false"), last, 3, 14, short_matrix, as_arrays(fitted)).count() == 0


def fitted_sum(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
