"""Operators against brute force on small literal tables."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfline.functions.rolling import along, rolling, with_count_rolling, with_rolling_max
from shelfline.operators import clean, diagnostics, encode, folds, metrics, text
from shelfline.operators.hierarchy import LEVELS, roll_up
from shelfline.operators.quantiles import group_quantiles
from shelfline.operators.reshape import fill_gaps, fill_window
from shelfline.operators.running import positions, running_total_by
from shelfline.operators.runs import zero_runs
from shelfline.plans.steps import Step, StepPipeline
from shelfline.sources import retail

START = date(2020, 1, 1)


def series(values, key="a"):
    return [(key, START + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, date date, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("id", "date").collect()]


def same(found, expected):
    assert len(found) == len(expected)
    for f, e in zip(found, expected):
        if e is None or (isinstance(e, float) and math.isnan(e)):
            assert f is None
        else:
            assert f == pytest.approx(e, abs=1e-9)


VALUES = [3, 0, None, 5, 1, 1, 8, 0, 0, 2, 7, None, 4, 4, 9, 6, 0, 3]


@pytest.mark.parametrize("stat", ["mean", "std", "sum", "max", "min", "skew", "kurt"])
def test_rolling_equals_pandas(spark, stat):
    df = frame(spark, series(VALUES))
    out = df.withColumn("r", rolling("x", 4, stat, along("id", "date")))
    expected = getattr(pd.Series(VALUES, dtype=float).rolling(4), stat)()
    same(column(out, "r"), expected.tolist())


@pytest.mark.parametrize("stat", ["mean", "std", "sum"])
@pytest.mark.parametrize("shift", [0, 1, 3])
def test_prefix_rolling_equals_pandas(spark, stat, shift):
    df = frame(spark, series(VALUES))
    out = with_count_rolling(df, along("id", "date"), "x", [("r", shift, 3, stat)])
    expected = getattr(pd.Series(VALUES, dtype=float).shift(shift).rolling(3), stat)()
    same(column(out, "r"), expected.tolist())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7])
@pytest.mark.parametrize("shift", [0, 1, 4])
def test_block_rolling_max_equals_pandas(spark, n, shift):
    df = frame(spark, series(VALUES))
    out = with_rolling_max(df, "id", "date", "x", n, "r", shift)
    expected = pd.Series(VALUES, dtype=float).shift(shift).rolling(n).max()
    same(column(out, "r"), expected.tolist())


def test_fill_gaps_keeps_values_and_span(spark):
    rows = [("a", START + timedelta(days=2), 5.0), ("a", START + timedelta(days=5), 7.0), ("b", START, 1.0)]
    out = fill_gaps(frame(spark, rows), ["id"], "date", "x", START, START + timedelta(days=6))
    found = out.groupBy("id").agg(F.count("date").alias("n"), F.sum("x").alias("s"), F.countDistinct("date").alias("d"))
    assert {tuple(r) for r in found.collect()} == {("a", 7, 12.0, 7), ("b", 7, 1.0, 7)}


def test_zero_runs(spark):
    rows = series([0, 0, 1, 0], "a") + series([1, 0, 0], "b") + series([1, 2], "c") + series([0, 0], "d")
    found = {tuple(r) for r in zero_runs(frame(spark, rows), "id", "date", "x").collect()}
    assert found == {("a", 2, 0), ("b", 2, 1), ("c", 0, 1), ("d", 2, 1)}


def test_running_total_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", int(i), int(v)) for i, v in enumerate(rng.integers(0, 9, 600))]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    out = running_total_by(df, ["k"], ["i"], "v", "t").toPandas().sort_values(["k", "i"])
    expected = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "i"]).groupby("k").v.cumsum()
    assert out["t"].tolist() == expected.tolist()


def test_positions_are_dense(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    found = {r.v: r.p for r in positions(df, ["v"], "p").collect()}
    assert found == {v: v for v in range(500)}


def test_series_scale_equals_dense_loop(spark):
    values = {"a": [0, 0, 3, 5, 0, 0, 2, 0], "b": [1, 1, 1, 1, 1, 1, 1, 1], "c": [0, 0, 0, 0, 0, 0, 0, 4]}
    rows = [r for k, v in values.items() for r in series(v, k) if r[2]]
    df = frame(spark, rows).withColumnRenamed("x", "demand")
    last = START + timedelta(days=7)
    found = {r.id: r.scale for r in metrics.series_scale(df, last, 1, keys=["id"]).collect()}
    for key, v in values.items():
        v = np.array(v[int(np.argmax(np.array(v) != 0)):], dtype=float)
        expected = float((np.diff(v) ** 2).mean()) if len(v) > 1 else None
        assert found[key] == (pytest.approx(expected) if expected is not None else None)


def test_roll_up_levels(spark):
    cols = ["state_id", "store_id", "cat_id", "dept_id", "item_id"]
    rows = [("S1", "A", "c1", "d1", "i1", 2.0), ("S1", "B", "c1", "d2", "i1", 3.0), ("S2", "C", "c2", "d1", None, 5.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", v double")
    out = roll_up(df, {"v": "v"}).toPandas()
    assert out.level.nunique() == len(LEVELS)
    assert (out.groupby("level").v.sum() == 10.0).all()
    assert out[out.level == "item_id;state_id"].shape[0] == 2
    assert out[(out.level == "state_id;cat_id") & (out.node == "S1--c1")].v.tolist() == [5.0]


def test_one_hot_long(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, c string")
    assert sorted(tuple(r) for r in encode.one_hot_long(df, "k", "c").collect()) == [(1, "c_a", 1.0), (3, "c_b", 1.0)]


def test_partners_of_a_group(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(60)
    data = {f"s{i:02d}": base * (i % 3) + rng.standard_normal(60) for i in range(12)} | {"s99": np.ones(60)}
    rows = [r for k, v in data.items() for r in series(v, k)]
    df = frame(spark, rows).withColumn("item", F.when(F.col("id") < "s06", "a").otherwise("b"))
    found = {r.id: r for r in diagnostics.partners(df, "item", "id", "date", "x", 0.3).collect()}
    r = pd.DataFrame(data).corr()
    assert found["s99"].partner is None and found["s99"].n_partners == 0
    for k in data:
        others = [o for o in data if (o < "s06") == (k < "s06") and o != k and "s99" not in (o, k)]
        if others:
            best = max(others, key=lambda o: abs(r.loc[k, o]))
            assert found[k].partner == best and found[k].r == pytest.approx(r.loc[k, best])
            assert (found[k].n_strong, found[k].n_partners) == (sum(abs(r.loc[k, o]) > 0.3 for o in others), len(others))


def test_rolling_std_of_large_totals(spark):
    rng = np.random.default_rng(8)
    x = 4.8e8 + np.round(rng.normal(0, 1000, 400))
    w = along("id", "date")
    specs = [("s", 0, 7, "std"), ("m", 28, 60, "mean"), ("t", 0, 7, "sum")]
    out = with_count_rolling(frame(spark, series(x)), w, "x", specs).toPandas().sort_values("date")
    p = pd.Series(x)
    exact = [np.std(x[i - 6 : i + 1].astype(np.longdouble), ddof=1) if i >= 6 else np.nan for i in range(400)]
    assert np.allclose(out.s, np.array(exact, float), rtol=1e-9, equal_nan=True)
    assert np.allclose(out.m, p.rolling(60).mean().shift(28), rtol=1e-12, equal_nan=True)
    assert np.array_equal(out.t.to_numpy(), p.rolling(7).sum().to_numpy(), equal_nan=True)


def test_group_quantiles(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": ["a"] * 500 + ["b"] * 3 + ["c"], "v": np.append(np.round(rng.normal(0, 5, 503)), 2.0)})
    found = group_quantiles(spark.createDataFrame(data).repartition(5), "k", "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99}).toPandas().set_index("k")
    for name, q in (("lo", 0.01), ("mid", 0.5), ("hi", 0.99)):
        assert np.allclose(found[name], data.groupby("k").v.quantile(q).loc[found.index])


def test_calendar_covers_every_sale(spark):
    sold = spark.createDataFrame([("1994-12-30",), ("2003-01-01",)], "date string").select(F.to_date("date").alias("date"))
    days = retail.calendar(spark, 28, sold)
    assert days.count() == days.select("date").distinct().count() == 2925 + 28
    assert days.filter("wm_yr_wk IS NULL").isEmpty() and days.filter("date = '2003-01-01'").count() == 1


def test_window_of_days(spark):
    rows = [("a", "2001-01-01", 3.0), ("a", "2001-01-04", 5.0), ("b", "2000-01-01", 7.0)]
    df = spark.createDataFrame(rows, "id string, date string, x double").withColumn("date", F.to_date("date"))
    out = fill_window(df, ["id"], "date", "x", date(2001, 1, 3), date(2001, 1, 5)).orderBy("id", "date").collect()
    assert [(r.id, r.date.day, r.x) for r in out] == [("a", 3, 0.0), ("a", 4, 5.0), ("a", 5, 0.0), ("b", 3, 0.0), ("b", 4, 0.0), ("b", 5, 0.0)]


def test_partial_autocorrelation_equals_regression(spark):
    rng = np.random.default_rng(1)
    x = [0.0]
    for e in rng.standard_normal(300):
        x.append(0.6 * x[-1] + e)
    df = frame(spark, series(x) + series([1.0] * 301, "flat"))
    acf = diagnostics.autocorrelation(df, "id", "date", "x", 5)
    out = diagnostics.partial_autocorrelation(acf, "id").toPandas()
    c = np.array(x) - np.mean(x)
    rho = np.array([1.0] + [(c[k:] * c[:-k]).sum() / (c * c).sum() for k in range(1, 6)])
    for k in range(1, 6):
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        expected = np.linalg.solve(system, rho[1 : k + 1])[-1]
        assert out[(out.id == "a") & (out.lag == k)].pacf.iat[0] == pytest.approx(expected)
    assert out[out.id == "flat"].pacf.isna().all()


def test_narrow_types_uses_strict_bounds(spark):
    df = spark.createDataFrame([(1, 126, 127, 40000, 1.5), (-127, 0, 5, -3, 2.5)], "a bigint, b bigint, c bigint, d bigint, e double")
    out, report = clean.narrow_types(df)
    assert [t for _, t in out.dtypes] == ["tinyint", "tinyint", "smallint", "int", "float"]
    assert {r.column_name: r.new_bytes for r in report.collect()}["d"] == 8


def test_grouping_encoder_keeps_frequent_levels(spark):
    rows = [("a",)] * 5 + [("b",)] * 3 + [("c",)] * 3 + [("d",)]
    df = spark.createDataFrame(rows, "v string")
    top = encode.GroupingEncoder(encode.OneHotEncoder(), 2).fit(df, "v")
    assert top.encoder.levels == ["OTHER", "a", "b"]
    share = encode.GroupingEncoder(encode.OneHotEncoder(), 0.5).fit(df, "v")
    assert share.encoder.levels == ["OTHER", "a"]


def test_leave_one_out_singletons_and_unseen(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "v string, y double")
    model = encode.LeaveOneOutEncoder(noise=False).fit(df, "v", "y")
    train = {(r.v, r.y): r.e for r in model.transform(df, "v", "e", target="y").collect()}
    assert train == {("a", 1.0): 3.0, ("a", 3.0): 1.0, ("b", 8.0): 4.0}
    score = spark.createDataFrame([("a",), ("z",)], "v string")
    assert {r.v: r.e for r in model.transform(score, "v", "e").collect()} == {"a": 2.0, "z": 4.0}


def test_encoder_list_length_is_checked():
    with pytest.raises(ValueError):
        encode.CategoricalFeaturesEncoder(["a", "b"], [encode.OrdinalEncoder()])


def test_noise_is_standard_normal(spark):
    draw = spark.range(20000).select(encode.standard_normal(4, F.col("id")).alias("z")).toPandas().z
    assert abs(draw.mean()) < 0.03 and abs(draw.std() - 1) < 0.03


def test_group_folds_are_whole_and_balanced(spark):
    rows = [(g, i) for g in range(40) for i in range(g + 1)]
    df = spark.createDataFrame(rows, "g int, i int")
    out = folds.group_folds(df, "g", 4).toPandas()
    assert (out.groupby("g").fold.nunique() == 1).all()
    sizes = out.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 40


@pytest.mark.parametrize(
    "args, error",
    [
        ((1, False, 5, None, None), TypeError),
        (("other", False, 5, None, None), ValueError),
        (("random", "no", 5, None, None), TypeError),
        (("random", False, 2.5, None, None), TypeError),
        (("random", False, -1, None, None), ValueError),
        (("time", False, 5, None, 10), ValueError),
    ],
)
def test_cv_arguments_are_checked(args, error):
    with pytest.raises(error):
        folds.check_cv_arguments(*args)


def test_cv_arguments_that_are_fine():
    folds.check_cv_arguments("time", False, 5, 100, 10)
    folds.check_cv_arguments("feature", True, 5, None, None)


def test_tf_idf_equals_formula(spark):
    docs = spark.createDataFrame([(1, "Red red bolt"), (2, "blue bolt a"), (3, None)], "k int, t string")
    bag = text.bag_of_words(docs, "k", "t")
    out = {(r.k, r.term): r.weight for r in text.tf_idf(bag, docs.agg(F.count(F.lit(1))).scalar(), "k").collect()}
    idf = {"red": math.log(4 / 2) + 1, "bolt": math.log(4 / 3) + 1}
    norm = math.hypot(2 * idf["red"], idf["bolt"])
    assert out[(1, "red")] == pytest.approx(2 * idf["red"] / norm)
    assert (2, "a") not in out and out[(3, "nan")] == pytest.approx(1.0)


def test_word_ngrams(spark):
    df = spark.createDataFrame([(1, "aa bb cc"), (2, "dd"), (3, "")], "k int, t string")
    bag = text.bag_of_words(df, "k", "t", ngrams=(1, 3)).collect()
    assert {(r.k, r.term) for r in bag} == {
        (1, "aa"), (1, "bb"), (1, "cc"), (1, "aa bb"), (1, "bb cc"), (1, "aa bb cc"), (2, "dd")
    }


def test_latent_components_equal_dense_svd(spark):
    rng = np.random.default_rng(2)
    a = rng.random((30, 3)) @ rng.random((3, 12)) + 0.01 * rng.random((30, 12))
    cells = [(i, f"t{j:02d}", float(a[i, j])) for i in range(30) for j in range(12)]
    weights = spark.createDataFrame(cells, "k int, term string, weight double")
    loadings, values = text.latent_components(weights, "k", 3)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert [r.singular_value for r in values.orderBy("component").collect()] == pytest.approx(list(s[:3]))
    found = loadings.toPandas().pivot(index="term", columns="component", values="loading").sort_index()
    for c in range(3):
        v = vt[c] * np.sign(vt[c][np.abs(vt[c]).argmax()])
        assert found[c + 1].to_numpy() == pytest.approx(v, abs=1e-6)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bag_shuffles_texts_and_not_terms(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (None, "aa aa"), (4, None)], "k int, t string")
    bag = text.bag_of_words(df, "k", "t")
    assert {(r.k, r.term, r.tf) for r in bag.collect()} == {(1, "aa", 2), (1, "bb", 1), (2, "cc", 1), (None, "aa", 2), (4, "nan", 1)}
    assert "HashAggregate" not in _plan(bag)


def test_bag_adds_up_repeated_and_null_keys(spark):
    rows = [(1, "aa bb"), (1, "aa"), (None, "cc"), (None, "cc dd"), (2, "aa aa")]
    bag = text.bag_of_words(spark.createDataFrame(rows, "k int, t string").repartition(3), "k", "t").collect()
    assert sorted((str(r.k), r.term, r.tf) for r in bag) == [("1", "aa", 2), ("1", "bb", 1), ("2", "aa", 2), ("None", "cc", 2), ("None", "dd", 1)]


def test_rare_terms_get_the_same_weights(spark, monkeypatch):
    rows = [(i, f"common often{i % 2} rare{i // 2} only{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, t string")

    def weights():
        out = text.tf_idf(text.bag_of_words(df, "k", "t"), df.agg(F.count(F.lit(1))).scalar(), "k")
        return {(r.k, r.term): r.weight for r in out.collect()}

    whole = weights()
    monkeypatch.setattr(text, "LOOKED_UP", 3)
    split = weights()
    assert len(whole) == 48 and split == pytest.approx(whole)
    kept = text.prune(text.bag_of_words(df, "k", "t"), 1).collect()
    assert {r.term for r in kept} == {"common", "often0", "often1", *(f"rare{i}" for i in range(6))}


def test_latent_components_of_many_blocks(spark, monkeypatch):
    """As one block, whatever the size of blocks; a row without a key counts for the projection alone."""
    rng = np.random.default_rng(5)
    cells = [(i, f"t{j:02d}", float(rng.random())) for i in range(40) for j in range(15) if rng.random() < 0.4 or j == i % 15]
    weights = spark.createDataFrame([*cells, (None, "t00", 5.0)], "k int, term string, weight double")
    monkeypatch.setattr(text, "BLOCK_CELLS", 20)
    monkeypatch.setattr(text, "CHUNK_CELLS", 7)
    loadings, values = text.latent_components(weights, "k", 2, passes=12)
    a = np.zeros((40, 15))
    for i, t, w in cells:
        a[i, int(t[1:])] = w
    assert [r.singular_value for r in values.orderBy("component").collect()] == pytest.approx(list(np.linalg.svd(a)[1][:2]), rel=1e-6)
    held = loadings.toPandas().pivot(index="term", columns="component", values="loading").sort_index().to_numpy()
    found = {(r.k, r.component): r.value for r in text.project(weights, loadings, "k").collect()}
    want = {(i, c + 1): (a[i] @ held)[c] for i in range(40) for c in range(2)} | {(None, c + 1): 5.0 * held[0, c] for c in range(2)}
    assert found == pytest.approx(want)
    # A weight is not multiplied out to a row per component, and no join is by weight.
    assert _plan(text.project(weights, loadings, "k")).count("FlatMapCoGroupsInArrow") == 1


def _whole(spark, rows, kind="int", **options):
    df = spark.createDataFrame(rows, f"k {kind}, t string").repartition(3)
    bag = text.bag_of_words(df, "k", "t", ngrams=(1, 2), whole=True)
    return df, bag, text.tf_idf(bag, df.agg(F.count(F.lit(1))).scalar(), "k", **options)


@pytest.mark.parametrize("options", [{"min_df": 2, "sublinear": True}, {"min_df": 3, "smooth_idf": False}, {"max_features": 9}, {"use_idf": False}])
def test_packed_weights_equal_the_long_ones(spark, monkeypatch, options):
    """Repeated, null and empty keys and texts, and many small blocks and ranges."""
    from shelfline.operators import packed

    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in range(12)] + ["été", "größe"]
    rows = [(int(i) if i < 30 else i % 4, " ".join(rng.choice(words, rng.integers(1, 12)))) for i in range(40)]
    rows += [(None, "w1 w2 w1"), (None, "w2 w3"), (50, None), (51, ""), (52, "x w1")]
    monkeypatch.setattr(text, "PACKED_CELLS", 30)
    for name, size in (("RANGE_TERMS", 5), ("RANGE_GRAMS", 16), ("AT_ONCE", 7), ("TOKENS_AT_ONCE", 20)):
        monkeypatch.setattr(packed, name, size)
    df, _, weights = _whole(spark, rows, **options)
    bag = text.bag_of_words(df, "k", "t", ngrams=(1, 2))
    want = text.tf_idf(bag, df.agg(F.count(F.lit(1))).scalar(), "k", **options).collect()
    found = packed.unpacked(weights).collect()
    assert len(found) == len(want) and packed.vocabulary(weights).count() > 1
    assert {(r.k, r.term): r.weight for r in found} == pytest.approx({(r.k, r.term): r.weight for r in want})


def test_shared_tables_are_read_once_for_many_rows(spark, monkeypatch, tmp_path):
    """A task reads vectors, products, hashes and vocabulary once for all the rows it holds; the results do not depend on how many."""
    import os

    from shelfline.operators import packed

    plain = packed.tools

    def logged():
        t = plain()

        def told(function):
            def call(*args, **more):
                with open(tmp_path / f"{os.getpid()}-{id(args)}", "a") as f:
                    f.write(f"{function.__name__}\n")
                return function(*args, **more)

            return call

        for name in ("read", "frequent", "looked_up", "counted"):
            setattr(t, name, told(getattr(t, name)))
        return t

    def calls(name):
        return sum(line == name for x in tmp_path.iterdir() for line in x.read_text().split())

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, 12))) for i in range(120)]
    monkeypatch.setattr(text, "PACKED_CELLS", 20)
    monkeypatch.setattr(packed, "TOKENS_AT_ONCE", 15)
    monkeypatch.setattr(packed, "tools", logged)
    found = []
    for held in (1, 1 << 20):
        monkeypatch.setattr(packed, "HELD_CELLS", held)
        monkeypatch.setattr(packed, "HELD_TOKENS", held)
        df, bag, weights = _whole(spark, rows, min_df=2, sublinear=True)
        tasks = weights.blocks.rdd.getNumPartitions()
        loadings, values = text.latent_components(weights, "k", 2, passes=1)
        got = text.project(weights, loadings, "k")
        ratio = {r.component: r.ratio for r in text.explained_variance(got, weights, F.lit(120), "k").collect()}
        long = packed.unpacked(weights)
        assert ratio == pytest.approx({r.component: r.ratio for r in text.explained_variance(got, long, F.lit(120), "k").collect()})
        found.append(({r.singular_value for r in values.collect()}, {(r.k, r.term): r.weight for r in long.collect()}))
    assert sorted(found[0][0]) == pytest.approx(sorted(found[1][0])) and found[0][1] == pytest.approx(found[1][1])
    assert calls("looked_up") == 0 and calls("frequent") <= bag.rows.rdd.getNumPartitions() + bag.rows.count()
    for x in tmp_path.iterdir():
        x.write_text("")
    path = packed.fresh_path(spark, "vectors")
    packed.stage_at(path, packed.flat(packed.vocabulary(weights).select("range", "idf", F.flatten(F.transform("terms", lambda _: F.array(F.lit(1.0)))).alias("v"))))
    blocks = weights.blocks.count()
    assert packed.times(weights, path, 1, [np.eye(1)]).count() == blocks > 2 * tasks
    assert 0 < calls("read") <= tasks


def test_terms_of_one_hash_are_told_apart(spark):
    """Thue-Morse words have one polynomial hash whatever its odd factor."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(i, f"{a} x y" if i % 3 else f"{b} x") for i in range(9)]
    rows += [(9, f"{a} {b} z")]
    for min_df in (1, 4):
        df, _, weights = _whole(spark, rows, min_df=min_df)
        want = text.tf_idf(text.bag_of_words(df, "k", "t", ngrams=(1, 2)), df.agg(F.count(F.lit(1))).scalar(), "k", min_df).collect()
        found = text.packed.unpacked(weights).collect()
        assert {(r.k, r.term): r.weight for r in found} == pytest.approx({(r.k, r.term): r.weight for r in want})
    assert len(set(text.packed.tools().hashes_of(pa.array([a, b])).tolist())) == 1


def test_terms_of_words_with_blanks_are_one(spark):
    """Pairs of different words may be one term."""
    words_of = text.Words("[a-z] [a-z]|[a-z]+")
    df = spark.createDataFrame([(1, "a b-cc"), (2, "aa-b c"), (3, "aa b-cc"), (4, "a b")], "k int, t string")
    for ngrams in ((1, 1), (1, 2), (2, 3)):
        want = text.tf_idf(text.bag_of_words(df, "k", "t", ngrams, words_of=words_of), F.lit(4), "k", 1).collect()
        found = text.packed.unpacked(text.tf_idf(text.bag_of_words(df, "k", "t", ngrams, words_of=words_of, whole=True), F.lit(4), "k", 1)).collect()
        assert {(r.k, r.term): r.weight for r in found} == pytest.approx({(r.k, r.term): r.weight for r in want})


def test_latent_components_of_packed_weights(spark, monkeypatch):
    """As of the long weights; a pass shuffles nothing, and what it wrote is gone."""
    import os

    from shelfline import lineage
    from shelfline.operators import packed

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(2, 20)))) for i in range(60)]
    rows += [(None, "w1 w2 w3"), (99, "unknown")]
    monkeypatch.setattr(text, "PACKED_CELLS", 40)
    monkeypatch.setattr(packed, "RANGE_TERMS", 11)
    before = set(os.listdir(lineage.shared_folder(spark)))
    _, bag, weights = _whole(spark, rows, min_df=2, sublinear=True)
    assert weights.blocks.count() > 2
    lineage.drop([bag.path])
    long = packed.unpacked(weights)
    loadings, values = text.latent_components(weights, "k", 3)
    left = {x.rpartition("-")[0] for x in set(os.listdir(lineage.shared_folder(spark))) - before}
    assert left <= {"vocabulary", "weights", "latent-pass", "checkpoints"}
    _, singular = text.latent_components(long, "k", 3)
    assert [r.singular_value for r in values.collect()] == pytest.approx([r.singular_value for r in singular.collect()])
    found = {(r.k, r.component): r.value for r in text.project(weights, loadings, "k").collect()}
    want = {(r.k, r.component): r.value for r in text.project(long, loadings, "k").collect()}
    assert found == pytest.approx(want, abs=1e-12) and len(found) == 61 * 3 and (99, 1) not in found
    some = loadings.where("term IN ('w1', 'w2 w3')")
    found = {(r.k, r.component): r.value for r in text.project(weights, some, "k").collect()}
    want = {(r.k, r.component): r.value for r in text.project(long, some, "k").collect()}
    assert found == pytest.approx(want, abs=1e-12) and 0 < len(found) < 61 * 3
    step = packed.times(weights, "unused", 13, [np.eye(13)])
    assert "Exchange" not in _plan(step) and "Exchange" not in _plan(packed.back(packed.by_range(weights), "unused", "unused", 13))
    n, terms = F.lit(62), text.explained_variance(text.project(weights, loadings, "k"), weights, F.lit(62), "k").collect()
    plain = text.explained_variance(text.project(long, loadings, "k"), long, n, "k").collect()
    assert {r.component: r.ratio for r in terms} == pytest.approx({r.component: r.ratio for r in plain})


def test_written_tables_leave_no_shuffle_files(spark):
    from glob import glob
    from time import sleep

    from shelfline import lineage

    files = lambda: set(glob("/tmp/blockmgr-*/*/shuffle_*.data"))
    before, own = files(), spark.conf.get(lineage._FREE, None)
    lineage.stage(spark.range(1000).repartition(7, "id"), "freed")
    assert spark.conf.get(lineage._FREE, None) == own
    for _ in range(50):
        if not files() - before:
            break
        sleep(0.1)
    assert not files() - before


def test_linear_models_on_the_same_moments(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from shelfline.operators import metrics
    from shelfline.plans import model

    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), 9.0, 1e5 + 700.0 * float(a) - 30.0 * float(b) + float(50.0 * rng.standard_normal())) for a, b in rng.integers(0, 12, (300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, flat double, y double")
    moments = model.same_moments(df, ["a", "b", "flat", "y"], "w")
    assert moments.count() == 8

    def make(weight=None, **settings):
        line = LinearRegression(labelCol="y", maxIter=20, regParam=settings["reg"], elasticNetParam=settings["mix"])
        return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "flat"], outputCol="features"), line.setWeightCol(weight) if weight else line])

    ranges = {"reg": (0.0, 500.0), "mix": (0.0, 1.0)}
    plain = model.random_search(df, df, make, ranges, 5, "y", metrics.rmse).collect()
    short = model.random_search(moments, df, lambda **s: make("w", **s), ranges, 5, "y", metrics.rmse, at_once=2).collect()
    assert [r.iteration for r in short] == [r.iteration for r in plain]
    assert [r.score for r in short] == pytest.approx([r.score for r in plain], rel=1e-6)
    with pytest.raises(ValueError):
        model.same_moments(df.unionByName(spark.createDataFrame([(None, 1.0, 9.0, 2.0)], df.schema)), ["a", "y"], "w")


def test_step_pipeline_recomputes_from_the_first_change(spark, tmp_path):
    def add(df, by):
        return df.withColumn("v", F.col("v") + by)

    def run(b, c):
        p = StepPipeline([Step("a", add, {"by": 1}), Step("b", add, {"by": b}), Step("c", add, {"by": c})], str(tmp_path), "src")
        return p.run(spark.createDataFrame([(0,)], "v int")).first().v, p.computed

    assert run(10, 100) == (111, ["a", "b", "c"])
    assert run(10, 100) == (111, [])
    assert run(10, 200) == (211, ["c"])
    assert run(20, 100) == (121, ["b", "c"])


def test_quadratic_kappa_equals_matrix_form(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 5, 200), rng.integers(0, 5, 200)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    found = df.agg(metrics.quadratic_kappa(F.col("a"), F.col("b")).alias("k")).first().k
    w = np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    seen = np.zeros((5, 5))
    np.add.at(seen, (a, b), 1)
    expected = np.outer(np.bincount(a, minlength=5), np.bincount(b, minlength=5)) / 200
    assert found == pytest.approx(1 - (w * seen).sum() / (w * expected).sum())


def test_lagged_correlation_with_gaps(spark):
    """Against a plain loop: series with missing days, one that never varies, one without a common day at small lags."""
    from shelfline.operators import diagnostics

    rng = np.random.default_rng(8)
    start, rows = date(2001, 1, 1), []
    for name in ("a", "b", "c", "flat", "late"):
        for d in range(40):
            if (name == "late") != (d >= 30) or rng.random() < 0.2:
                continue
            rows.append((name, start + timedelta(days=d), 5.0 if name == "flat" else float(rng.integers(0, 50)) + 1e6))
    rows.append(("b", start, None))
    df = spark.createDataFrame(rows, "id string, date date, x double").repartition(3)
    got = {(r.id, r.lag): r.r for r in diagnostics.lagged_correlation(df, "id", "date", "x", 6).collect()}
    cell = {(n, d): v for n, d, v in rows if v is not None}
    want = {}
    for name in ("b", "c", "flat", "late"):
        for lag in range(-6, 7):
            pairs = [(v, cell[name, d - timedelta(days=lag)]) for (n, d), v in cell.items() if n == "a" and (name, d - timedelta(days=lag)) in cell]
            if pairs:
                x, y = np.array(pairs).T
                want[name, lag] = None if x.std() == 0 or y.std() == 0 else np.corrcoef(x, y)[0, 1]
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None) and (r is None or abs(got[k] - r) < 1e-9), k
    assert diagnostics.lagged_correlation(df.limit(0), "id", "date", "x", 6).count() == 0
