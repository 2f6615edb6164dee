"""Kept steps and scratch folders."""

import os

import pytest
from pyspark.sql import functions as F

from shelfline import lineage
from shelfline.plans.steps import Step, StepPipeline


def plus(df, by):
    return df.withColumn("x", F.col("x") + by)


def times(df, by):
    return df.withColumn("x", F.col("x") * by)


def fails(df):
    lineage.stage(df, "before-the-error")
    raise RuntimeError("aborted")


@pytest.fixture
def folder(spark):
    return lineage.fresh_path(spark, "steps-test")


def values(df):
    return sorted(r.x for r in df.collect())


def test_only_what_changed_is_computed(spark, folder):
    df = spark.range(3).select(F.col("id").alias("x"))
    make = lambda a, b, version=None: StepPipeline([Step("plus", plus, {"by": a}), Step("times", times, {"by": b}, version)], folder, "v1")
    first = make(1, 2)
    assert values(first.run(df)) == [2, 4, 6] and first.computed == ["plus", "times"]
    again = make(1, 2)
    assert values(again.run(df)) == [2, 4, 6] and again.computed == []
    later = make(1, 3)
    assert values(later.run(df)) == [3, 6, 9] and later.computed == ["times"]
    newer = make(1, 2, "2")
    assert values(newer.run(df)) == [2, 4, 6] and newer.computed == ["times"]


def test_a_changed_function_is_computed_again(spark, folder):
    df = spark.range(2).select(F.col("id").alias("x"))
    runs = []
    for body in (lambda d: d.withColumn("x", F.col("x") + 1), lambda d: d.withColumn("x", F.col("x") + 7)):
        p = StepPipeline([Step("s", body)], folder, "v1")
        runs.append((values(p.run(df)), p.computed))
    assert runs == [([1, 2], ["s"]), ([7, 8], ["s"])]


def test_an_aborted_write_is_never_read(spark, folder):
    df = spark.range(3).select(F.col("id").alias("x"))
    p = StepPipeline([Step("plus", plus, {"by": 1}), Step("fails", fails)], folder, "v1")
    with pytest.raises(RuntimeError):
        p.run(df)
    # Files of a write that stopped half way lie in the folder, too.
    df.write.parquet(f"{folder}/fails-half")
    os.remove(f"{folder}/fails-half/_SUCCESS")
    assert set(p.manifest(spark)) == {p.keys()[0]}
    good = StepPipeline([Step("plus", plus, {"by": 1}), Step("fails", times, {"by": 5}, "2")], folder, "v1")
    assert values(good.run(df)) == [5, 10, 15] and good.computed == ["fails"]


def test_old_tables_go(spark, folder):
    df = spark.range(3).select(F.col("id").alias("x"))
    old, new = (StepPipeline([Step("plus", plus, {"by": n})], folder, "v1") for n in (1, 2))
    old.run(df)
    new.run(df)
    (gone,) = new.clean(spark)
    assert not os.path.exists(gone.removeprefix("file://")) and new.clean(spark) == []
    assert values(new.run(df)) == [2, 3, 4] and new.computed == []
    assert values(old.run(df)) == [1, 2, 3] and old.computed == ["plus"]


def test_scratch_folders_go(spark):
    before = lineage.stage(spark.range(2), "outside")
    with lineage.scratch() as keep:
        lineage.stage(spark.range(3), "inside")
        path = lineage.fresh_path(spark, "kept")
        kept = lineage.stage_at(path, spark.range(4))
        keep.append(path)
        inside = list(lineage._named)
    assert kept.count() == 4 and before.count() == 2
    gone = [p for p in inside if p not in lineage._named]
    assert len(gone) == 1 and not os.path.exists(gone[0].removeprefix("file://"))
