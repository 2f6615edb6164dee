"""The stages, each against a plain version or a property of what it must leave."""

import re

import corpus_pipeline
import pytest

from shelfline.llm.decontaminate import benchmark_hits
from shelfline.llm.personal import find_personal
from shelfline.llm.quality import assess, fit

from .test_corpus import near_copies, plain_components


@pytest.fixture(scope="module")
def where(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, where).collect()}
    verdicts = assess(docs, fit(docs, spark.read.parquet(f"{where}/labels.parquet")))
    assert kept == {r.doc_id for r in verdicts.where("keep").collect()}


def test_near_duplicate_stage(spark, docs, odd_rows, where):
    rows = near_copies(9)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(rows), where).collect())
    assert kept == sorted(key for key, _, least in plain_components(rows) if key == least)
    twice = rows + rows[:5]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(twice), where).collect()) == kept
    out = corpus_pipeline.near_duplicates(spark, docs(odd_rows), where)
    assert out.columns == docs(odd_rows).columns and {1, 2, 3, 5, 9}.issubset({r.doc_id for r in out.collect()})


def test_near_duplicates_by_row(spark, docs, where):
    """Rows without an id, and rows that share one, go or stay by their own text."""
    clean = [f"clean {i} " + " ".join(f"v{i}x{j}" for j in range(40)) for i in range(4)]
    group = [f"group{g} " + " ".join(f"g{g}y{j}" for j in range(60)) for g in range(5)]
    row = lambda key, text: (key, text, "en", "s")

    def kept(given):
        return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(given), where).collect()), key=repr)

    def same(given, want):
        assert kept([row(*x) for x in given]) == sorted(want, key=repr)

    # A null id in a component that has an id; unlinked rows without an id stay.
    same([(1, group[0]), (None, group[0] + " end"), (None, clean[0]), (None, clean[1])], [(1, group[0]), (None, clean[0]), (None, clean[1])])
    # An unlinked text that shares its id with a linked one.
    same([(1, group[0]), (2, group[0] + " end"), (2, clean[0])], [(1, group[0]), (2, clean[0])])
    # Copies that all lack an id, and near copies under one id: one of each stays.
    assert len(kept([row(None, group[1]), row(None, group[1]), row(None, group[1] + " end")])) == 1
    assert len(kept([row(7, group[2]), row(7, group[2] + " end"), row(7, group[2] + " end two")])) == 1
    # Whether an unrelated row repeats changes nothing; texts without words all stay.
    bare = [(8, None), (8, None), (9, ""), (9, ""), (None, None), (None, None)]
    same([*bare, (1, group[3])], [*bare, (1, group[3])])
    same([*bare, (1, group[3]), (1, group[3]), (5, clean[2]), (5, clean[2])], [*bare, (1, group[3]), (5, clean[2])])


def test_personal_data_stage_learns_from_all_rows(spark, docs, where, monkeypatch):
    """No text and no span of a text is left out of the fit, and all are redacted."""
    from pyspark.ml.classification import GBTClassifier

    fitted, fit = [], GBTClassifier.fit

    def seen(self, table, *more):
        fitted.append(sum(r.weight if "weight" in table.columns else 1 for r in table.collect()))
        return fit(self, table, *more)

    monkeypatch.setattr(GBTClassifier, "fit", seen)
    rows = [(i, f"call +1 (974) 555-{i:04} or a{i % 50}@mail.example.com", "en", "a") for i in range(6000)]
    rows.append((6000, "".join(f"write to b{i}@mail{i}.example.com today. " for i in range(200)), "en", "a"))
    out = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs(rows), where).collect()}
    # Three examples of a span, about a third of the texts held out.
    assert 0.6 * 36_000 < fitted[0] < 0.72 * 36_600
    assert out == {i: "call [phone] or [email]" if i < 6000 else "write to [email] today. " * 200 for i in range(6001)}


def test_run(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    bench = spark.read.parquet(f"{where}/benchmark.parquet")
    for name, function in corpus_pipeline.STAGES[2:4]:
        kept = function(spark, docs, where).cache()
        assert kept.columns == docs.columns and kept.count() == docs.count()
        if name == "decontamination":
            assert benchmark_hits(kept, bench).where("n_hit > 0").isEmpty()
        else:
            assert find_personal(kept, None).where("size(base) > 0").isEmpty()
    out = corpus_pipeline.run(spark, where)
    assert out.count() > 0 and {"take_tokens", "text"} <= set(out.columns)
    words = re.compile(r"[^\x20\x09-\x0D]+")
    assert all(len(words.findall(r.text or "")) == r.take_tokens for r in out.collect())


def test_empty_and_odd(spark, docs, odd_rows, where):
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs([]).limit(0), where).count() == 0
        function(spark, docs(odd_rows), where).collect()
