"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept, with the columns of
its input; the last returns the mix: a row per document and epoch in which it is used, with the
cleaned text cut to the tokens that it gives. ``run`` writes every stage's result as Parquet below the
shared folder, goes on from there, and deletes what a stage wrote on the way.

1. quality: documents whose posterior of low quality or toxicity exceeds one half go.
2. near duplicates: of each component of linked texts one row stays: that of the least id, and of
   the texts of one id that of the least hash. A null id is larger than all others. Texts without
   words link with nothing and all stay. Rows that repeat the id and text of a kept row go.
3. decontamination: words inside occurrences of benchmark passages are taken out of the text.
4. personal data: spans become the name of their kind in brackets.
5. mixing: sources are mixed to target weights.

Null texts pass all stages. Rows are told apart by id and text, so rows without doc_id and rows
that share one are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.lineage import fresh_path, scratch, stage, stage_at
from shelfline.llm.decontaminate import decontaminated
from shelfline.llm.jaccard import jaccard_components
from shelfline.llm.mixing import mix
from shelfline.llm.personal import fit as fit_personal, redact
from shelfline.llm.quality import assess, fit as fit_quality
from shelfline.llm.queries import MIX_WEIGHTS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier with its site posteriors keeps; without labels all are kept."""
    verdicts = assess(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))
    gone = verdicts.where("NOT keep").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_row"])
    return docs.join(gone, same, "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts; null texts and texts without words all stay."""
    # Components of texts, then of rows: the hash of a text stands for it, whatever ids its rows have.
    row = F.xxhash64(docs["text"])
    texts = jaccard_components(docs.select(row.alias("_row"), "text"), key="_row")
    texts = texts.where("n_shingles > 0").select("_row", F.col("component_id").alias("_component")).distinct()
    own = docs.groupBy(F.col("doc_id").alias("_id"), row.alias("_row")).agg(F.count(F.lit(1)).alias("_copies"))
    found = stage(own.join(texts, "_row"), "pipeline-components")
    first = found.groupBy("_component").agg(F.min(F.struct(F.isnull("_id"), "_id", "_row")).alias("_first"))
    stays = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_row") == F.col("_first._row"))
    judged = found.join(stage(first, "pipeline-firsts"), "_component").select("_id", "_row", "_copies", stays.alias("_stays"))
    # Rows that go or stand several times; the latter come back once.
    judged = stage(judged.where("NOT _stays OR _copies > 1"), "pipeline-judged")
    several = judged.where("_stays")
    same = lambda other: docs["doc_id"].eqNullSafe(other["_id"]) & (row == other["_row"])
    once = docs.join(several, same(several), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(judged, same(judged), "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the words inside occurrences of benchmark passages."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the name of its kind in brackets for every span of personal data."""
    return redact(docs, fit_personal(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the weights of ``MIX_WEIGHTS``, with texts."""
    return mix(docs, MIX_WEIGHTS, keep_text=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The classifiers and their thresholds are learned, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch() as keep:
            docs = stage_at(path, function(spark, docs, sf_dir))
            keep.append(path)
    return docs
