"""Document quality by hierarchical empirical Bayes.

Three kinds of evidence are combined.

* Words. For each hashed word, the share of flagged documents among the labelled ones that
  hold it, shrunk toward the overall share, is a log-odds; a document is described by its
  strongest words and their mean. The shares are grouped sums over labelled documents.
* Form. Shares of symbols, capitals, repeated words and lines and the like.
* Site. A logistic classifier turns both into a probability. The probabilities are averaged per
  host and per path below it by grouped sums over all documents; a host's rate is shrunk toward
  the global rate, and a path's toward its host's, by beta priors whose strengths come from
  the scatter of the rates (method of moments), so a site with few documents says little. The
  path's posterior replaces the global rate as prior odds of each of its documents.

Two questions are asked in this way: low quality and toxic. A document goes if either
posterior exceeds one half. Words are learned on one half of a bounded sample of the labelled
rows, the classifier on the other; all documents count in the rates of sites.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.llm.common import lower_ascii, segment_hashes, ship, slices, text_view, words_of

#: Labelled rows of the sample, hashed words, pseudo-documents of a word's share, rounds of fitting.
SAMPLE_ROWS, BUCKETS, STRENGTH, ROUNDS = 20_000, 1 << 18, 4.0, 60
QUESTIONS = ("low", "toxic")
#: Bytes of text described at once.
PIECE_BYTES = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BLANK = np.ones(256, bool)
_BLANK[[*range(9, 14), 32]] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!{}[]=_~^@"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Words that a description looks at one by one.
TOP = 3


@dataclass
class Evidence:
    """Log-odds of hashed words per question."""

    odds: np.ndarray  # question x bucket


def _distinct_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the distinct hashed words, by text."""
    starts, ends, first = words_of(raw, offsets, _LETTER)
    bucket = (segment_hashes(lower_ascii(raw), starts, ends) >> np.uint64(20)).astype(np.int64) % BUCKETS
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    both = np.unique(text * BUCKETS + bucket)
    return both % BUCKETS, both // BUCKETS


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def describe(raw: np.ndarray, offsets: np.ndarray, evidence: Evidence) -> np.ndarray:
    """Features of every text: its form, and its strongest words per question."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = words_of(raw, offsets, _BLANK)
    words = np.diff(first).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    code = segment_hashes(raw, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(code), bool)
    if len(code) > 1:
        same[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
    repeated = np.bincount(text, weights=same, minlength=n)
    distinct = np.bincount(np.unique(np.stack([text, code.astype(np.int64)], 1), axis=0)[:, 0], minlength=n) if len(code) else np.zeros(n)
    long = np.bincount(text, weights=(ends - starts) > 24, minlength=n)
    symbols, upper, letters = count(_SYMBOL[raw]), count(_UPPER[raw]), count(_LETTER[raw])
    bars, digits, lines = count(raw == 124), count((raw >= 48) & (raw <= 57)), count(raw == 10)
    # Words that end in a symbol or are one.
    odd = np.bincount(text, weights=_SYMBOL[raw[ends - 1]], minlength=n) if len(code) else np.zeros(n)
    form = [
        np.log1p(words), words < 5, _share(symbols, size), _share(upper, letters), _share(bars, words), _share(digits, size), _share(odd, words),
        _share(repeated, words), _share(distinct, words), _share(distinct, np.sqrt(words)), _share(lines, words), _share(letters, size), _share(size, words), _share(long, words),
        np.log1p(symbols), np.log1p(repeated), np.log1p(bars), _share(odd, words) > 0.3, _share(upper, letters) > 0.5, _share(repeated, words) > 0.3, words == 0,
    ]
    bucket, owner = _distinct_words(raw, offsets)
    counts = np.bincount(owner, minlength=n)
    begin = np.cumsum(counts) - counts
    for odds in evidence.odds:
        own = odds[bucket]
        order = np.lexsort((-own, owner))
        ranked = own[order]
        for k in range(TOP):
            top = np.zeros(n)
            has = counts > k
            top[has] = ranked[begin[has] + k]
            form.append(top)
        form.append(_share(np.bincount(owner, weights=own, minlength=n), counts))
        form.append(np.bincount(owner, weights=own > 1.5, minlength=n))
    return np.stack([np.asarray(x, float) for x in form], 1)


@dataclass
class Model:
    """Word evidence and a logistic classifier per question: intercept, weights, and the share of flagged rows it was fitted on."""

    evidence: Evidence
    parts: list[tuple[float, np.ndarray, float]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(intercept + x @ weights, -30, 30))) for intercept, weights, _ in self.parts]
        return np.clip(np.stack(out, 1), 1e-6, 1 - 1e-6)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model | None:
    """The model from about ``sample`` labelled rows chosen by a hash of doc_id; None where no text is labelled."""
    spark = docs.sparkSession
    ship(spark)
    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    n = labels.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20))
    share = min(1 << 20, -(-(sample << 20) // max(n, 1)))
    flags = flags.where(h < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)
    # The sample is bounded, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(flags), "doc_id").select("text", *(F.coalesce(q, F.lit(0)).alias(q) for q in QUESTIONS), "half")
    rows = stage(rows, "quality-sample")
    totals = rows.where("half").agg(F.count("*"), *(F.sum(q) for q in QUESTIONS)).first()
    if not totals[0] or rows.where("NOT half").isEmpty():
        return None

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            bucket, owner = _distinct_words(*text_view(batch.column("text")))
            flags = [batch.column(q).to_numpy()[owner] for q in QUESTIONS]
            counts = np.bincount(bucket, minlength=BUCKETS)
            some = np.flatnonzero(counts)
            sums = [np.bincount(bucket, weights=f, minlength=BUCKETS)[some].astype(np.int64) for f in flags]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *map(pa.array, sums)], ["bucket", "n", *QUESTIONS])

    found = rows.where("half").mapInArrow(held, "bucket bigint, n bigint, low bigint, toxic bigint")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n"), *(F.sum(q).alias(q) for q in QUESTIONS)).toArrow()
    odds = np.zeros((len(QUESTIONS), BUCKETS))
    at, n_docs = found["bucket"].to_numpy(), found["n"].to_numpy()
    for i, q in enumerate(QUESTIONS):
        rate = min(max(totals[i + 1] / totals[0], 1e-4), 1 - 1e-4)
        shrunk = (found[q].to_numpy() + STRENGTH * rate) / (n_docs + STRENGTH)
        odds[i, at] = np.log(shrunk / (1 - shrunk)) - np.log(rate / (1 - rate))
    evidence = Evidence(odds)
    shared = spark.sparkContext.broadcast(evidence)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE_BYTES):
            x = describe(*text_view(batch.column("text")), shared.value)
            lists = pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(q) for q in QUESTIONS)], ["x", *QUESTIONS])

    training = stage(rows.where("NOT half").mapInArrow(features, "x array<double>, low int, toxic int"), "quality-features")
    # Only the driver fits: workers do not load the library for it.
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    training = training.withColumn("features", array_to_vector("x")).coalesce(4)
    parts = []
    for q in QUESTIONS:
        rate = training.agg(F.avg(q)).first()[0]
        if rate in (0.0, 1.0):
            width = len(training.first()["x"])
            parts.append((30.0 if rate else -30.0, np.zeros(width), min(max(rate, 1e-4), 1 - 1e-4)))
            continue
        model = LogisticRegression(labelCol=q, maxIter=ROUNDS, regParam=1e-3).fit(training.select("features", q))
        parts.append((float(model.intercept), model.coefficients.toArray(), float(rate)))
    return Model(evidence, parts)


def _strength(mean: float | None, scatter: float | None, noise: float | None) -> float:
    """Pseudo-documents of a beta prior, from the scatter of rates beyond that of sampling; 1e6 where rates scatter no more."""
    if mean is None or scatter is None or not 0 < mean < 1:
        return 1e6
    extra = scatter - (noise or 0.0)
    return min(1e6, max(1.0, mean * (1 - mean) / extra - 1)) if extra > 0 else 1e6


def site_rates(scores: DataFrame, question: str) -> DataFrame:
    """(host, path, <q>_host, <q>_path): shrunken rates from grouped sums of the scores."""
    paths = scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(question).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    of = lambda n, s, mean: (F.avg(s / n), F.var_pop(s / n), F.avg(mean * (1 - mean) / n))
    total = hosts.agg(F.sum("hs") / F.sum("hn")).first()[0]
    mean = 0.5 if total is None else float(total)
    _, scatter, noise = hosts.agg(*of(F.col("hn"), F.col("hs"), F.lit(mean))).first()
    k = _strength(mean, scatter, noise)
    hosts = hosts.withColumn("hr", (F.col("hs") + F.lit(k * mean)) / (F.col("hn") + F.lit(k)))
    both = paths.join(hosts.select(F.col("host").alias("h"), "hr"), F.col("host").eqNullSafe(F.col("h")))
    apart = F.col("s") / F.col("n") - F.col("hr")
    scatter, noise = both.agg(F.avg(apart * apart), F.avg(F.col("hr") * (1 - F.col("hr")) / F.col("n"))).first()
    k = _strength(mean, scatter, noise)
    rate = (F.col("s") + k * F.col("hr")) / (F.col("n") + k)
    return both.select("host", "path", F.col("hr").alias(f"{question}_host"), rate.alias(f"{question}_path"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def assess(docs: DataFrame, model: Model | None, host: str = "source", path: str = "lang", key: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """(key, row, low_doc, low_path, low_score, toxic_doc, toxic_path, toxic_score, keep) per row.

    ``_doc`` is the classifier's probability, ``_path`` the shrunken rate of the path, ``_score``
    the posterior. Without a model nothing is known: all scores are 0 and every row is kept. A
    null or empty text is judged by its form like any other. Null hosts and paths are sites of
    their own. Rows are judged one by one, whatever their keys; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind, host_kind, path_kind = (docs.schema[c].dataType.simpleString() for c in (key, host, path))
    rows = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "text", PIECE_BYTES):
            if model is None:
                p = np.zeros((batch.num_rows, len(QUESTIONS)))
            else:
                raw, offsets = text_view(batch.column("text"))
                p = model.probability(describe(raw, offsets, model.evidence))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "host", "path", "row")), *(pa.array(p[:, i]) for i in range(len(QUESTIONS)))], ["key", "host", "path", "row", *QUESTIONS]
            )

    scores = stage(rows.mapInArrow(run, f"key {kind}, host {host_kind}, path {path_kind}, row bigint, low double, toxic double"), "quality-scores")
    out = scores
    if model is not None:
        for q, (_, _, fitted) in zip(QUESTIONS, model.parts):
            rates = site_rates(scores, q).select(F.col("host").alias("h"), F.col("path").alias("p"), f"{q}_path")
            out = out.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left").drop("h", "p")
            odds = _logit(F.col(q)) + _logit(F.least(F.greatest(F.col(f"{q}_path"), F.lit(1e-6)), F.lit(1 - 1e-6))) - float(np.log(fitted / (1 - fitted)))
            out = out.withColumn(f"{q}_score", 1 / (1 + F.exp(-odds)))
    else:
        for q in QUESTIONS:
            out = out.withColumn(f"{q}_path", F.lit(0.0)).withColumn(f"{q}_score", F.lit(0.0))
    columns = [c for q in QUESTIONS for c in (F.col(q).alias(f"{q}_doc"), f"{q}_path", f"{q}_score")]
    keep = F.greatest(*(f"{q}_score" for q in QUESTIONS)) <= limit
    return out.select(F.col("key").alias(key), "row", *columns, keep.alias("keep"))
