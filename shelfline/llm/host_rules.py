"""Quality rules with verdicts on hosts: counts per text, failures per host, shrunken rates, join back.

DataFrame expressions only. The counts of a text are array expressions on its words; nothing
is exploded and no text is shuffled. Repeated word triples are found by sorting one long per
triple that holds part of its hash and its position; the few whose neighbours agree are then
compared by their whole hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import stage

#: Characters that count as symbols, and the white space between words; fixed values.
SYMBOLS, BLANKS = r"[#*$%&|<>]", r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def _repeat_positions() -> Column:
    """Sorted positions of the three-word windows whose hash another window of the text has too."""
    hashed = F.expr("""
        filter(_packed, (x, k) -> (k > 0 AND shiftright(x, _bits) = shiftright(_packed[k - 1], _bits))
            OR (k + 1 < size(_packed) AND shiftright(x, _bits) = shiftright(_packed[k + 1], _bits)))""")
    return hashed


def rule_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", BLANKS), ""))
    rows = rows.withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_bits", F.when(F.col("_n") < 1 << 24, 24).otherwise(32))
    rows = rows.withColumn(
        "_triples",
        F.expr("IF(_n < 4, array(), transform(sequence(0, _n - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))").cast("array<bigint>"),
    )
    rows = rows.select(
        *keep,
        F.col("_n").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        "_triples",
        "_bits",
    )
    rows = rows.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "_triples", "_bits",
        (F.size(F.array_distinct("_triples")) < F.size("_triples")).alias("_some"),
    )
    packed = F.expr("IF(_some, sort_array(transform(_triples, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | CAST(i AS BIGINT))), array())")
    rows = rows.withColumn("_packed", packed.cast("array<bigint>"))
    rows = rows.withColumn("_near", _repeat_positions())
    # Whole hashes decide; windows of equal hash stand side by side.
    exact = F.expr("IF(size(_near) = 0, array(), array_sort(transform(_near, x -> struct(_triples[CAST(x & (shiftleft(1L, _bits) - 1) AS INT)] AS h, CAST(x & (shiftleft(1L, _bits) - 1) AS INT) AS i))))")
    rows = rows.withColumn("_exact", exact.cast("array<struct<h:bigint,i:int>>"))
    places = F.expr("""
        sort_array(transform(filter(_exact, (x, k) -> (k > 0 AND x.h = _exact[k - 1].h)
            OR (k + 1 < size(_exact) AND x.h = _exact[k + 1].h)), x -> x.i))""")
    rows = rows.withColumn("_places", places)
    # A window covers three words, less those that the window before has covered.
    covered = F.expr("aggregate(_places, struct(0L AS n, -3 AS last), (s, p) -> struct(s.n + least(3, p - s.last) AS n, p AS last), s -> s.n)")
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def host_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, host_rate (shrunken) and kept.

    A text fails with fewer than 50 words, or with more than half of its words in repeated
    three-word windows. A host's rate of failures is shrunk toward a beta prior whose mean and
    strength come from the rates of all hosts (method of moments; where rates do not vary, the
    strength is 1e6). A host whose shrunken rate exceeds ``max_rate`` loses all its documents.

    A null text has no words and fails. A null host is a host of its own. Repeated rows count
    each; equal and null keys do not matter. Other columns are ignored. Empty gives empty.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("_raw"))
    counts = rule_counts(rows, ["_key", "_host"], "_raw")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = stage(counts.withColumn("base_failed", failed), "rule-counts")
    hosts = counts.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("f"))
    hosts = hosts.withColumn("rate", F.col("f") / F.col("n"))
    prior = hosts.agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"))
    m, v = prior.first()
    k = max(1.0, m * (1 - m) / v - 1) if v else 1e6
    mean = F.lit(m).cast("double")
    verdicts = hosts.select(F.col("_host").alias("_judged"), ((F.col("f") + mean * k) / (F.col("n") + k)).alias("host_rate"))
    joined = counts.join(verdicts, F.col("_host").eqNullSafe(F.col("_judged")), "left")
    return joined.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"), "host_rate",
    )
