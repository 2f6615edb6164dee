"""Language identification by prediction by partial matching.

For each language a tree of byte contexts (orders 0 to 3) holds how often each byte followed.
A byte costs its code length at the longest context that has seen it: escapes to shorter
contexts are paid for (method C: the number of different followers against all), and below
order 0 all bytes are equal. Contexts with few followers are cut, so the order varies. The
statistics are frozen after training; the trees of all languages are then compiled to one
table: context by byte to the code length in every language, in 1/1024 bit, so that sums are
whole numbers and exact. A text's language is the one with the shortest code.

Training counts are grouped sums over a bounded sample; scoring leaves documents in their
partitions. The compiled table has at most ``TABLE_CELLS`` cells: contexts are cut until it
fits, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.llm.common import drawn, ranges, ship, slices, text_view

#: Documents of the training sample per language, cells of the compiled table, units of a bit.
SAMPLE_DOCS, TABLE_CELLS, UNIT = 1500, 16 << 20, 1024
#: Followers below which a context is cut at first.
LEAST = 8
UNKNOWN = "und"


@dataclass
class Trees:
    """The compiled context trees of all languages."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; 0 is the front of a text
    states: np.ndarray  # three symbols -> state
    cost: np.ndarray  # state x symbol x language -> code length in units
    count: int  # symbols

    def lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text in every language, in units."""
        sizes = np.diff(offsets)
        n, a = len(sizes), self.count
        padded = np.zeros(len(raw) + 3 * n + 3, np.int64)
        begin = offsets[:-1] + 3 * np.arange(1, n + 1)
        where = ranges(begin, sizes)
        padded[where] = self.symbol[raw]
        state = self.states[(padded[where - 3] * a + padded[where - 2]) * a + padded[where - 1]]
        rows = self.cost[state.astype(np.int64) * a + padded[where]]
        out = np.zeros((n, len(self.languages)), np.int64)
        some = np.flatnonzero(sizes > 0)
        if len(some):
            out[some] = np.add.reduceat(rows, offsets[:-1][some], axis=0, dtype=np.int64)
        return out


def compile_trees(languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray, cells: int = TABLE_CELLS) -> Trees:
    """From counts of (language, three bytes and the next one); bytes are shifted by one, 0 being the front of a text."""
    parts = np.stack([grams // 257**k % 257 for k in (3, 2, 1, 0)], 1)
    seen = np.unique(parts[:, 3])
    a = len(seen) + 2  # the front, the seen bytes, all others
    to_symbol = np.full(257, a - 1, np.int64)
    to_symbol[0] = 0
    to_symbol[seen] = np.arange(1, len(seen) + 1)
    symbols = to_symbol[parts]
    least = LEAST
    while True:
        contexts: list[np.ndarray] = []
        for order in (1, 2, 3):
            code = np.zeros(len(symbols), np.int64)
            for k in range(3 - order, 3):
                code = code * a + symbols[:, k]
            pairs, inverse = np.unique(np.stack([language, code], 1), axis=0, return_inverse=True)
            total = np.bincount(inverse.ravel(), weights=counts)
            contexts.append(np.unique(pairs[total >= least, 1]))
        n_states = 1 + sum(map(len, contexts))
        if n_states * a * len(languages) <= cells:
            break
        least *= 2
    states = np.zeros((a, a, a), np.int32)
    first = 1
    for order, kept in zip((1, 2, 3), contexts):
        number = np.arange(first, first + len(kept), dtype=np.int32)
        if order == 1:
            states[:, :, kept] = number
        elif order == 2:
            states[:, kept // a, kept % a] = number
        else:
            states[kept // (a * a), kept // a % a, kept % a] = number
        first += len(kept)
    bits = np.empty((n_states, a, len(languages)))
    # The rare symbol stands for all bytes that training has not met.
    uniform = np.full(a, 8.0)
    for which in range(len(languages)):
        own = language == which
        syms, n = symbols[own], counts[own]
        first = 0
        for order, kept in zip((0, 1, 2, 3), [np.zeros(1, np.int64), *contexts]):
            code = np.zeros(len(syms), np.int64)
            for k in range(3 - order, 3):
                code = code * a + syms[:, k]
            if order == 0:
                parent = uniform[None, :]
            elif order == 1:
                parent = np.broadcast_to(bits[0, :, which], (len(kept), a))
            else:
                # The context without its oldest byte: its state, if kept, else one that is shorter still.
                short = kept % a ** (order - 1)
                up = states[0, 0, short] if order == 2 else states[0, short // a, short % a]
                parent = bits[up, :, which]
            table = np.zeros((len(kept), a))
            at = np.searchsorted(kept, code)
            fits = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == code) if len(kept) else np.zeros(len(code), bool)
            np.add.at(table, (at[fits], syms[fits, 3]), n[fits])
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                own_bits = -np.log2(table / (total + kinds))
                escaped = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0) + parent
            bits[first : first + len(kept), :, which] = np.where(table > 0, own_bits, escaped)
            first += len(kept)
    symbol = to_symbol[1:]
    return Trees(languages, symbol, states.ravel(), np.rint(bits * UNIT).astype(np.int32).reshape(n_states * a, len(languages)), a)


def held_out(key: Column) -> Column:
    """Whether a row is never learned from: crc32 of the key as text is divisible by five (a null key counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Trees | None:
    """Trees from about ``sample`` rows per language, chosen by a hash of each row; None where there is nothing to learn from."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.lit(0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1 << 20, -(-(sample << 20) // sizes[name]))).otherwise(share)
    chosen = drawn(rows, share, "key", "text").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names = np.array(batch.column("lang").to_pylist())
            for name in np.unique(names).tolist():
                raw, offsets = text_view(batch.column("text").filter(pa.array(names == name)))
                n = len(offsets) - 1
                padded = np.zeros(len(raw) + 3 * n, np.int64)
                where = ranges(offsets[:-1] + 3 * np.arange(1, n + 1), np.diff(offsets))
                padded[where] = raw.astype(np.int64) + 1
                grams = ((padded[where - 3] * 257 + padded[where - 2]) * 257 + padded[where - 1]) * 257 + padded[where]
                found, counts = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
                )

    table = chosen.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = table.orderBy("lang", "gram").toArrow()
    if not table.num_rows:
        return None
    which = np.searchsorted(np.array(languages), np.array(table["lang"].to_pylist()))
    return compile_trees(languages, which, table["gram"].to_numpy(), table["n"].to_numpy().astype(float))


def identify(docs: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score) per row; the score is the posterior of the language at equal priors.

    A text that is null or has no letter, and any text where nothing was learned, is ``und``
    with score 0. Equal code lengths go to the first language in order of names. Rows are
    treated one by one, whatever their keys; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in slices(batches, "text", 1 << 20):
            raw, offsets = text_view(batch.column("text"))
            names: list[str] = [UNKNOWN] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            if trees is not None:
                lengths = trees.lengths(raw, offsets)
                best = lengths.argmin(1)
                bits = (lengths - lengths.min(1, keepdims=True)) / UNIT
                plain = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
                letters = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
                names = [trees.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
                scores = np.where(letters, 1 / np.exp2(-bits).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held"), pa.array(names, pa.string()), pa.array(scores)], ["key", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
