"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a piece of a partition (bounded bytes of text). Its words become numbers: the rank
of the word in the vocabulary of the test phrases, or one number for all other words. Runs of
known words that are too short for the shortest phrase cannot hold one and are left out; the
rest, with a separator behind each run, is indexed: suffixes are sorted by prefix doubling,
the Burrows-Wheeler column goes into a wavelet matrix with rank counts, and the suffix
positions at run starts and every fourth other one are kept. All phrases are searched backward at
once; occurrences are located by stepping back to a kept position, and the covered words of a
document are the union of its occurrences.

Documents stay in their partition. The phrases are the query set: they are read in blocks of
at most ``BLOCK_BYTES`` of item text (about; items are dealt by a hash), and only one block is on the
driver and broadcast at a time. Where there are several, the rows are written once with a number, the
hits of a block are written before the next block is read, and a grouped job puts the hits of
all blocks together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shelfline.lineage import stage
from shelfline.llm.common import gathered, lower_ascii, ranges, release, segment_hashes, ship, text_view, unused, words_of

#: Words of a window; bytes of item text in one broadcast, of text in a shard; distance of kept suffix positions.
WINDOW, BLOCK_BYTES, SHARD_BYTES, KEPT = 10, 16 << 20, 1 << 20, 4
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Phrases:
    """The distinct windows of a block of items, as numbers of a vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        vocabulary: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str] = []
        for name, text in items:
            lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in _WORD.findall(lowered)]
            if not ids:
                continue
            self.names.append(name)
            for i in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(len(self.names) - 1)
        spelled = [w.encode() for w in vocabulary]
        ends = np.cumsum([0, *map(len, spelled)])
        hashes = segment_hashes(np.frombuffer(b"".join(spelled), np.uint8), ends[:-1], ends[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        #: Numbers from 2: 0 ends a run, 1 is any other word.
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(2, len(order) + 2)
        windows = sorted(owners, key=lambda w: (len(w), w))
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = number[list(w)]
        self.items = [sorted(owners[w]) for w in windows]
        self.size = len(order) + 2

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at + 2, 1) if len(self.hashes) else np.ones(len(hashes), np.int64)


class WaveletMatrix:
    """Symbols below ``size``; rank(symbol, i) counts the symbol among the first i."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, (size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        now = symbols
        for k in reversed(range(self.bits)):
            bit = (now >> k & 1).astype(bool)
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin, end = np.zeros(len(place), np.int64), place
        for k, ones in zip(reversed(range(self.bits)), self.ones):
            bit = (symbol >> k & 1).astype(bool)
            zeros = len(ones) - 1 - int(ones[-1])
            a, b = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin, end = np.where(bit, zeros + a, begin - a), np.where(bit, zeros + b, end - b)
        return end - begin


class FMIndex:
    """Index of a sequence of numbers below ``size`` that ends with 0.

    The zeros end runs and count as different symbols, in the order of their places: so no two
    suffixes are equal, and stepping back from one to the one before it keeps their order.
    """

    def __init__(self, text: np.ndarray, size: int) -> None:
        n, ends = len(text), text == 0
        runs = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + runs)
        span = 1
        order = np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                break
            follow = np.zeros(n, np.int64)
            follow[: n - span] = rank[span:] + 1
            rank = rank * (n + 1) + follow
            order = np.argsort(rank, kind="stable")
            span *= 2
        self.last = text[order - 1]  # the symbol before each suffix; before the first stands the final 0
        self.tree = WaveletMatrix(self.last, size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.kept = (order % KEPT == 0) | (self.last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = order[self.kept]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges of the suffixes that begin with each phrase, all read backward together."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), len(self.last), np.int64)
        for j in reversed(range(words.shape[1])):
            live = np.flatnonzero((lengths > j) & (low < high))
            symbol = words[live, j]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a kept position."""
        out, at, steps = np.empty(len(places), np.int64), places.copy(), np.zeros(len(places), np.int64)
        open_ = np.arange(len(places))
        while len(open_):
            here = self.kept[at[open_]]
            done = open_[here]
            out[done] = self.positions[self.kept_before[at[done]]] + steps[done]
            open_ = open_[~here]
            symbol = self.last[at[open_]]
            at[open_] = self.first[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
        return out


def shard_hits(phrases: Phrases, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a shard (start, end, first word of each text), which are hit, and (text, phrase) pairs that occur."""
    raw = lower_ascii(raw)
    starts, ends, first = words_of(raw, offsets, _WORD_BYTE)
    hit = np.zeros(len(starts), bool)
    none = np.zeros((0, 2), np.int64)
    if not len(starts) or not len(phrases.lengths):
        return starts, ends, first, hit, none
    numbers = phrases.numbers(segment_hashes(raw, starts, ends))
    # Runs of known words inside one text.
    known = np.concatenate([[False], numbers > 1, [False]])
    border = np.zeros(len(numbers) + 1, bool)
    border[first] = True
    opens = np.flatnonzero(known[1:-1] & (~known[:-2] | border[:-1]))
    closes = np.flatnonzero(known[1:-1] & (~known[2:] | border[1:])) + 1
    long = closes - opens >= phrases.lengths.min()
    opens, sizes = opens[long], (closes - opens)[long]
    if not len(opens):
        return starts, ends, first, hit, none
    text = np.insert(numbers[ranges(opens, sizes)], np.cumsum(sizes), 0)
    index = FMIndex(text, phrases.size)
    low, high = index.search(phrases.words, phrases.lengths)
    found = np.repeat(np.arange(len(low)), high - low)
    place = index.locate(ranges(low, high - low))
    # Back to words: run r begins at sum of sizes + r in the indexed text.
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    run = np.searchsorted(begin, place, side="right") - 1
    word = opens[run] + place - begin[run]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[found], -1)
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(np.stack([np.searchsorted(first, word, side="right") - 1, found], 1), axis=0) if len(word) else none
    return starts, ends, first, hit, pairs


def _blocks(benchmark: DataFrame, item: str, text: str) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """The number of blocks, and the items block by block."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // max(1, BLOCK_BYTES // 2)))

    def each() -> Iterator[list[tuple[str, str | None]]]:
        for b in range(blocks):
            part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
            yield [(r.i if r.i is not None else "null", r.t) for r in part.collect()]

    return blocks, each()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, items, spans) per row: words, words inside occurrences, the items that occur, removal spans.

    ``spans`` are merged [start, end) places in UTF-8 bytes of the text, each over neighbouring
    hit words. A null or empty text has no words; an item without words has no window; items
    with a null id are named "null". Repeated items and equal phrases of several items all
    count. Rows of ``docs`` are treated one by one, whatever their keys; other columns are ignored, whatever
    their names. Empty tables give no rows, or no hits.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = _searched(rows, "text", *_blocks(benchmark, item, item_text), window, keep_text=False)
    names = ["n_words", "n_hit", "items", "spans"]
    return found.select(F.col("key").alias(key), *(F.col(c).alias(n) for c, n in zip(_found_names(rows), names)))


#: What is found in a document: words, words that are hit, items, removal spans.
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
_FOUND = [LongType(), LongType(), ArrayType(StringType()), ArrayType(_SPAN)]
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_RUNS_SQL = "array<struct<first:bigint,last:bigint>>"


def _found_names(docs: DataFrame) -> list[str]:
    return unused(docs.columns, "_n", "_hit", "_items", "_spans")


def _searched(docs: DataFrame, text: str, count: int, blocks: Iterator[list[tuple[str, str | None]]], window: int, keep_text: bool) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) and what all blocks of items find, under ``_found_names``."""
    spark = docs.sparkSession
    ship(spark)
    names = [f.name for f in docs.schema if keep_text or f.name != text]
    added = [StructField(n, kind) for n, kind in zip(_found_names(docs), _FOUND)]
    schema = StructType([f for f in docs.schema if f.name in names] + added)
    if count == 1:
        shared = spark.sparkContext.broadcast(next(blocks))
        return docs.mapInArrow(_finder(shared, window, text, names), schema)

    row, runs, items = unused(docs.columns, "_row", "_runs", "_items")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        hits = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).mapInArrow(_hits(shared, window), f"row bigint, items array<string>, runs {_RUNS_SQL}")
        parts.append(stage(hits, "decontaminate-hits"))
        shared.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # As many runs and items as the blocks found in the document.
    merged = every.groupBy(F.col("row").alias(row)).agg(
        F.flatten(F.collect_list("runs")).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items)
    )
    return docs.join(merged, row, "left").mapInArrow(_merger(text, runs, items, names), schema)


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()


def _found(offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hit: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
    """The columns of ``_FOUND`` of a shard."""
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    spans: list[list[dict[str, int]]] = [[] for _ in items]
    for doc in np.flatnonzero(n_hit).tolist():
        a = int(first[doc])
        for s, e in zip(*_runs(hit[a : first[doc + 1]])):
            spans[doc].append({"start": int(starts[a + s] - offsets[doc]), "end": int(ends[a + e - 1] - offsets[doc])})
    kinds = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, kinds[0]), pa.array(spans, kinds[1])]


def _items_of(phrases: Phrases, pairs: np.ndarray, rows: int) -> list[list[str]]:
    items: list[set[str]] = [set() for _ in range(rows)]
    for doc, found in pairs.tolist():
        items[doc].update(phrases.names[i] for i in phrases.items[found])
    return [sorted(x) for x in items]


def _finder(shared, window: int, text: str, names: list[str]):
    """Searches the only block of items; the columns ``names`` are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in gathered(batches, text, SHARD_BYTES):
            raw, offsets = text_view(batch.column(text))
            starts, ends, first, hit, pairs = shard_hits(phrases, raw, offsets)
            found = _found(offsets, starts, ends, first, hit, _items_of(phrases, pairs, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, *(f"found{i}" for i in range(4))])
        release()

    return run


def _hits(shared, window: int):
    """(row, items, runs of hit words) of the rows in which one of several blocks occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for batch in gathered(batches, "text", SHARD_BYTES):
            raw, offsets = text_view(batch.column("text"))
            _, _, first, hit, pairs = shard_hits(phrases, raw, offsets)
            items = _items_of(phrases, pairs, batch.num_rows)
            some = [doc for doc, x in enumerate(items) if x]
            runs = [[{"first": s, "last": e} for s, e in zip(*_runs(hit[first[doc] : first[doc + 1]]))] for doc in some]
            columns = [batch.column("row").take(pa.array(some, pa.int64())), pa.array([items[d] for d in some], pa.list_(pa.string())), pa.array(runs, _RUNS)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "items", "runs"])
        release()

    return run


def _merger(text: str, runs: str, items: str, names: list[str]):
    """Puts the runs of all blocks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text, SHARD_BYTES):
            raw, offsets = text_view(batch.column(text))
            starts, ends, first = words_of(lower_ascii(raw), offsets, _WORD_BYTE)
            hit = np.zeros(len(starts), bool)
            for doc, some in enumerate(batch.column(runs).to_pylist()):
                for x in some or []:
                    hit[first[doc] + x["first"] : first[doc] + x["last"]] = True
            found = _found(offsets, starts, ends, first, hit, [x or [] for x in batch.column(items).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, *(f"found{i}" for i in range(4))])

    return run


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` without the spans that occur in the benchmark; a line break stands for each, other texts stay as they are.

    Null and empty texts stay null and empty; all other columns are passed on, whatever their names. Empty tables
    give no rows, or the rows as they are.
    """
    rows = _searched(docs, text, *_blocks(benchmark, item, item_text), window, keep_text=True)
    spans = _found_names(docs)[3]
    kept = F.expr(f"""
        aggregate(`{spans}`, struct(CAST('' AS BINARY) AS kept, 0L AS at),
          (s, x) -> struct(concat(s.kept, substring(CAST(`{text}` AS BINARY), CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)), CAST('\\n' AS BINARY)) AS kept, x.end AS at),
          s -> concat(s.kept, substring(CAST(`{text}` AS BINARY), CAST(s.at + 1 AS INT))))""")
    cleaned = F.when(F.size(spans) > 0, F.decode(kept, "utf-8")).otherwise(F.col(text))
    return rows.select(*(cleaned.alias(c) if c == text else c for c in docs.columns))
