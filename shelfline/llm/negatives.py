"""Hard negatives from Hilbert-ordered Parquet blocks with zone maps.

Vectors are cut to whole numbers, ordered by label and by their place on a Hilbert curve through
all dimensions, and written as Parquet rows of ``BLOCK_ROWS`` vectors each: a block has one label
and, for every dimension, the least and the largest component (its zone map). For an anchor and a
block, interval arithmetic on the zone map bounds all inner products from both sides. With these
bounds alone

* a block that lies inside a window whole and holds enough rows proves a score that the last
  wanted row reaches at least, and
* a block whose bounds miss a window, or stay under that proof, is not read for it.

The anchors are the queries: they are taken in groups of at most ``ANCHORS_AT_ONCE`` (about; dealt
by a hash of their place), each group is broadcast, searched against the blocks it needs and its
rows are written before the next group comes, so neither the driver nor a task ever holds more
than one group. A task keeps the best few rows per window; the merge of the tasks is a
window function over at most that many rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.lineage import fresh_path, stage
from shelfline.llm.common import release, ship
from shelfline.operators.reshape import shuffle_partitions

#: Vectors of a block, vectors of a part (a folder of blocks), anchors that are searched together.
BLOCK_ROWS, PART_ROWS, ANCHORS_AT_ONCE = 256, 1 << 18, 1 << 14
#: Bits of a dimension in the Hilbert key: its cells are cut at the mean and about 0.67 deviations.
KEY_BITS = 2
#: Whole components are held to this size, so that sums of products fit 64 bits up to 2,048 dimensions.
LARGEST = 1 << 26
#: Scores (windows x rows) that a task holds at once, and rows multiplied together.
CELLS, TILE_ROWS = 1 << 21, 1024
#: Stands for a null id, which comes after all others.
NO_ID = np.iinfo(np.int64).max

ANCHOR_KIND = "anchor_id bigint, label bigint, block bigint, place int, vector binary"
BLOCK_KIND = "part int, block bigint, label bigint, n int, lo array<int>, hi array<int>, ids array<bigint>, vectors binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits, as rows of bytes that sort alike."""
    x = np.array(cells, np.int64, ndmin=2)
    dims = x.shape[1]
    side = 1 << (bits - 1)
    while side > 1:
        low = side - 1
        for i in range(dims):
            flip = (x[:, i] & side) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap if i else 0
        side >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    side = 1 << (bits - 1)
    while side > 1:
        turn ^= np.where(x[:, -1] & side, side - 1, 0)
        side >>= 1
    x ^= turn[:, None]
    levels = [((x >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(levels, axis=1), axis=1)


def whole_vectors(vectors: pa.Array, scale: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of the usable vectors, padded with zeros to ``width``; and which rows are usable."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (wrong[ends[1:]] == wrong[ends[:-1]]) & ~np.asarray(vectors.is_null())
    starts, lengths = ends[:-1][good], np.diff(ends)[good]
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(starts), width), np.int32)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        part = values[starts[rows][:, None] + np.arange(length)]
        out[rows, :length] = np.clip(np.floor(scale * part), -LARGEST, LARGEST)
    return out, good


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as doubles where they hold them and as 64-bit numbers otherwise."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def score_bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any vector between lo and hi of each block."""
    plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(plus, lo) + products(minus, hi), products(plus, hi) + products(minus, lo)


@dataclass
class Blocks:
    """The written candidate blocks."""

    table: DataFrame
    anchors: DataFrame
    width: int
    rows: int
    groups: int


def write_blocks(vectors: DataFrame, scale: float = 256.0, block_rows: int = BLOCK_ROWS, at_once: int = ANCHORS_AT_ONCE) -> Blocks:
    """Write the blocks of ``vectors`` (id bigint, label bigint, vector array<double>, is_anchor boolean)."""
    spark = vectors.sparkSession
    ship(spark)
    usable = vectors.where("label IS NOT NULL AND vector IS NOT NULL")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 0))
        rows = anchors = 0
        for batch in batches:
            q, good = whole_vectors(batch.column("vector"), scale)
            if q.shape[1] > total.shape[1]:
                total = np.pad(total, ((0, 0), (0, q.shape[1] - total.shape[1])))
            total[0, : q.shape[1]] += q.sum(0)
            total[1, : q.shape[1]] += (q.astype(np.float64) ** 2).sum(0)
            rows += len(q)
            anchors += int(np.asarray(batch.column("is_anchor").fill_null(False))[good].sum())
        dims = np.arange(-1, total.shape[1])
        first, second = np.append(rows, total[0]).astype(float), np.append(anchors, total[1]).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(first), pa.array(second)], ["dim", "a", "b"])

    # One row per dimension.
    found = usable.select("vector", "is_anchor").mapInArrow(sums, "dim int, a double, b double").groupBy("dim")
    found = {r.dim: (r.a, r.b) for r in found.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    rows, n_anchors = (int(x) for x in found.pop(-1, (0, 0)))
    width = len(found)
    mean = np.array([found[i][0] for i in range(width)]) / max(1, rows)
    spread = np.sqrt(np.maximum(np.array([found[i][1] for i in range(width)]) / max(1, rows) - mean**2, 0))
    turn = np.argsort(-spread, kind="stable")  # the widest dimensions cut first

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, good = whole_vectors(batch.column("vector"), scale, width)
            far = (q - mean) / np.where(spread > 0, spread, 1)
            cells = (far > 0) * 2 + np.where(far > 0, far > 0.67, far > -0.67)
            keys = hilbert_keys(cells[:, turn], KEY_BITS) if width and len(q) else np.zeros((len(q), 1), np.uint8)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column("id"), kept.column("label"), kept.column("is_anchor"),
                    pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([v.tobytes() for v in q], pa.binary()),
                ],
                ["id", "label", "is_anchor", "key", "vector"],
            )

    order = ["label", "key", "id", "spread"]
    parts = max(shuffle_partitions(vectors), -(-rows // PART_ROWS))
    placed = usable.select("id", "label", "vector", "is_anchor").mapInArrow(keyed, "id bigint, label bigint, is_anchor boolean, key binary, vector binary")
    # Equal vectors and equal ids must be able to part: the row's own number comes last.
    placed = placed.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def block(piece: pa.Table) -> pa.RecordBatch:
            nonlocal number
            q = np.frombuffer(b"".join(piece["vector"].to_pylist()), np.int32).reshape(piece.num_rows, width)
            anchor = np.asarray(piece["is_anchor"].fill_null(False).combine_chunks())
            columns = {
                "part": [part], "block": [(part << 32) | number], "label": [piece["label"][0].as_py()], "n": [piece.num_rows],
                "lo": [q.min(0).tolist()], "hi": [q.max(0).tolist()], "ids": [piece["id"].to_pylist()], "vectors": [q.tobytes()],
                "places": [np.flatnonzero(anchor).tolist()],
            }
            number += 1
            return pa.RecordBatch.from_pydict(columns, schema=kind)

        def cut(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            label = np.asarray(table["label"].combine_chunks()) if len(table) else np.zeros(0, np.int64)
            borders = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)] if len(label) else [0]
            at = 0
            for start, end in zip(borders, borders[1:]):
                for at in range(start, end, block_rows):
                    size = min(block_rows, end - at)
                    if size < block_rows and end == len(label) and not everything:
                        break
                    yield block(table.slice(at, size))
                    at += size
            held = table.slice(at).to_batches() if len(label) else []

        kind = pa.schema(
            [("part", pa.int32()), ("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("lo", pa.list_(pa.int32())),
             ("hi", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("places", pa.list_(pa.int32()))]
        )
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 16 * block_rows:
                    yield from cut(False)
        if held:
            yield from cut(True)

    blocks = stage(placed.mapInArrow(packed, BLOCK_KIND + ", places array<int>"), "negatives-blocks", by=["part"])
    groups = max(1, -(-n_anchors // at_once))
    of = blocks.where("size(places) > 0").select("*", F.explode("places").alias("place"))
    size = 4 * width
    anchors = of.select(
        F.get("ids", "place").alias("anchor_id"), "label", "block", "place",
        F.expr(f"substring(vectors, place * {size} + 1, {size})").alias("vector"),
        F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int").alias("part"),
    )
    return Blocks(blocks.drop("places"), stage(anchors, "negatives-anchors", by=["part"]), width, rows, groups if n_anchors else 0)


@dataclass
class Windows:
    """Searches of a group of anchors: the best ``k`` rows with low <= score <= high, of the anchor's label or of all others."""

    vectors: np.ndarray
    label: np.ndarray
    block: np.ndarray
    place: np.ndarray
    anchor: np.ndarray  # of each window
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def wanted(self, zones: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of every (window, block), and whether the block's label is one the window wants."""
        lower, upper = score_bounds(self.vectors, zones["lo"], zones["hi"])
        fits = (self.label[:, None] == zones["label"][None]) == self.same
        return lower, upper, fits

    def slices(self, blocks: int) -> Iterator[np.ndarray]:
        step = max(1, CELLS // max(1, blocks))
        for start in range(0, len(self.anchor), step):
            yield np.arange(start, min(start + step, len(self.anchor)))

    def proofs(self, zones: dict[str, np.ndarray]) -> np.ndarray:
        """Per window, the best score that k rows of one of these blocks surely reach; the window's low end if none proves more."""
        out = self.low.copy()
        lower, upper, fits = self.wanted(zones)
        for w in self.slices(len(zones["n"])):
            a = self.anchor[w]
            n = zones["n"][None] - ((zones["block"][None] == self.block[a][:, None]) & self.same)
            sure = fits[a] & (n >= self.k) & (lower[a] >= self.low[w][:, None]) & (upper[a] <= self.high[w][:, None])
            out[w] = np.maximum(out[w], np.where(sure, lower[a], self.low[w][:, None]).max(1, initial=np.iinfo(np.int64).min))
        return out

    def needs(self, zones: dict[str, np.ndarray]) -> np.ndarray:
        """(anchor, block): some window of the anchor may have a row in the block."""
        out = np.zeros((len(self.vectors), len(zones["n"])), bool)
        lower, upper, fits = self.wanted(zones)
        for w in self.slices(len(zones["n"])):
            a = self.anchor[w]
            np.logical_or.at(out, a, fits[a] & (upper[a] >= self.low[w][:, None]) & (lower[a] <= self.high[w][:, None]))
        return out


def _zones(batch: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    n = batch.num_rows
    matrix = lambda c: np.asarray(batch.column(c).flatten()).reshape(n, width)
    return {"lo": matrix("lo"), "hi": matrix("hi")} | {c: np.asarray(batch.column(c)) for c in ("label", "n", "block")}


class Best:
    """The best k (score, id) of every window so far."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.floor = windows.low.copy()
        self.at = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score, ids = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.windows.k
        last = rank == self.windows.k - 1
        self.floor[at[last]] = score[last]
        self.at, self.score, self.id = at[kept], score[kept], ids[kept]

    def scan(self, zones: dict[str, np.ndarray], vectors: np.ndarray, ids: np.ndarray) -> None:
        """Score the vectors of a few blocks (end to end) for the anchors that need one of them."""
        w = self.windows
        used = np.flatnonzero(w.needs(zones).any(1))
        if not len(used):
            return
        label, block = np.repeat(zones["label"], zones["n"]), np.repeat(zones["block"], zones["n"])
        place = np.arange(len(block)) - np.repeat(np.cumsum(zones["n"]) - zones["n"], zones["n"])
        per = max(1, len(w.anchor) // max(1, len(w.vectors)))
        step = max(1, CELLS // (per * len(ids)))
        window_of = np.argsort(w.anchor, kind="stable")
        sorted_anchor = w.anchor[window_of]
        for start in range(0, len(used), step):
            a = used[start : start + step]
            score = products(w.vectors[a], vectors)
            off = (w.label[a][:, None] == label[None]) != w.same
            if w.same:
                off |= (w.block[a][:, None] == block[None]) & (w.place[a][:, None] == place[None])
            first, last = np.searchsorted(sorted_anchor, a), np.searchsorted(sorted_anchor, a, side="right")
            own = np.repeat(np.arange(len(a)), last - first)
            k = window_of[np.concatenate([np.arange(f, t) for f, t in zip(first, last)])]
            lowest = np.iinfo(np.int64).min
            cells = np.where(off, lowest, score)[own]
            cells[(cells < self.floor[k][:, None]) | (cells > w.high[k][:, None])] = lowest
            if cells.shape[1] > w.k:
                worst = np.partition(cells, cells.shape[1] - w.k, axis=1)[:, cells.shape[1] - w.k]
                cells[cells < worst[:, None]] = lowest
            at, column = np.nonzero(cells != lowest)
            if len(at):
                self.add(k[at], cells[at, column], ids[column])


def search(blocks: Blocks, windows: Windows) -> DataFrame:
    """(window, score, id): the best rows of each window, after zone maps have chosen the blocks to read."""
    spark = blocks.table.sparkSession
    width = blocks.width
    zones = blocks.table.select("part", "block", "label", "n", "lo", "hi")
    sent = spark.sparkContext.broadcast(windows)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = sent.value.low.copy()
        for batch in batches:
            if batch.num_rows:
                best = np.maximum(best, sent.value.proofs(_zones(batch, width)))
        more = np.flatnonzero(best > sent.value.low)
        yield pa.RecordBatch.from_arrays([pa.array(more, pa.int32()), pa.array(best[more], pa.int64())], ["window", "score"])

    proven = zones.mapInArrow(prove, "window int, score bigint").groupBy("window").agg(F.max("score").alias("score")).toArrow()
    windows.low[proven["window"].to_numpy()] = proven["score"].to_numpy()
    sent.unpersist()
    sent = spark.sparkContext.broadcast(windows)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                needed = sent.value.needs(_zones(batch, width)).any(0)
                yield batch.select(["part", "block"]).filter(pa.array(needed))

    reads = stage(zones.mapInArrow(choose, "part int, block bigint"), "negatives-reads")
    # One row per part; parts hold PART_ROWS vectors, and folders without a needed block are not opened.
    parts = [r.part for r in reads.select("part").distinct().collect()]
    chosen = blocks.table.where(F.col("part").isin(parts)).join(reads, ["part", "block"], "left_semi")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value)
        for batch in batches:
            step = max(1, TILE_ROWS // BLOCK_ROWS)
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                ids = piece.column("ids").flatten().fill_null(NO_ID).to_numpy()
                vectors = np.frombuffer(b"".join(piece.column("vectors").to_pylist()), np.int32).reshape(len(ids), width)
                best.scan(_zones(piece, width), vectors, ids)
        release()
        ids = pa.array(best.id, pa.int64(), mask=best.id == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.at, pa.int32()), pa.array(best.score, pa.int64()), ids], ["window", "score", "id"])

    found = chosen.select("part", "block", "label", "n", "lo", "hi", "ids", "vectors").mapInArrow(score, "window int, score bigint, id bigint")
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def mine_negatives(
    table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = 256.0, key: str | Column = "vec_id", label: str | Column = "label", vector: str | Column = "embedding",
    block_rows: int = BLOCK_ROWS, at_once: int = ANCHORS_AT_ONCE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    A component counts as floor(scale * component), a score is the inner product of two rows.
    Positives of an anchor are its best ``positives`` other rows of the same label; for each of
    them the best ``negatives`` rows of other labels follow whose score lies between ``low`` and
    ``high`` percent of the positive's. Equal scores go by smaller key; a null key comes last.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Rows
    are told apart by their place, so a repeated row is another row, and a repeated anchor has its
    own (equal) result. A shorter vector counts as padded with zeros; whole components beyond
    ``LARGEST`` are cut to it. Labels and keys are taken as bigint. Other columns are ignored,
    whatever their names. Without anchors, or for an empty table, the result is empty.
    """
    spark = table.sparkSession
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = table.select(
        column(key).cast("bigint").alias("id"), column(label).cast("bigint").alias("label"),
        column(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    blocks = write_blocks(rows, scale, block_rows, at_once)
    path = fresh_path(spark, "negatives")
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], kind).write.parquet(f"{path}/group=-1")
    for group in range(blocks.groups):
        # About ``at_once`` anchors, whatever the size of the table.
        own = blocks.anchors.where(F.col("part") == group).drop("part").toArrow()
        if not own.num_rows:
            continue
        ids = own["anchor_id"].to_pylist()
        vectors = np.frombuffer(b"".join(own["vector"].to_pylist()), np.int32).reshape(len(ids), blocks.width)
        about = (vectors, own["label"].to_numpy(), own["block"].to_numpy(), own["place"].to_numpy())
        ends = np.iinfo(np.int64)
        all_of = [np.full(len(ids), x, np.int64) for x in (ends.min + 1, ends.max)]
        best = search(blocks, Windows(*about, np.arange(len(ids)), *all_of, True, positives)).toArrow()
        anchor, score = best["window"].to_numpy(), best["score"].to_numpy()
        bottom, top = -(-low * score // 100), high * score // 100
        some = np.flatnonzero(bottom <= top)
        if not len(some):
            continue
        windows = Windows(*about, anchor[some].astype(np.int64), bottom[some], top[some], False, negatives)
        # A row per window of the group, joined to its hits.
        names = pa.table(
            {
                "window": pa.array(np.arange(len(some)), pa.int32()),
                "anchor_id": pa.array([ids[i] for i in anchor[some]], pa.int64()),
                "positive_id": best["id"].take(pa.array(some)),
                "positive_score": pa.array(score[some], pa.int64()),
            }
        )
        hits = search(blocks, windows).join(F.broadcast(spark.createDataFrame(names)), "window")
        hits = hits.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        hits.write.parquet(f"{path}/group={group}")
    return spark.read.schema(f"{kind}, group int").parquet(path).drop("group")
