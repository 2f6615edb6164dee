"""The prefix trie of conversations, with totals of all subtrees by centroid decomposition.

A turn is known by a digest of its role and text, and a prefix by the exclusive or of 128-bit
hashes of its (position, digest) pairs, so prefixes are running totals: rows are range-partitioned
in order, each task totals its own rows, and what a conversation brings along from earlier tasks is
added. No conversation has to fit a task. Equal conversations go on as one of them, with their number.

Subtree totals come from the parent edges. A component of the forest has a node below which at
least half of its weight lies while no child of it has that much: its centroid. Taking it out leaves
a component per child and one above it, none heavier than half. What lies below the centroid is
added up by component and added to all nodes from the centroid up to the component's top; the
components then go on by themselves, so every node meets every ancestor once, after at most as many
rounds as the weight has binary digits, however deep or wide the trie is. Weight is the number of
distinct conversations through a node, of which the grouping that makes the nodes knows the sums.
Rounds are Spark jobs over all large components at once; components below a limit are dealt
out to tasks, which do the same rounds on arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from shelfline.lineage import stage
from shelfline.llm.common import ship
from shelfline.operators.reshape import shuffle_partitions

#: Weight up to which a component is left to a task, and most rows of a table of components that is broadcast.
SMALL, MOST_BROADCAST = 20_000, 100_000
#: Keys that are joined to one text at once.
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def running(rows: DataFrame, key: str, order: list[Column], label: str) -> DataFrame:
    """``rows`` (with bigint columns a and b) with their place 1, 2, ... in ``key`` along ``order``, and a and b as running exclusive ors.

    ``order`` goes on from the key's order and must tell all rows apart, so that one key can go to many tasks.
    """
    ranged = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order)
    columns = rows.columns
    schema = StructType(list(rows.schema.fields)).add("place", LongType()).add("here", LongType()).add("part", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, totals, here = None, 0, [0, 0], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
            place = np.arange(1, n + 1) - first[of]
            sums = [np.bitwise_xor.accumulate(batch.column(c).to_numpy()) for c in "ab"]
            sums = [s ^ np.where(first > 0, s[first - 1], 0)[of] for s in sums]
            if keys[0] == last:
                place[of == 0] += count
                for s, t in zip(sums, totals):
                    s[of == 0] ^= t
            last, count, totals = keys[-1], int(place[-1]), [s[-1] for s in sums]
            new = dict(zip("ab", map(pa.array, sums)))
            old = [new.get(c, batch.column(i)) for i, c in enumerate(columns)]
            more = [pa.array(place), pa.array(np.arange(here, here + n)), pa.array(np.full(n, part, np.int32))]
            here += n
            yield pa.RecordBatch.from_arrays([*old, *more], [*columns, "place", "here", "part"])

    done = stage(ranged.mapInArrow(run, schema), label)
    # A row per part. A key runs over parts only as the last key of all of them but the last one.
    ends = done.groupBy("part").agg(
        F.min_by(key, "here").alias("first"), F.max_by(key, "here").alias("last"), F.max_by(F.struct("place", "a", "b"), "here").alias("to")
    )
    by_part = Window.orderBy("part")
    inside = Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(
        "part", "first", "last", F.sum("to.place").over(inside).alias("place"), *(F.bit_xor(f"to.{c}").over(inside).alias(c) for c in "ab")
    )
    before = F.lag(F.struct("last", "place", "a", "b")).over(by_part)
    ends = ends.select("part", "first", before.alias("before")).where(F.col("before.last") == F.col("first"))
    carried = ends.select(F.col("part"), F.col("first").alias(key), *(F.col(f"before.{c}").alias(f"_{c}") for c in ("place", "a", "b")))
    out = done.join(F.broadcast(carried), ["part", key], "left")
    plus = {"place": F.col("place") + F.coalesce("_place", F.lit(0))} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in "ab"}
    return out.withColumns(plus).select(*columns, "place")


def numbered_turns(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, digest, words): the turns of every conversation in order, numbered from 1.

    A null turn number comes first; turns of one number go by the SHA-256 of role and text. Null roles
    and texts are empty. Rows without key are left out; other columns are ignored, whatever their names.
    """
    ship(table.sparkSession)
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said), 256))
    rows = table.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), F.col(turn).alias("turn"), digest.alias("digest"),
        F.regexp_count(said[1], F.lit(WORD)).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    order = [F.asc("key"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]
    return running(rows, "key", order, "trie-turns").select("key", "place", "digest", "words")


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Give conversations the first turns of another: their rebuilt turns, and all their keys.

    Conversation c takes its first h = crc32(c) % ``most`` turns from conversation c - c % ``every`` (all if
    it has fewer, none if there is none) and goes on with its own turns after its own first h.
    """
    taken = F.expr(f"CAST(crc32(CAST(CAST(key AS STRING) AS BINARY)) % {most} AS BIGINT)")
    base = F.expr(f"key - key % {every}")
    convs = turns.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    convs = convs.select("key", "length", taken.alias("h"), base.alias("base"))
    lengths = convs.where(F.expr(f"key % {every} = 0")).select(F.col("key").alias("base"), F.col("length").alias("base_length"))
    convs = stage(convs.join(lengths, "base", "left").select("key", "h", "base", F.least("h", F.coalesce("base_length", F.lit(0))).alias("head")), "trie-keys")
    heads = turns.where(F.expr(f"key % {every} = 0") & (F.col("place") < most)).withColumnRenamed("key", "base")
    head = convs.join(heads, "base").where("place <= h").select("key", "place", "digest", "words")
    # Only what a head falls short of moves the later turns; h itself follows from the key.
    short = convs.where("head < h").select("key", (F.col("h") - F.col("head")).alias("short"))
    own = turns.where(F.col("place") > taken).join(short, "key", "left")
    own = own.select("key", (F.col("place") - F.coalesce("short", F.lit(0))).alias("place"), "digest", "words")
    return head.unionByName(own), convs.select("key")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of the ascending keys of the conversations that end at a node, comma-joined.

    Sorting and joining is spread over tasks even for one node; only its hash runs over the joined texts in turn.
    """
    order = ["a", "b", "key"]
    ranged = ends.select(*order).repartitionByRange(shuffle_partitions(ends), *order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(start, CHUNK)
                a, b = piece.column("a").to_numpy(), piece.column("b").to_numpy()
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                keys, last = list(map(str, piece.column("key").to_pylist())), [*first[1:], len(a)]
                texts = [",".join(keys[f:t]) for f, t in zip(first, last)]
                place = np.arange(number, number + len(first)) + (part << 40)
                number += len(first)
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(place), pa.array(texts)], ["a", "b", "place", "keys"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total, out = None, None, []
        for batch in batches:
            for a, b, keys in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "keys"))):
                if (a, b) == node:
                    total.update(b",")
                else:
                    if node is not None:
                        out.append((*node, total.hexdigest()))
                    node, total = (a, b), hashlib.sha256()
                total.update(keys.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "ends_sha256"])
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, total.hexdigest())], ["a", "b", "ends_sha256"])

    joined = ranged.mapInArrow(join, "a bigint, b bigint, place bigint, keys string")
    joined = joined.repartition(shuffle_partitions(ends), "a", "b").sortWithinPartitions("a", "b", "place")
    return joined.mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")


class Forest:
    """Components of a forest on arrays, rolled up by centroid decomposition."""

    def __init__(self, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: list[np.ndarray]) -> None:
        """``parent``: -1 for the top of a component; ``weight``: of the whole subtree, larger than its children's together."""
        self.parent, self.depth, self.weight, self.values = parent, depth, weight.copy(), values
        self.width = weight.copy()
        self.top, self.start = self._intervals()

    def _intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """The top of every node's component, and starts such that a subtree is [start, start + width)."""
        n = len(self.parent)
        top, start = np.arange(n), np.zeros(n, np.int64)
        tops = np.flatnonzero(self.parent < 0)
        start[tops] = np.cumsum(self.width[tops]) - self.width[tops]
        # Level by level from the tops: siblings lie side by side, after their parent's own weight.
        order = np.lexsort((self.parent, self.depth))
        order = order[self.parent[order] >= 0]
        within = np.zeros(n, np.int64)
        np.add.at(within, self.parent[order], self.width[order])
        own = self.width - within
        borders = np.flatnonzero(np.append(True, np.diff(self.depth[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        for at, end in zip(borders, np.append(borders[1:], len(order))):
            level = order[at:end]
            above = self.parent[level]
            run = np.cumsum(self.width[level]) - self.width[level]
            first = np.searchsorted(above, above)
            start[level] = start[above] + own[above] + run - run[first]
            top[level] = top[above]
        return top, start

    def totals(self) -> list[np.ndarray]:
        """The sum of each value over the subtree of each node, inside its component."""
        out = [np.zeros(len(self.parent), np.int64) for _ in self.values]
        live, top = np.arange(len(self.parent)), self.top.copy()
        scale = int(self.width[self.parent < 0].sum()) + 1
        z_of = np.zeros(len(self.parent), np.int64)
        while len(live):
            heavy = live[2 * self.weight[live] >= self.weight[top[live]]]
            heavy = heavy[np.lexsort((self.depth[heavy], top[heavy]))]
            last = np.append(top[heavy][1:] != top[heavy][:-1], True)
            centroids = heavy[last]
            tops = top[centroids]
            z_of[tops] = centroids
            z = z_of[top[live]]
            below = (self.start[live] >= self.start[z]) & (self.start[live] < self.start[z] + self.width[z])
            sums = []
            for v in self.values:
                total = np.zeros(len(self.parent), np.int64)
                np.add.at(total, top[live[below]], v[live[below]])
                sums.append(total[tops])
            # From the centroids to the tops, all components a step at a time.
            at, to, lost = centroids, tops, self.weight[centroids]
            first = True
            while len(at):
                for o, s in zip(out, sums):
                    o[at] += s
                if not first:
                    self.weight[at] -= lost
                on = at != to
                at, to, lost, sums, first = self.parent[at[on]], to[on], lost[on], [s[on] for s in sums], False
            # Below a centroid, the child above a node is its new top.
            inside = live[below & (live != z)]
            if len(inside):
                child = inside[self.parent[inside] == z_of[top[inside]]]
                keys = top[child] * scale + self.start[child]
                order = np.argsort(keys)
                found = np.searchsorted(keys[order], top[inside] * scale + self.start[inside], side="right") - 1
                renamed = child[order][found]
                top[inside] = renamed
            live = live[live != z]
        return out


def _fold(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def roll_up(nodes: DataFrame, paths: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """(a, b, values): sums of ``values`` over the subtree of every node.

    ``nodes``: a row per node (a, b, pa, pb, depth, key, w, values), where key is a conversation
    through the node and w the subtree's weight. ``paths``: a row per node of each of these
    conversations (key, depth, a, b, pa, pb).
    """
    spark = nodes.sparkSession
    sums = lambda: [F.sum(v).alias(v) for v in values]
    live = nodes.select("a", "b", "pa", "pb", "depth", "key", "w", *values, F.lit(0).cast("bigint").alias("ca"), F.lit(0).cast("bigint").alias("cb"))
    rest, added = [], []
    while True:
        tops = live.groupBy("ca", "cb").agg(F.max("w").alias("total"), F.min("depth").alias("top_depth")).where(F.col("total") > small)
        # At most total weight / small rows.
        tops = stage(tops, "trie-tops")
        n = tops.count()
        if not n:
            rest.append(live)
            break
        few = n <= MOST_BROADCAST
        inside = live.join(_fold(tops, few), ["ca", "cb"])
        rest.append(live.join(_fold(tops, few), ["ca", "cb"], "left_anti"))
        chosen = F.max_by(F.struct("a", "b", "key", "depth", "w", "top_depth"), "depth").alias("z")
        z = stage(inside.where("2 * w >= total").groupBy("ca", "cb").agg(chosen), "trie-centroids")
        z = z.select("ca", "cb", *(F.col(f"z.{c}").alias(f"z_{c}") for c in ("a", "b", "key", "depth", "w", "top_depth")))
        # The conversations through a centroid, and the child each goes on to.
        on = (F.col("pa") == F.col("z_a")) & (F.col("pb") == F.col("z_b"))
        through = paths.join(_fold(z, few), on).select("key", "ca", "cb", F.col("a").alias("child_a"), F.col("b").alias("child_b"))
        split = inside.join(_fold(z.drop("z_key", "z_w", "z_top_depth"), few), ["ca", "cb"]).join(through, ["key", "ca", "cb"], "left")
        below = F.col("child_a").isNotNull() & (F.col("depth") > F.col("z_depth"))
        is_z = (F.col("a") == F.col("z_a")) & (F.col("b") == F.col("z_b"))
        split = stage(split.withColumns({"below": below, "is_z": is_z}), "trie-split")
        total = split.where("below OR is_z").groupBy("ca", "cb").agg(*sums())
        up = stage(z.join(total, ["ca", "cb"]).select(F.col("z_key").alias("key"), "z_depth", "z_w", "z_top_depth", *values), "trie-totals")
        up = paths.select("key", "depth", "a", "b").join(_fold(up, few), "key").where("depth BETWEEN z_top_depth AND z_depth")
        up = stage(up.select("a", "b", "z_w", *values), "trie-added")
        added.append(up.select("a", "b", *values))
        own = lambda c: F.when(F.col("below"), F.col(f"child_{c}")).otherwise(F.col(f"c{c}")).alias(f"c{c}")
        left = split.where("NOT is_z").join(up.select("a", "b", F.col("z_w").alias("lost")), ["a", "b"], "left")
        w = (F.col("w") - F.coalesce("lost", F.lit(0))).alias("w")
        live = stage(left.select("a", "b", "pa", "pb", "depth", "key", w, *values, own("a"), own("b")), "trie-live")

    leaves = rest[0]
    for r in rest[1:]:
        leaves = leaves.unionByName(r)
    buckets = max(shuffle_partitions(nodes), -(-nodes.count() // small))

    def local(table: pa.Table) -> pa.Table:
        column = lambda c: table[c].to_numpy()
        at = {x: i for i, x in enumerate(zip(table["a"].to_pylist(), table["b"].to_pylist()))}
        above = zip(table["pa"].to_pylist(), table["pb"].to_pylist())
        parent = np.array([at.get(x, -1) for x in above], np.int64)
        # A parent in another component of the bucket is none.
        ca, cb = column("ca"), column("cb")
        parent[(parent >= 0) & ((ca[parent] != ca) | (cb[parent] != cb))] = -1
        found = Forest(parent, column("depth"), column("w"), [column(v) for v in values]).totals()
        return pa.table({"a": table["a"], "b": table["b"], **dict(zip(values, map(pa.array, found)))})

    # Components are dealt out whole: each is at most ``small`` heavy, so a bucket is bounded.
    bucket = F.pmod(F.xxhash64("ca", "cb"), F.lit(buckets)).alias("bucket")
    few = leaves.groupBy(bucket).applyInArrow(local, "a bigint, b bigint, " + ", ".join(f"{v} bigint" for v in values))
    for r in added:
        few = few.unionByName(r)
    ship(spark)
    return few.groupBy("a", "b").agg(*sums())


def prefix_trie(turns: DataFrame, keys: DataFrame, small: int = SMALL) -> DataFrame:
    """A row per distinct prefix of conversations, from the empty one.

    ``turns``: (key, place, digest, words) with places 1, 2, ... in each conversation; ``keys``: all
    conversations (key), those without turns included. Returns conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without
    conversations there is no node, not even the empty prefix.
    """
    ship(turns.sparkSession)
    hashes = {"a": F.xxhash64("place", "digest"), "b": F.xxhash64(F.lit("second"), "digest", "place")}
    rows = turns.withColumns(hashes)
    rows = rows.select("key", F.col("place").alias("depth"), "words", "a", "b", F.col("a").alias("own_a"), F.col("b").alias("own_b"))
    rows = stage(running(rows, "key", [F.asc("key"), F.asc("depth")], "trie-hashes").drop("place"), "trie-prefixes")

    # Where conversations end; equal ones go on as the one with the smallest key.
    ends = rows.groupBy("key").agg(F.max_by(F.struct("a", "b"), "depth").alias("end"), F.max("depth").alias("length"))
    ends = keys.join(ends, "key", "left").select("key", *(F.coalesce(f"end.{c}", F.lit(0)).alias(c) for c in "ab"), F.coalesce("length", F.lit(0)).alias("length"))
    ends = stage(ends, "trie-ends")
    alike = ends.groupBy("a", "b").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.max("length").alias("length"))
    alike = stage(alike.select("key", "copies", "length"), "trie-alike")
    none = F.lit(None).cast("bigint")
    root = alike.select("key", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), *(F.lit(0).cast("bigint").alias(c) for c in "ab"), none.alias("pa"), none.alias("pb"), "copies", "length")
    above = [F.col(c).bitwiseXOR(F.col(f"own_{c}")).alias(f"p{c}") for c in "ab"]
    paths = rows.join(alike, "key").select("key", "depth", "words", "a", "b", *above, "copies", "length").unionByName(root)
    paths = stage(paths, "trie-paths")

    nodes = paths.groupBy("a", "b").agg(
        F.min("key").alias("key"), *(F.max(c).alias(c) for c in ("depth", "words", "pa", "pb")), F.sum("copies").alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("w"),
    )
    nodes = stage(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = stage(nodes, "trie-valued")

    rolled = roll_up(nodes, paths.select("key", "depth", "a", "b", "pa", "pb"), ["n_leaves", "saved_tokens"], small)
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("key").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(rolled, ["a", "b"]).join(_ends_digests(ends), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("key").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
