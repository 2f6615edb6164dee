"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams (by hash) is cut into fragments. A task turns its documents
into sets, collapses what is equal among them, and sends each fragment the n-grams it has
there: an n-gram once per piece of a partition, however many of its documents hold it. A
fragment finds the n-grams that other documents have too and answers with partial counts,
which are summed per document: a document of which less than 80 % is shared links with
nothing. Few documents are left; equal sets become one class; a second round over the classes
gives exact document frequencies, and with them the prefixes in which two linked sets must
meet.

Pairs are formed in two steps, so that a group of a thousand near copies does not become half
a million pairs. First every set meets one leader of each prefix n-gram it has. Then only sets
whose components still differ meet in full, and only if their parity bitmaps, counted fragment by
fragment, leave room for enough overlap; a bitmap bounds the overlap from above, so no link is
lost. Every remaining pair is verified: the overlap of each fragment of the two sets is counted
on its own, and the partial overlaps are summed per pair.

N-grams are told apart by 48 bits and the number of their fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from shelfline.lineage import cut, stage
from shelfline.llm.common import gathered, lower_ascii, mix, ranges, release, segment_hashes, ship, text_view, words_of

#: Words of a shingle, and the similarity of a link in percent.
WORDS, PERCENT = 5, 80
#: Bytes of text per piece and per fragment, and the most fragments; fragments of one verification; longs of a bitmap.
PIECE_BYTES, FRAGMENT_BYTES, MOST_FRAGMENTS, PARTS, LONGS = 3 << 20, 4 << 20, 1 << 16, 8, 16
#: Pairs of a list per set in it; rounds go on while one merges more than such a part of what all have merged.
LEADERS, FEW = 32, 10
#: Edges that one task unites.
FEW_EDGES = 100_000
_MANY = 0xFFFF
#: Stands for a null key.
_NO_KEY = (1 << 63) - 1
_LOW = np.uint64((1 << 48) - 1)
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[*range(9, 14), 32]] = False

_LISTS = pa.list_(pa.int64())
_SENT = pa.schema(
    [("part", pa.int64()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("e", pa.binary())]
    + [(x, _LISTS) for x in ("key", "n", "s", "t")]
)
_SENT_SQL = "part bigint, batch bigint, a binary, b binary, c binary, e binary, key array<bigint>, n array<bigint>, s array<bigint>, t array<bigint>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles, by text and hash; texts are taken in blocks of about ``block`` bytes."""
    parts, at = [], 0
    while at < len(offsets) - 1:
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        hashes, text = _shingles(raw[offsets[at] : offsets[last]], offsets[at : last + 1] - offsets[at], words)
        parts.append((hashes, text + at))
        at = last
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _shingles(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of one block; a text of fewer words is one shingle."""
    raw = lower_ascii(raw)
    starts, ends, first = words_of(raw, offsets, _WORD_BYTE)
    hashes, n = segment_hashes(raw, starts, ends), np.diff(first)
    step = np.uint64(0x9E3779B97F4A7C15)
    place = ranges(first[:-1], np.maximum(n - words + 1, 0))
    out = hashes[place]
    for j in range(1, words):
        out = mix(out * step + hashes[place + j])
    text = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            code = np.array([n[t] + 77], np.uint64)
            for h in hashes[first[t] : first[t + 1]]:
                code = mix(code * step + h)
            whole[i] = code[0]
        out, text = np.concatenate([out, whole]), np.concatenate([text, short])
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    if len(out):
        new = np.append(True, (out[1:] != out[:-1]) | (text[1:] != text[:-1]))
        out, text = out[new], text[new]
    return out, text


def _send(batch: int, hashes: np.ndarray, text: np.ndarray, fragments: int, header: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of one piece: its n-grams by fragment, the postings of those it has more than once, and a header."""
    order = np.argsort(hashes, kind="stable")
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(hashes)))
    fragment = ((hashes >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)
    ids = (hashes & _LOW) | (fragment << np.uint64(48))
    one = ids[new]
    owner = np.where(counts == 1, text[new], _MANY).astype("<u2")
    size = np.minimum(counts, _MANY).astype("<u2")
    part = (one >> np.uint64(48)).astype(np.int64)
    opens = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(part))
    low = (one & np.uint64(0xFFFFFFFF)).astype("<u4")
    high = ((one >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")
    nothing = [None] * len(opens)
    cut_ = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(opens, closes)], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(part[opens], pa.int64()), pa.array(np.full(len(opens), batch), pa.int64()), cut_(low), cut_(high), cut_(owner), cut_(size), *(pa.array(nothing, _LISTS) for _ in range(4))],
        schema=_SENT,
    )
    many = np.repeat(counts > 1, counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1 - batch]), pa.array([batch]), pa.array([ids[many].tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([text[many].astype("<u2").tobytes()], pa.binary()), pa.array([b""], pa.binary())]
        + [pa.array([header[x].astype(np.int64) if x in header else None], _LISTS) for x in ("key", "n", "s", "t")],
        schema=_SENT,
    )


def _answer(table: pa.Table) -> pa.Table:
    """One fragment: which of its n-grams stand in two documents or more, answered to each piece that holds them."""
    if table["part"][0].as_py() < 0:
        return table.drop_columns(["part"])
    release()
    batches = table["batch"].to_numpy()
    rows = [table[x].to_pylist() for x in ("a", "b", "c", "e")]
    sizes = np.array([len(x) // 4 for x in rows[0]])
    low, high, owner, size = (np.frombuffer(b"".join(x), t) for x, t in zip(rows, ("<u4", "<u2", "<u2", "<u2")))
    ids = (high.astype(np.uint64) << np.uint64(32)) | low | np.uint64(table["part"][0].as_py() << 48)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.add.reduceat(size[order].astype(np.int64), new)
    df = np.empty(len(ids), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(new, len(ids))))
    source = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.flatnonzero(df > 1)
    bounds = np.searchsorted(source[keep], np.arange(len(sizes) + 1))
    piece = [keep[a:b] for a, b in zip(bounds, bounds[1:])]
    some = [i for i, p in enumerate(piece) if len(p)]
    out = [
        pa.array(batches[some], pa.int64()),
        pa.array([ids[piece[i]].tobytes() for i in some], pa.binary()),
        pa.array([b""] * len(some), pa.binary()),
        pa.array([owner[piece[i]].tobytes() for i in some], pa.binary()),
        pa.array([np.minimum(df[piece[i]], 0xFFFFFFFF).astype("<u4").tobytes() for i in some], pa.binary()),
        *(pa.array([None] * len(some), _LISTS) for _ in range(4)),
    ]
    return pa.Table.from_arrays(out, schema=pa.schema([x for x in _SENT if x.name != "part"]))


def _received(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """One piece: its header, and the shared postings (id, text, document frequency) by text and id."""
    release()
    own = next(i for i, x in enumerate(table["key"].is_valid().to_pylist()) if x)
    header = {x: np.array(table[x][own].as_py(), np.int64) for x in ("key", "n", "s", "t") if table[x][own].is_valid}
    rest = [i for i in range(table.num_rows) if i != own]
    ids, text, df = (np.frombuffer(b"".join(table[x][i].as_py() for i in rest), t) for x, t in (("a", "<u8"), ("c", "<u2"), ("e", "<u4")))
    here, here_text = np.frombuffer(table["a"][own].as_py(), "<u8"), np.frombuffer(table["c"][own].as_py(), "<u2")
    if len(here):  # n-grams of several documents of the piece: the answer came once
        several = text == _MANY
        order = np.argsort(ids[several])
        known, known_df = ids[several][order], df[several][order]
        here_df = known_df[np.searchsorted(known, here)]
        ids, text, df = (np.concatenate([x[~several], y]) for x, y in ((ids, here), (text, here_text), (df, here_df)))
    order = np.lexsort((ids, text))
    return header, ids[order], text[order].astype(np.int64), df[order]


def _lists(values: np.ndarray, text: np.ndarray, keep: np.ndarray) -> pa.Array:
    """A list per text, null where ``keep`` is false; values are ordered by text."""
    counts = np.bincount(text, minlength=len(keep))
    chosen = values[np.repeat(keep, counts)]
    bounds = np.concatenate([[0], np.cumsum(np.where(keep, counts, 0))])
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(chosen.view(np.int64), pa.int64()))
    return pc.if_else(pa.array(keep), lists, pa.scalar(None, _LISTS))


def _shared(sent: DataFrame, finish, schema: str) -> DataFrame:
    answered = sent.groupBy("part").applyInArrow(_answer, _SENT_SQL.removeprefix("part bigint, "))
    return answered.groupBy("batch").applyInArrow(finish, schema)


def _batch_number(count: int) -> int:
    return (TaskContext.get().partitionId() << 24) + count


def _first_round(docs: DataFrame, fragments: int, words: int) -> DataFrame:
    """A row per document: rid, key, n, two sums that tell its set, alive (enough is shared), and its shared n-grams once per set and piece."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, batch in enumerate(gathered(batches, "text", PIECE_BYTES)):
            raw, offsets = text_view(batch.column("text"))
            hashes, text = shingle_sets(raw, offsets, words)
            n = np.bincount(text, minlength=batch.num_rows)
            s, t = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                first = (np.cumsum(n) - n)[some]
                s[some] = np.add.reduceat(mix(hashes + np.uint64(1)), first)
                t[some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
            key = batch.column("key").fill_null(_NO_KEY).to_numpy()
            yield from _send(_batch_number(count), hashes, text, fragments, {"key": key, "n": n, "s": s.view(np.int64), "t": t.view(np.int64)})

    def finish(table: pa.Table) -> pa.Table:
        header, ids, text, _ = _received(table)
        n = header["n"]
        alive = (n > 0) & (100 * np.bincount(text, minlength=len(n)) >= PERCENT * n)
        _, first = np.unique(np.stack([header["s"], header["t"]], 1), axis=0, return_index=True)
        chosen = np.zeros(len(n), bool)
        chosen[first] = True
        batch = table["batch"][0].as_py()
        out = [(batch << 16) + np.arange(len(n)), header["key"], n, header["s"], header["t"]]
        return pa.Table.from_arrays(
            [*(pa.array(x, pa.int64()) for x in out), pa.array(alive), _lists(ids, text, alive & chosen)], ["rid", "key", "n", "s", "t", "alive", "hashes"]
        )

    sent = docs.mapInArrow(send, _SENT_SQL)
    return _shared(sent, finish, "rid bigint, key bigint, n bigint, s bigint, t bigint, alive boolean, hashes array<bigint>")


def _second_round(classes: DataFrame, fragments: int) -> DataFrame:
    """The classes that still may link: rid, n, u (n-grams nobody else has), shared n-grams, those of the prefix, and the bitmap."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, batch in enumerate(batches):
            for start in range(0, batch.num_rows, 4000):
                piece = batch.slice(start, 4000)
                lists = piece.column("hashes")
                sizes = np.diff(lists.offsets.to_numpy())
                ids = lists.flatten().to_numpy().view(np.uint64)
                # Sets are hashed anew: the second fragments need not be those of the first.
                hashes = mix(ids + np.uint64(3))
                header = {"key": piece.column("rid").to_numpy(), "n": piece.column("n").to_numpy()}
                yield from _send(_batch_number(count * 64 + start // 4000), hashes, np.repeat(np.arange(len(sizes)), sizes), fragments, header)

    def finish(table: pa.Table) -> pa.Table:
        header, ids, text, df = _received(table)
        n = header["n"]
        shared = np.bincount(text, minlength=len(n))
        alive = 100 * shared >= PERCENT * n
        order = np.lexsort((ids, df, text))
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(shared) - shared, shared)
        length = n - (n * PERCENT + 99) // 100 + 1 - (n - shared)
        front = rank < length[text]
        bit = (mix(ids + np.uint64(9)) % np.uint64(64 * LONGS)).astype(np.int64)
        odd, times = np.unique(text * 64 * LONGS + bit, return_counts=True)
        odd = odd[times % 2 == 1]
        bitmap = np.zeros(len(n) * LONGS, np.uint64)
        np.bitwise_or.at(bitmap, odd // 64, np.uint64(1) << (odd % 64).astype(np.uint64))
        table = pa.Table.from_arrays(
            [
                pa.array(header["key"]),
                pa.array(n),
                pa.array(n - shared),
                _lists(ids, text, alive),
                _lists(ids[order][front], text[front], alive),
                _lists(bitmap, np.repeat(np.arange(len(n)), LONGS), alive),
            ],
            ["rid", "n", "u", "hashes", "front", "bitmap"],
        )
        return table.filter(pa.array(alive))

    sent = classes.select("rid", "n", "hashes").mapInArrow(send, _SENT_SQL)
    return _shared(sent, finish, "rid bigint, n bigint, u bigint, hashes array<bigint>, front array<bigint>, bitmap array<bigint>")


def _differ() -> Column:
    """At least so many n-grams are in one of the sets of sides x and y only."""
    differ = F.col("x.u") + F.col("y.u")
    for i in range(LONGS):
        differ = differ + F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}")))
    return differ


def _room() -> Column:
    """Whether sizes and bitmaps of sides x and y leave room for a link: at most a ninth of both sizes may differ."""
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * PERCENT
    return sizes & (_differ() * (100 + PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PERCENT))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) that link: partial overlaps of each fragment of the two sets, summed per pair."""
    fragment = F.expr(f"transform(sequence(0, {PARTS - 1}), p -> filter(hashes, h -> pmod(shiftright(h, 40), {PARTS}) = p))")
    parts = sets.select("rid", "n", F.posexplode(fragment).alias("part", "own")).where("size(own) > 0")
    left = parts.select(F.col("rid").alias("x"), F.col("n").alias("nx"), "part", F.col("own").alias("ox"))
    right = parts.select(F.col("rid").alias("y"), F.col("n").alias("ny"), "part", F.col("own").alias("oy"))
    partial = pairs.join(left, "x").join(right, ["y", "part"]).select("x", "y", "nx", "ny", F.size(F.array_intersect("ox", "oy")).alias("o"))
    sums = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("o").alias("o"))
    return sums.where(F.col("o") * 100 >= (F.col("nx") + F.col("ny") - F.col("o")) * percent).select("x", "y")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, label) of a bounded number of edges (x, y), in one task."""
    parent: dict[int, int] = {}

    def top(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    for batch in batches:
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], ["rid", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the least rid that each node of the undirected edges (x, y) reaches.

    Up to ``FEW_EDGES`` edges are united in one task, more of them by label propagation with jumps.
    """
    edges = edges.select("x", "y").where("x <> y")
    if edges.count() <= FEW_EDGES:
        return stage(edges.coalesce(1).mapInArrow(_united, "rid bigint, label bigint"), "jaccard-united")
    return propagated(edges)


def propagated(edges: DataFrame) -> DataFrame:
    """``components`` of any number of edges."""
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct())
    labels = cut(both.groupBy(F.col("x").alias("rid")).agg(F.least(F.min("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels, both["y"] == labels["rid"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["rid"] == near["x"]).select("rid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = cut(step)
        above = step.select(F.col("rid").alias("label"), F.col("label").alias("above"))
        labels = cut(step.join(above, "label", "left").select("rid", "old", F.coalesce("above", "label").alias("label")))
        if labels.where("old <> label").isEmpty():
            return labels.select("rid", "label")
        labels = labels.select("rid", "label")


def _stars(sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of each set and the leader of each list of a prefix n-gram it stands in, where sizes and bitmaps leave room."""
    fronts = sets.select("rid", "n", F.explode("front").alias("h"))
    order = F.struct(F.xxhash64("rid").alias("o"), "rid", "n")
    leaders = fronts.groupBy("h").agg(F.min(order).alias("lead"), F.count("*").alias("k")).where("k > 1")
    stars = fronts.join(leaders.select("h", "lead"), "h").where("rid <> lead.rid")
    sizes = F.least(F.col("n"), F.col("lead.n")) * 100 >= F.greatest(F.col("n"), F.col("lead.n")) * PERCENT
    stars = stars.where(sizes).select(F.col("lead.rid").alias("x"), F.col("rid").alias("y")).distinct()
    own = lambda side: sets.select("rid", "n", "u", *(F.col("bitmap")[i].alias(f"b{i}") for i in range(LONGS))).alias(side)
    likely = stars.alias("p").join(own("x"), F.col("p.x") == F.col("x.rid")).join(own("y"), F.col("p.y") == F.col("y.rid")).where(_room())
    return likely.select("p.x", "p.y")


def _meet(marked: DataFrame, turn: int | None) -> DataFrame:
    """Pairs (x, y) of different components lx and ly that share a prefix n-gram and have room for a link.

    In an n-gram's list, the sets outside its largest component meet the others: all of them if
    ``turn`` is None, and otherwise leaders that a hash of the turn draws. A list draws the more leaders
    the fewer of its sets are outside, so its pairs are about ``LEADERS`` times its sets.
    """
    places = marked.select("label", F.explode("front").alias("h"))
    groups = places.groupBy("h", "label").agg(F.count("*").alias("k"))
    mixed = groups.groupBy("h").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"), F.count("*").alias("labels")
    )
    mixed = mixed.where("labels > 1").select("h", "main", (F.lit(float(LEADERS)) / (F.col("all") - F.col("most"))).alias("share"))
    rows = marked.select("*", F.posexplode("front").alias("place", "h")).drop("front").join(mixed, "h")
    # Behind its first common n-gram, a pair has no more in common than the shorter rest of the two sets.
    rest = F.least(F.col("x.n") - F.col("x.u") - F.col("x.place"), F.col("y.n") - F.col("y.u") - F.col("y.place"))
    enough = rest * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT
    apart = F.col("x.label") != F.col("y.label")
    if turn is None:
        others = rows
        apart &= (F.col("y.label") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid"))
    else:
        draw = F.pmod(F.xxhash64(F.lit(turn), "h", "rid"), F.lit(1 << 30)) / (1 << 30)
        others = rows.where(draw < F.col("share"))
    met = rows.where("label <> main").alias("x").join(others.alias("y"), (F.col("x.h") == F.col("y.h")) & apart & enough & _room())
    return met.select(F.col("x.rid").alias("x"), F.col("y.rid").alias("y"), F.col("x.label").alias("lx"), F.col("y.label").alias("ly"), _differ().alias("differ"))


def links(sets: DataFrame) -> DataFrame:
    """Links (x, y) between classes whose components are those of all links.

    After the stars come rounds in which every component that still meets another verifies its
    likeliest pair only and is merged if that links, so a group of near copies becomes one component
    with about as many pairs as it has sets. When a round merges few more, all pairs that are left between
    different components are verified, so no link between components is lost.
    """
    first = stage(verified(_stars(sets), sets), "jaccard-stars")
    found, turn, total = [first], 0, 0
    labels = components(first)
    marked = sets.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    marked = marked.select("rid", "n", "u", "label", "front", *(F.col("bitmap")[i].alias(f"b{i}") for i in range(LONGS)))
    marked = stage(marked, "jaccard-marked")
    while True:
        either = _meet(marked, turn).select("*", F.explode(F.array("lx", "ly")).alias("label"))
        best = either.groupBy("label").agg(F.min(F.struct("differ", "x", "y", "lx", "ly")).alias("best"))
        asked = stage(best.select("best.x", "best.y", "best.lx", "best.ly").distinct(), "jaccard-asked")
        some = asked.count()
        linked = stage(verified(asked.select("x", "y"), sets), "jaccard-merged") if some else None
        merged = linked.count() if some else 0
        if merged:
            found.append(linked)
            edges = asked.join(linked, ["x", "y"]).select(F.col("lx").alias("x"), F.col("ly").alias("y"))
            joined = components(edges).select(F.col("rid").alias("label"), F.col("label").alias("joined"))
            marked = marked.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")
            marked = stage(marked, "jaccard-marked")
        turn, total = turn + 1, total + merged
        if merged * FEW <= total:
            break
    out = verified(_meet(marked, None).select("x", "y").distinct(), sets)
    for f in found:
        out = out.unionByName(f)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id) per row: the size of its set of shingles, the least key that links reach.

    A link needs 100 x intersection >= 80 x union. A text of fewer than ``words`` words is one
    shingle; a null or empty text has none and links with nothing. Repeated rows are rows of
    one class. A null key is larger than all others, so it is a component's id only where
    nothing else is in it, and comes out as null. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fragments = int(min(max(8, -(-int(size) // FRAGMENT_BYTES)), MOST_FRAGMENTS))
    found = stage(_first_round(rows, fragments, words), "jaccard-sets")

    alive = found.where("alive")
    classes = alive.groupBy("n", "s", "t").agg(F.min("rid").alias("rid"), F.min("key").alias("least"))
    sets = found.where("hashes IS NOT NULL").select("rid", "hashes").join(classes.select("rid", "n"), "rid")
    sets = stage(_second_round(sets, max(8, fragments // 4)), "jaccard-classes")
    labels = components(stage(links(sets), "jaccard-links"))

    # Classes, then components, then rows; only numbers move.
    named = classes.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("n", "s", "t", "component_id")
    linked = alive.join(named, ["n", "s", "t"]).select("key", "n", "component_id")
    alone = found.where("NOT alive").select("key", "n", F.col("key").alias("component_id"))
    true = lambda c: F.when(F.col(c) != _NO_KEY, F.col(c))
    out = linked.unionByName(alone)
    return out.select(true("key").alias(key), F.col("n").alias("n_shingles"), true("component_id").alias("component_id"))
