"""Removal of repeated substrings with suffix arrays.

Every window of 50 bytes is named by the least hash of its 16-byte pieces; neighbouring windows
of one name form a fragment of about seventy bytes. Equal strings fall into equally named
windows wherever they stand, so the fragments of a name can be compared by themselves.

1. Tasks cut their documents into fragments. Copies of a fragment inside a piece of a partition
   collapse there; what remains is sent, as hashes, to the part its name belongs to.
2. A part collapses copies from everywhere: all but those of the least document are repeats as
   a whole. Of a name with several different fragments, one document's copy of each is called up.
3. The called fragments are cut from their texts and sorted as suffixes, shard by shard. Two-stage
   sorting: only suffixes smaller than their successor are compared; the others are induced by
   one scan over the buckets of first bytes. Suffixes side by side with a common prefix of 50
   bytes or more are occurrences of one string; all but those of the least document are repeats.
4. The repeats of a document are joined to its text and taken out.

A name with very many different fragments (a common phrase in varying surroundings) is told from a
sample beforehand. Its fragments are sent as single windows instead, each under a name of its own
bytes: equal windows still meet, different ones spread over the parts. A name that the sample
misses or takes wrongly changes nothing in the result.

Nothing larger than a fragment is compared, no group is gathered but the distinct fragments of
one name that is not hot, and texts are shuffled once (both joins read the same exchange).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shelfline.lineage import stage
from shelfline.llm.common import SLICE_BYTES, gathered, mix, powers, ranges, release, ship, slices, text_view

#: Bytes of a repeated string, and of the pieces whose least hash names a window.
LENGTH, PIECE = 50, 16
#: Bytes of text per part, and the most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 1 << 15
#: Distinct fragments from which a name is hot, bytes of text of the sample that tells, and its least count there.
HOT, SAMPLE_BYTES, LEAST = 4096, 64 << 20, 8
_NO_KEY = (1 << 63) - 1

_COLUMNS = (("a", "<u4"), ("b", "<u2"), ("c", "<u4"), ("d", "<u2"), ("e", "<u4"), ("f", "<i4"), ("g", "<u4"), ("h", "<u1"))
_LISTS = pa.list_(pa.int64())
_SENT = pa.schema([("part", pa.int64()), ("batch", pa.int64()), *((x, pa.binary()) for x, _ in _COLUMNS), *((x, _LISTS) for x in ("key", "mark", "size"))])
_SENT_SQL = "part bigint, batch bigint, " + ", ".join(f"{x} binary" for x, _ in _COLUMNS) + ", key array<bigint>, mark array<bigint>, size array<bigint>"


def _window_names(raw: np.ndarray) -> np.ndarray:
    """Least hash of the pieces in the window that begins at each byte."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    out = mix((total[PIECE:] - total[:-PIECE]) * down[: len(raw) - PIECE + 1])
    wide, span = LENGTH - PIECE + 1, 1
    while span * 2 <= wide:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = wide - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def fragments(raw: np.ndarray, offsets: np.ndarray, block: int = 1 << 20, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(name, hash of the bytes, start, length, text) of every fragment; texts are taken in blocks of about ``block`` bytes.

    Fragments whose name is among ``hot`` (ordered) come as single windows with names of their own.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(offsets) - 1:
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        low = int(offsets[at])
        piece, sizes = raw[low : int(offsets[last])], np.diff(offsets[at : last + 1])
        windows = np.maximum(sizes - LENGTH + 1, 0)
        if windows.any():
            names = _window_names(piece)
            where = ranges(offsets[at:last] - low, windows)
            text = np.repeat(np.arange(at, last), windows)
            names = names[where]
            new = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (text[1:] != text[:-1])))
            length = np.diff(np.append(new, len(names))) + LENGTH - 1
            start = where[new]
            up, down = powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
            # The least of many hashes is a small number: mixed once more, names spread evenly over the parts.
            names, text = mix(names[new]), text[new]
            split = np.zeros(len(names), bool)
            if hot is not None and len(hot):
                split = hot[np.minimum(np.searchsorted(hot, names), len(hot) - 1)] == names
            if split.any():
                count = length[split] - LENGTH + 1
                names, text = (np.concatenate([x[~split], np.repeat(x[split], count)]) for x in (names, text))
                start = np.concatenate([start[~split], ranges(start[split], count)])
                length = np.concatenate([length[~split], np.full(count.sum(), LENGTH)])
            code = mix((total[start + length] - total[start]) * down[start] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if split.any():
                single = np.arange(len(names)) >= (~split).sum()
                names[single] = mix(names[single] ^ code[single])
            parts.append((names, code, start + low, length, text))
        at = last
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


def _split_long(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Fragments of more windows than a piece allows (a name that comes again and again) as several, so that a length fits a byte."""
    names, code, start, length, text = found
    most = LENGTH - 1 + 150
    long = length > most
    if not long.any():
        return found
    windows = length[long] - LENGTH + 1
    count = -(-windows // 150)
    step = ranges(np.zeros(len(count), np.int64), count) * 150
    more_length = np.minimum(np.repeat(windows, count) - step, 150) + LENGTH - 1
    more_start = np.repeat(start[long], count) + step
    # The bytes are not at hand: such a fragment is told by the whole run, its place in it and its length.
    more_code = mix(np.repeat(code[long], count) + mix((step * 1000 + more_length).astype(np.uint64)))
    keep = ~long
    return (
        np.concatenate([names[keep], np.repeat(names[long], count)]), np.concatenate([code[keep], more_code]),
        np.concatenate([start[keep], more_start]), np.concatenate([length[keep], more_length]), np.concatenate([text[keep], np.repeat(text[long], count)]),
    )


def _send(batch: int, raw: np.ndarray, offsets: np.ndarray, key: np.ndarray, mark: np.ndarray, parts: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    names, code, start, length, text = _split_long(fragments(raw, offsets, hot=hot))
    owner = key[text]
    order = np.lexsort((owner, code, names))
    names, code, start, length, owner = (x[order] for x in (names, code, start, length, owner))
    new = np.append(True, (names[1:] != names[:-1]) | (code[1:] != code[:-1])) if len(names) else np.zeros(0, bool)
    least = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(names) else owner
    copies = owner > least
    here = pa.array([start[copies].astype("<u4").tobytes()], pa.binary()), pa.array([length[copies].astype("<u1").tobytes()], pa.binary())
    names, code, start, length, owner = (x[~copies] for x in (names, code, start, length, owner))
    part = (((names >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
    opens = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(part))
    planes = (names, names >> np.uint64(32), code, code >> np.uint64(32), owner, owner >> 32, start, length)
    masks = (0xFFFFFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFF, 0xFFFFFFFF, None, None, None)
    columns = []
    for (_, kind), plane, mask in zip(_COLUMNS, planes, masks):
        plane = (plane if mask is None else plane & plane.dtype.type(mask)).astype(kind)
        columns.append(pa.array([plane[a:b].tobytes() for a, b in zip(opens, closes)], pa.binary()))
    nothing = [pa.array([None] * len(opens), _LISTS) for _ in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(part[opens], pa.int64()), pa.array(np.full(len(opens), batch), pa.int64()), *columns, *nothing], schema=_SENT)
    none = pa.array([b""], pa.binary())
    header = [pa.array([x.astype(np.int64)], _LISTS) for x in (key, mark, np.diff(offsets))]
    yield pa.RecordBatch.from_arrays([pa.array([-1 - batch]), pa.array([batch]), *[none] * 6, *here, *header], schema=_SENT)


_ANSWER_SQL = "batch bigint, repeat boolean, shard binary, g binary, h binary, key array<bigint>, mark array<bigint>, size array<bigint>"
_ANSWER = pa.schema([("batch", pa.int64()), ("repeat", pa.bool_()), ("shard", pa.binary()), ("g", pa.binary()), ("h", pa.binary()), *((x, _LISTS) for x in ("key", "mark", "size"))])


def _answer(table: pa.Table) -> pa.Table:
    """One part: to each piece, which fragments are repeats as a whole, and which are called up for sorting."""
    if table["part"][0].as_py() < 0:
        return pa.Table.from_arrays([table["batch"], pa.array([True]), pa.array([b""], pa.binary()), *(table[x] for x in ("g", "h", "key", "mark", "size"))], schema=_ANSWER)
    release()
    batches = table["batch"].to_numpy()
    rows = {x: table[x].to_pylist() for x, _ in _COLUMNS}
    sizes = np.array([len(x) for x in rows["h"]])
    low, high, code, code_high, key, key_high, start, length = (np.frombuffer(b"".join(rows[x]), kind) for x, kind in _COLUMNS)
    names = (high.astype(np.uint64) << np.uint64(32)) | low
    code = (code_high.astype(np.uint64) << np.uint64(32)) | code
    key = (key_high.astype(np.int64) << 32) | key
    order = np.lexsort((key, code, names))
    n, c, k = names[order], code[order], key[order]
    name_opens = np.append(True, n[1:] != n[:-1])
    kind_opens = name_opens | np.append(True, c[1:] != c[:-1])
    name_of = np.cumsum(name_opens) - 1
    first = np.flatnonzero(name_opens)
    shared = np.minimum.reduceat(k, first) < np.maximum.reduceat(k, first)
    several = np.add.reduceat(kind_opens.astype(np.int64), first) > 1
    least = k[np.flatnonzero(kind_opens)][np.cumsum(kind_opens) - 1]
    repeat = k > least
    called = ~repeat & (shared & several)[name_of]
    source = np.repeat(np.arange(len(sizes)), sizes)[order]
    shard = ((mix(n) >> np.uint64(7)) & np.uint64(0xFFFF)).astype("<u2")
    out: list[tuple] = []
    for which, chosen in ((True, repeat), (False, called)):
        at = np.flatnonzero(chosen)
        at = at[np.argsort(source[at], kind="stable")]
        bounds = np.searchsorted(source[at], np.arange(len(sizes) + 1))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                own = order[at[a:b]]
                out.append((int(batches[i]), which, b"" if which else shard[at[a:b]].tobytes(), start[own].tobytes(), length[own].tobytes(), None, None, None))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _ANSWER)], schema=_ANSWER) if out else _ANSWER.empty_table()


_MARKS_SQL = "key bigint, mark bigint, starts array<int>, ends array<int>, called array<int>, lengths array<int>, shards array<int>"


def _finish(table: pa.Table) -> pa.Table:
    """One piece: per document the spans of whole repeats, merged, and the fragments called up; documents without either are left out."""
    own = next(i for i, x in enumerate(table["key"].is_valid().to_pylist()) if x)
    key, mark, size = (np.array(table[x][own].as_py(), np.int64) for x in ("key", "mark", "size"))
    offsets = np.concatenate([[0], np.cumsum(size)])
    repeat = np.array(table["repeat"].to_pylist(), bool)
    data = {x: table[x].to_pylist() for x in ("shard", "g", "h")}

    def joined(column: str, kind: str, which: bool) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, r in zip(data[column], repeat) if r == which), kind).astype(np.int64)

    start, end = joined("g", "<u4", True), joined("g", "<u4", True) + joined("h", "<u1", True)
    text = np.searchsorted(offsets, start, side="right") - 1
    start, end, text = merged(start, end, text)
    called, lengths, shards = joined("g", "<u4", False), joined("h", "<u1", False), joined("shard", "<u2", False)
    order = np.argsort(called, kind="stable")
    called, lengths, shards = called[order], lengths[order], shards[order]
    called_text = np.searchsorted(offsets, called, side="right") - 1
    some = np.union1d(text, called_text)
    lists = lambda values, owner: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owner, some), len(owner)), pa.int32()), pa.array(values, pa.int32()))
    return pa.Table.from_arrays(
        [
            pa.array(key[some]), pa.array(mark[some]), lists(start - offsets[text], text), lists(end - offsets[text], text),
            lists(called - offsets[called_text], called_text), lists(lengths, called_text), lists(shards, called_text),
        ],
        ["key", "mark", "starts", "ends", "called", "lengths", "shards"],
    )


def merged(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each owner, by owner and start; spans that touch become one."""
    if not len(start):
        return start, end, owner
    order = np.lexsort((start, owner))
    start, end, owner = start[order], end[order], owner[order]
    # Shift owners apart, so that one running maximum serves them all.
    base = (owner - owner[0]) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, start[1:] + base[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), owner[first]


def suffix_types(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one counts as smaller."""
    if not len(data):
        return np.zeros(0, bool)
    change = np.flatnonzero(data[1:] != data[:-1])
    smaller = np.ones(len(data), bool)
    run_end = np.append(change, len(data) - 1)
    rises = np.append(data[change] < data[change + 1], True)
    return np.repeat(rises, np.diff(np.append(-1, run_end))) & smaller


def two_stage_order(data: np.ndarray, wanted: np.ndarray, smaller: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The ``wanted`` suffixes of ``data`` in the order of their first ``depth`` bytes at least.

    Whenever a wanted suffix is larger than its successor, the successor is wanted too.
    """
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    direct = np.flatnonzero(wanted & smaller)
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    # Strings of equal length: a zero byte is a byte like others.
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    first = np.searchsorted(data[direct], np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(256):
        now = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        bucket = []
        while len(now):
            bucket.append(now)
            before = now[now > 0] - 1
            now = before[wanted[before] & (data[before] == c)]
        bucket.append(direct[first[c] : first[c + 1]])
        every = np.concatenate(bucket)
        larger[c] = []
        if not len(every):
            continue
        out.append(every)
        before = every[every > 0] - 1
        before = before[wanted[before] & (data[before] > c)]
        if len(before):
            target = data[before]
            order = np.argsort(target, kind="stable")
            before, target = before[order], target[order]
            opens = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            for a, b in zip(opens, np.append(opens[1:], len(before))):
                larger[target[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to ``depth`` bytes; 0 for the first."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)])
    out = np.zeros(len(order), np.int64)
    same = np.arange(1, len(order))
    for j in range(depth):
        same = same[padded[order[same] + j] == padded[order[same - 1] + j]]
        out[same] += 1
        if not len(same):
            break
    return out


def shard_repeats(data: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, start, end) of the repeats among fragments that stand end to end in ``data``: strings that a smaller key has too."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # A zero behind each fragment; no window reaches over it.
    spaced = np.zeros(len(data) + len(sizes), np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    spaced[place] = data
    begins = begins + np.arange(len(sizes))
    smaller = suffix_types(spaced)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    starts = ranges(begins, windows)
    wanted = np.zeros(len(spaced), bool)
    wanted[starts] = True
    # From the last window on, up to the next suffix that is compared directly.
    next_small = np.flatnonzero(smaller)
    last = begins[windows > 0] + windows[windows > 0] - 1
    until = next_small[np.minimum(np.searchsorted(next_small, last), len(next_small) - 1)]
    wanted[ranges(last, until - last + 1)] = True
    order = two_stage_order(spaced, wanted, smaller)
    eligible = np.zeros(len(spaced), bool)
    eligible[starts] = True
    order = order[eligible[order]]
    if not len(order):
        return order, order, order
    opens = np.flatnonzero(common_prefixes(spaced, order) < LENGTH)
    owner = np.searchsorted(begins, order, side="right") - 1
    least = np.repeat(np.minimum.reduceat(key[owner], opens), np.diff(np.append(opens, len(order))))
    hit = key[owner] > least
    at, fragment = order[hit], owner[hit]
    start, end, fragment = merged(at - begins[fragment], at - begins[fragment] + LENGTH, fragment)
    return fragment, start, end


def _cut_out(shards: int):
    """Called fragments of texts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = text_view(batch.column("text"))
            called, lengths, shard = (batch.column(x) for x in ("called", "lengths", "shards"))
            count = np.diff(called.offsets.to_numpy())
            text = np.repeat(np.arange(batch.num_rows), count)
            start, size = called.flatten().to_numpy().astype(np.int64), lengths.flatten().to_numpy().astype(np.int64)
            target = shard.flatten().to_numpy().astype(np.int64) % shards
            order = np.argsort(target, kind="stable")
            text, start, size, target = text[order], start[order], size[order], target[order]
            opens = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
            closes = np.append(opens[1:], len(target))
            key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
            data = [raw[ranges(offsets[text[a:b]] + start[a:b], size[a:b])].tobytes() for a, b in zip(opens, closes)]
            cut_ = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(opens, closes)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(target[opens], pa.int64()), pa.array(data, pa.binary()), cut_(size, "<u1"), cut_(start, "<i4"), cut_(key[text], "<i8"), cut_(mark[text], "<i8")],
                ["shard", "data", "size", "start", "key", "mark"],
            )

    return run


def _sort_shard(table: pa.Table) -> pa.Table:
    release()
    data, size, start, key, mark = (
        np.frombuffer(b"".join(table[x].to_pylist()), kind) for x, kind in (("data", "u1"), ("size", "u1"), ("start", "<i4"), ("key", "<i8"), ("mark", "<i8"))
    )
    fragment, low, high = shard_repeats(data, size.astype(np.int64), key)
    low, high, key, mark = low + start[fragment], high + start[fragment], key[fragment], mark[fragment]
    _, owner = np.unique(np.stack([key, mark], 1), axis=0, return_inverse=True) if len(key) else (None, np.zeros(0, np.int64))
    owner = owner.ravel()
    order = np.argsort(owner, kind="stable")
    key, mark = key[order], mark[order]
    low, high, owner = merged(low, high, owner)
    first = np.searchsorted(owner, np.arange(owner[-1] + 2 if len(owner) else 1))
    one = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))) if len(key) else np.zeros(0, np.int64)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32()))
    return pa.Table.from_arrays([pa.array(key[one]), pa.array(mark[one]), lists(low), lists(high)], ["key", "mark", "starts", "ends"])


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw, offsets = text_view(batch.column("text"))
        rows = []
        for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())):
            text = raw[offsets[i] : offsets[i + 1]]
            if not starts:
                rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), [], []))
                continue
            low, high, _ = merged(np.array(starts, np.int64), np.array(ends, np.int64), np.zeros(len(starts), np.int64))
            keep = np.ones(len(text), bool)
            keep[ranges(low, high - low)] = False
            rows.append((len(text), int((high - low).sum()), len(low), hashlib.sha256(text[keep]).hexdigest(), low.tolist(), high.tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
        )


def hot_names(rows: DataFrame, size: int) -> np.ndarray:
    """Names of about ``HOT`` distinct fragments or more among (text, mark) rows of ``size`` bytes, ordered.

    Told from the rows of a hash range, about ``SAMPLE_BYTES`` of text. One name of 8 bytes stands
    for some 4,096 fragments, so the list is a small share of the input.
    """
    whole = 1 << 30
    share = min(whole, -(-(SAMPLE_BYTES * whole) // max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", SLICE_BYTES):
            names, code, *_ = fragments(*text_view(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(code.view(np.int64))], ["name", "code"])

    chosen = rows.select("text", "mark").where(F.pmod("mark", F.lit(whole)) < share)
    counts = chosen.mapInArrow(run, "name bigint, code bigint").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= max(LEAST, HOT * share // whole)).select("name").toArrow()["name"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def repeated_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) per row of ``docs``.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller
    key; strings are judged on the input. ``starts`` and ``ends`` are the removed spans in bytes,
    ends exclusive. A null text is empty. Rows of one key are never smaller than each other; a
    null key is larger than all others. Other columns are not read; empty gives empty.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts = min(max(8, -(-size // PART_BYTES)), MOST_PARTS)
    hot = spark.sparkContext.broadcast(hot_names(rows, size))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for count, batch in enumerate(gathered(batches, "text", SLICE_BYTES)):
            raw, offsets = text_view(batch.column("text"))
            number = (TaskContext.get().partitionId() << 24) + count
            yield from _send(number, raw, offsets, batch.column("key").to_numpy(), batch.column("mark").to_numpy(), parts, hot.value)

    answered = rows.mapInArrow(send, _SENT_SQL).groupBy("part").applyInArrow(_answer, _ANSWER_SQL)
    marks = stage(answered.groupBy("batch").applyInArrow(_finish, _MARKS_SQL), "substring-marks").dropDuplicates(["key", "mark"])
    # Both joins need the texts by row: the same exchange serves them.
    placed = rows.repartition(max(parts, 8), "key", "mark")
    wanted = marks.where("size(called) > 0").select("key", "mark", "called", "lengths", "shards")
    cut = placed.join(wanted.hint("merge"), ["key", "mark"]).select("key", "mark", "text", "called", "lengths", "shards")
    cut = cut.mapInArrow(_cut_out(parts), "shard bigint, data binary, size binary, start binary, key binary, mark binary")
    spans = "key bigint, mark bigint, starts array<int>, ends array<int>"
    found = cut.groupBy("shard").applyInArrow(_sort_shard, spans)
    every = found.unionByName(marks.where("size(starts) > 0").select("key", "mark", "starts", "ends"))
    every = every.groupBy("key", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    joined = placed.join(every.hint("merge"), ["key", "mark"], "left").select("key", "text", "starts", "ends")
    out = joined.mapInArrow(_take_out, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>")
    return out.withColumn("key", F.when(F.col("key") != _NO_KEY, F.col("key"))).withColumnRenamed("key", key)
