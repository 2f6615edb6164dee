"""Helpers that several operators share: views on Arrow text and small numpy kernels."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that a task turns into numpy arrays at once; a single longer text is taken alone.
SLICE_BYTES = 4 << 20
#: Rows of one piece, and of a joined piece: fewer than sixteen bits can number.
SLICE_ROWS, JOINED_ROWS = 10_000, 50_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that their Python workers can import it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: it gives memory back by its own rules
    _trim = None


def release() -> None:
    """Give freed memory back to the machine: workers live on between tasks, and executors are small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and len + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about ``limit`` bytes and SLICE_ROWS rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_view(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        if offsets[-1] > 1 << 20:
            release()


def gathered(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut and joined to pieces of about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in slices(batches, column, limit):
        held.append(piece)
        size += int(text_view(piece.column(column))[1][-1])
        if size >= limit or sum(x.num_rows for x in held) >= JOINED_ROWS:
            yield from _joined(held)
            held, size = [], 0
            release()
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def drawn(rows: DataFrame, share: Column | int, *columns: str) -> DataFrame:
    """The rows whose hash of ``columns`` and their own place is below ``share`` of 2**20.

    The place lets rows that are equal, or share a key, be drawn each by itself.
    """
    (mark,) = unused(rows.columns, "_drawn")
    hashed = rows.withColumn(mark, F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(1 << 20)))
    return hashed.where(F.col(mark) < share).drop(mark)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every (start, length), end to end."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2**64, and of its inverse."""
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        up = np.full(size, _ODD)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte segments [start, end), by differences of a running polynomial.

    The segments are in order and do not overlap; about ``block`` bytes are taken at a time.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        low, high = int(starts[at]), int(ends[last - 1])
        up, down = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = starts[at:last] - low, ends[at:last] - low
        out[at:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        at = last
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return raw | (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def words_of(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a maximal run of ``word_byte`` bytes inside one text), and words before each text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word_byte[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A word that runs over a border of texts is two words.
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)
