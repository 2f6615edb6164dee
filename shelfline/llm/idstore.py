"""Token ids in raw files, with a minimal perfect hash index for access by key.

A store is a folder:

* ``ids/*.bin``: the ids of many documents end to end, little-endian, two bytes each where the
  vocabulary allows it and four otherwise; nothing else is in these files,
* ``entries``: a Parquet row per document (key, occurrence, shard, offset and number of ids),
* ``shards``: a Parquet row per payload file (path, documents, ids, ids of all files before it),
* ``index/*.mph`` and ``buckets``: the index and the list of its files.

The documents are range-partitioned by key; each task writes its own files in key order. A key
that repeats is told apart by its occurrence (0, 1, ...), counted across files.

The index is split by a hash of (key, occurrence) to buckets of some ``BUCKET_KEYS`` keys. In a
bucket, every key falls on a bit of a first bit set; keys that fall on a bit alone keep it, the
others go on to the next, smaller set. The rank of a key's bit among all set bits is its slot, so
n keys have the slots 0 to n - 1 and no key is stored. A slot holds a 32-bit fingerprint, the file,
the offset and the length: a look-up reads a fixed number of places whatever the size of the store,
and a key that is not in the store is found out by the fingerprint (but for one in 2**32).

Files are written under names that no other attempt uses and listed only by the tables that the
successful tasks return; a lost executor leaves at most an unlisted file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfline.lineage import fresh_path
from shelfline.llm.common import mix, release, ship, slices
from shelfline.operators.reshape import shuffle_partitions

#: Bytes of text that go to a partition (of at most MOST_PARTITIONS), ids of a payload file, keys of an index bucket.
PARTITION_BYTES, MOST_PARTITIONS, FILE_IDS, BUCKET_KEYS = 128 << 20, 32_768, 64 << 20, 1 << 17
#: Words and pieces whose ids a worker remembers (and as many words of the time before), and bytes of text encoded at once.
KNOWN_WORDS, TEXT_BYTES = 400_000, 2 << 20
#: Bytes of payload read at once.
READ_BYTES = 8 << 20
#: Bits per key of each bit set of the hash, and how many sets there may be.
SPACE, MOST_LEVELS = 2, 64
MAGIC = b"mphindex"
RECORD = np.dtype([("mark", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("n", "<u8")])

_SALT = np.uint64(0xA0761D6478BD642F)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        """``sizes``: 64-bit words of each level; ``words``: the levels end to end."""
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum(sizes) - sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.n = int(ones.sum())

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, words: int) -> np.ndarray:
        salt = mix(np.array([level + 1], np.uint64) * _SALT)
        return (mix(a ^ mix(b + salt)) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(a):
            if len(levels) == MOST_LEVELS:
                raise ValueError("two keys have the same 128-bit hash")
            words = max(1, -(-SPACE * len(a) // 64))
            at = cls._places(a, b, len(levels), words)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(words)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; a pair that was not among the keys gets any slot, or -1."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (start, words) in enumerate(zip(self.starts, self.sizes)):
            at = self._places(a[left], b[left], level, int(words))
            word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
            bits = self.words[word]
            hit = (bits >> bit) & np.uint64(1) == 1
            below = bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out


def marks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit fingerprints of pairs."""
    return (mix(b ^ mix(a ^ _SALT)) >> np.uint64(32)).astype(np.uint32)


@dataclass
class IndexBucket:
    """One bucket of the index: a perfect hash and a record per slot."""

    hash: PerfectHash
    records: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> IndexBucket:
        found = PerfectHash.build(a, b)
        records = np.zeros(len(a), RECORD)
        at = found.slots(a, b)
        for name, values in (("mark", marks(a, b)), ("shard", shard), ("offset", offset), ("n", n)):
            records[name][at] = values
        return cls(found, records)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QQ", len(self.hash.sizes), len(self.records))
        return head + self.hash.sizes.astype("<u8").tobytes() + self.hash.words.tobytes() + self.records.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> IndexBucket:
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        levels, n = struct.unpack_from("<QQ", data, 8)
        sizes = np.frombuffer(data, "<u8", levels, 24).astype(np.int64)
        at = 24 + 8 * levels
        words = np.frombuffer(data, "<u8", int(sizes.sum()), at)
        return cls(PerfectHash(sizes, words), np.frombuffer(data, RECORD, n, at + 8 * len(words)))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that are not in the bucket."""
        slot = self.hash.slots(a, b)
        known = slot >= 0
        known[known] = self.records["mark"][slot[known]] == marks(a[known], b[known])
        return np.where(known, slot, -1)


class _Words(dict):
    """Ids of words; a word that is not there is asked for."""

    def __init__(self, ask) -> None:
        super().__init__()
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.ask(word)
        return found


class Encoder:
    """Ids of whole texts by a tokenizer of the tokenizers library that drops white space.

    Such a tokenizer never joins what a space or a line feed parts, so the ids of a text are those
    of its words end to end, and a very long text needs no more memory than its words. Words are
    remembered. Where the file is of the known kind (lower case, then pieces by a pattern, then
    bytes), a new word of plain Latin characters is cut to pieces by the file's own pattern and only
    new pieces go to the library's model; all other words go through the whole tokenizer.
    """

    def __init__(self, spec: str, end: int | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        highest = max([end or 0, *self.tokenizer.get_vocab().values()])
        self.kind = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.code = [i.tobytes() for i in np.arange(highest + 1, dtype=self.kind)]
        self.end = b"" if end is None else self.code[end]
        parts = [self.whole(x) for x in ("a b", "a\nb", " a \n b ", "a", "b")]
        if not parts[0] == parts[1] == parts[2] == parts[3] + parts[4]:
            raise ValueError("this tokenizer does not drop white space")
        self.pattern, self.lower = _pieces_of(json.loads(spec))
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens") or []]
        # Words and pieces of late, and those of the time before; the latter make room.
        self.words, self.older = _Words(self._word), {}
        self.pieces = _Words(self._piece)

    def whole(self, text: str) -> bytes:
        return b"".join([self.code[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.code[t.id] for t in self.model.tokenize(piece.translate(BYTE_LEVEL))])

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is not None:
            return found
        if self.pattern is None or not word.isprintable() or not (word.isascii() or max(word) < PLAIN):
            return self.whole(word)
        small = word.lower() if self.lower else word
        if small.isalpha() and len(small) == len(word):
            return self.pieces[small]
        if len(small) != len(word) or any(s in word for s in self.special):
            return self.whole(word)
        return b"".join([self.pieces[p] for p in self.pattern.findall(small)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > KNOWN_WORDS:
            self.older, self.words = dict(self.words), _Words(self._word)
        if len(self.pieces) > KNOWN_WORDS:
            self.pieces = _Words(self._piece)
        ids = self.words.__getitem__
        return [b"".join(map(ids, (t or "").replace("\n", " ").split(" "))) + self.end for t in texts]


def _byte_level() -> dict[int, str]:
    """The stand-ins of the bytes of plain characters in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    stand_in = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(stand_in[b] for b in chr(c).encode()) for c in range(ord(PLAIN))}


#: Below this character, none is changed by NFC, and case and class are the same in all versions of Unicode.
PLAIN = "\u0180"
BYTE_LEVEL = _byte_level()


def _pieces_of(spec: dict) -> tuple[regex.Pattern | None, bool]:
    """The pattern of the pieces that a tokenizer file cuts plain words to, and whether they are lower case; None for another kind of file."""
    kinds = {"NFC": {}, "Replace": {"pattern": {"Regex": "\\s+"}, "content": " "}, "Lowercase": {}}
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    normal = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [c["type"] for c in cut] != ["Split", "ByteLevel"] or any(n != {"type": n["type"], **kinds.get(n["type"], {"": 0})} for n in normal):
        return None, False
    split, level = cut
    pattern = split["pattern"].get("Regex")
    if pattern is None or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level.get("use_regex", True):
        return None, False
    return regex.compile(pattern), any(n["type"] == "Lowercase" for n in normal)


@lru_cache(maxsize=1)
def _encoder(spec: str, end: int | None) -> Encoder:
    """A worker goes on with the words of its earlier tasks."""
    return Encoder(spec, end)


@dataclass
class IdStore:
    """A written store; its tables are in its folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _open(path: str) -> pa.NativeFile:
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _write(path: str, data: bytes) -> None:
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(data)


class ShardWriter:
    """Writes ids to payload files below ``folder``, a new one after FILE_IDS ids."""

    def __init__(self, folder: str, width: int, file_ids: int) -> None:
        self.folder, self.width, self.file_ids = folder, width, file_ids
        self.number, self.offset, self.documents, self.out, self.path = -1, 0, 0, None, ""

    def add(self, ids: bytes) -> tuple[int, int, int]:
        """(file number, number of the document in the file, offset) of a document."""
        if self.out is None or self.offset >= self.file_ids:
            self.close()
            self.path = f"{self.folder}/{uuid.uuid4().hex}.bin"
            system, place = fs.FileSystem.from_uri(self.path)
            system.create_dir(place.rpartition("/")[0], recursive=True)
            self.out = system.open_output_stream(place)
            self.number, self.offset, self.documents = self.number + 1, 0, 0
        self.out.write(ids)
        at = self.number, self.documents, self.offset
        self.offset += len(ids) // self.width
        self.documents += 1
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _hashes() -> tuple[Column, Column]:
    """Two 64-bit hashes of (key, occurrence)."""
    null, key, occurrence = F.isnull("key"), F.col("key"), F.col("occurrence")
    return F.xxhash64(null, key, occurrence).alias("a"), F.xxhash64(F.lit("second"), occurrence, key, null).alias("b")


def write_store(
    docs: DataFrame, tokenizer: str, end: int | None = 1, folder: str | None = None, key: str = "doc_id", text: str = "text",
    partition_bytes: int = PARTITION_BYTES, file_ids: int = FILE_IDS, bucket_keys: int = BUCKET_KEYS,
) -> IdStore:
    """Encode ``text``, append the id ``end`` (none if None) to every document, and write a store in ascending order of ``key``.

    ``tokenizer`` is a file of the tokenizers library; it is read on the driver and broadcast, as its
    size does not depend on the data. A null text is empty and has the end id alone; a null key
    comes first. Rows of one key stand in the order of a hash of their text; each row is a document of
    its own, repeated rows included. Other columns are ignored, whatever their names. An empty table
    gives a store without documents.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "idstore")
    with open(tokenizer, encoding="utf-8") as source:
        spec = spark.sparkContext.broadcast(source.read())
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(shuffle_partitions(docs), -(-size // partition_bytes)), MOST_PARTITIONS)
    # Rows of one key, and equal rows, must be able to part: the row's own number comes last.
    spread = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("key"), F.asc("hash"), F.asc("row")]
    ranged = spread.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value, end)
        writer = ShardWriter(f"{folder}/ids", encoder.kind.itemsize, file_ids)
        part = TaskContext.get().partitionId()
        last, before, shard = object(), 0, -1
        for batch in slices(batches, "text", TEXT_BYTES):
            keys, found = batch.column("key").to_pylist(), []
            for k, ids in zip(keys, encoder.encode(batch.column("text").to_pylist())):
                number, place, offset = writer.add(ids)
                before = before + 1 if place and k == last else 0
                last, shard = k, (part << 20) | number
                found.append((shard, writer.path, place, before, offset, len(ids) // encoder.kind.itemsize))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            width = pa.array([encoder.kind.itemsize] * len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns, width], ["key", "shard", "path", "place", "before", "offset", "n", "width"])
        writer.close()
        release()

    schema = f"key {kind}, shard bigint, path string, place bigint, before bigint, offset bigint, n bigint, width int"
    ranged.mapInArrow(run, schema).write.parquet(f"{folder}/written")
    written = spark.read.schema(schema).parquet(f"{folder}/written")

    # A row per file. A key runs over files only as the last key of all files but the last one.
    files = written.groupBy("shard").agg(
        F.first("path").alias("path"), F.first("width").alias("width"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("ids"),
        F.min_by("key", "place").alias("first_key"), F.max_by("key", "place").alias("last_key"), (F.max_by("before", "place") + 1).alias("last_run"),
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("last_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    files = files.withColumns({"base": F.coalesce(F.sum("ids").over(earlier), F.lit(0)), "previous_key": F.lag("last_key").over(Window.orderBy("shard"))})
    files = files.withColumns({"run": F.sum("last_run").over(same), "first_file": F.min("shard").over(Window.orderBy("shard"))})
    run_before = F.lag("run").over(Window.orderBy("shard"))
    follows = F.col("first_key").eqNullSafe(F.col("previous_key")) & (F.col("shard") > F.col("first_file"))
    files = files.withColumn("carried", F.when(follows, run_before).otherwise(0))
    files.select("shard", "path", "width", "documents", "ids", "base", "first_key", "carried").write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")

    own = shards.select(F.col("shard").alias("of"), "first_key", "carried")
    entries = written.join(own, F.col("shard") == F.col("of")).select(
        "key",
        (F.col("before") + F.when(F.col("key").eqNullSafe(F.col("first_key")), F.col("carried")).otherwise(0)).alias("occurrence"),
        "shard", "offset", "n",
    )
    entries.write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")

    buckets = max(1, -(-entries.count() // bucket_keys))

    def index(table: pa.Table) -> pa.Table:
        number = lambda c: table[c].to_numpy().view(np.uint64)
        built = IndexBucket.build(number("a"), number("b"), number("shard"), number("offset"), number("n"))
        path = f"{folder}/index/{uuid.uuid4().hex}.mph"
        _write(path, built.to_bytes())
        return pa.table({"bucket": [table["bucket"][0].as_py()], "path": [path], "documents": [len(table)]})

    hashed = entries.select(*_hashes(), "shard", "offset", "n").withColumn("bucket", F.pmod("a", F.lit(buckets)))
    hashed.groupBy("bucket").applyInArrow(index, "bucket bigint, path string, documents bigint").write.parquet(f"{folder}/buckets")
    spark.createDataFrame([(buckets,)], "buckets bigint").write.parquet(f"{folder}/layout")
    return IdStore(spark, folder)


def locate(store: IdStore, keys: DataFrame) -> DataFrame:
    """(key, occurrence, shard, offset, n) of the distinct ``keys`` (key, occurrence) that are in the store, by its index."""
    ship(store.spark)
    buckets = store.table("layout").first()[0]
    kind = keys.schema["key"].dataType.simpleString()
    asked = keys.select("key", F.col("occurrence").cast("bigint").alias("occurrence")).distinct()
    asked = asked.select("key", "occurrence", *_hashes()).withColumn("bucket", F.pmod("a", F.lit(buckets)))
    # Keys of one bucket stand together, so that a task opens an index file once.
    asked = asked.join(store.table("buckets").select("bucket", "path"), "bucket")
    asked = asked.repartition(shuffle_partitions(keys), "bucket").sortWithinPartitions("bucket").select("key", "occurrence", "a", "b", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, bucket = None, None
        for batch in batches:
            paths = batch.column("path").to_pylist()
            borders = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for start, end in zip(borders, borders[1:]):
                if start == end:
                    continue
                if paths[start] != here:
                    here = paths[start]
                    with _open(here) as source:
                        bucket = IndexBucket.from_bytes(source.read())
                piece = batch.slice(start, end - start)
                slot = bucket.find(*(piece.column(c).to_numpy().view(np.uint64) for c in "ab"))
                piece, record = piece.filter(pa.array(slot >= 0)), bucket.records[slot[slot >= 0]]
                found = [pa.array(record[c].astype(np.int64)) for c in ("shard", "offset", "n")]
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("occurrence"), *found], ["key", "occurrence", "shard", "offset", "n"])

    return asked.mapInArrow(run, f"key {kind}, occurrence bigint, shard bigint, offset bigint, n bigint")


def fetch(store: IdStore, keys: DataFrame | None = None) -> DataFrame:
    """(key, occurrence, start, n, ids) of the asked documents, or of all: ids as little-endian 32-bit numbers, read from the files.

    ``keys`` has the columns key and occurrence (0 for the first document of a key). Keys that are not in
    the store give no row, and a key asked for twice gives one. ``start`` counts the ids of all documents before.
    """
    keys = store.table("entries").select("key", "occurrence") if keys is None else keys
    kind = keys.schema["key"].dataType.simpleString()
    files = store.table("shards").select("shard", "path", "width", "base")
    found = locate(store, keys).join(files, "shard")
    found = found.repartition(shuffle_partitions(keys), "shard").sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, source = None, None
        for batch in batches:
            paths, width = batch.column("path").to_pylist(), batch.column("width").to_numpy()
            offset, n, base = (batch.column(c).to_numpy() for c in ("offset", "n", "base"))
            at = 0
            while at < len(paths):
                end = at + 1
                while end < len(paths) and paths[end] == paths[at] and (offset[end] + n[end] - offset[at]) * width[at] <= READ_BYTES:
                    end += 1
                if paths[at] != here:
                    if source is not None:
                        source.close()
                    here, source = paths[at], _open(paths[at])
                wide = int(width[at])
                source.seek(int(offset[at]) * wide)
                span = int(offset[end - 1] + n[end - 1] - offset[at])
                ids = np.frombuffer(source.read(span * wide), "<u2" if wide == 2 else "<u4").astype("<u4")
                if len(ids) != span:
                    raise ValueError("a payload file ends too early")
                first = offset[at:end] - offset[at]
                cells = [ids[f : f + k].tobytes() for f, k in zip(first, n[at:end])]
                piece = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"), piece.column("occurrence"), pa.array(base[at:end] + offset[at:end]), piece.column("n"), pa.array(cells, pa.binary())],
                    ["key", "occurrence", "start", "n", "ids"],
                )
                at = end
        if source is not None:
            source.close()
        release()

    return found.mapInArrow(run, f"key {kind}, occurrence bigint, start bigint, n bigint, ids binary")
