"""WARC archives with one Zstandard dictionary in front and one frame per record.

An archive file is a skippable frame that holds a dictionary (built from a sample of the
records), then every record as a frame of its own, compressed with that dictionary. So a
reader can seek to any frame, and small records still compress well.

Records whose payload was already archived are *revisits*: they carry the digest and the
record they refer to, not the payload. The first occurrence is found by a grouped minimum over
digests (summed up before the shuffle), and rows meet it by an equi-join that Spark can split
where one payload is very frequent. Files are written by the tasks straight into the shared
folder under names that no other attempt uses; only the files of successful tasks are listed
in the manifest table, so a lost executor leaves at most an unlisted file.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from shelfline.lineage import fresh_path, stage
from shelfline.llm.common import drawn, ship

#: Leading skippable frame of dictionary-compressed WARC files; a fixed value of the format.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed value of the WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records (and bytes of each) from which the dictionary is built, its size, and the size of an archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 400, 32 << 10, 64 << 10, 64 << 20
DATE = "1970-01-01T00:00:00Z"


@dataclass
class Record:
    """One record as it stands in an archive."""

    fields: dict[str, str]
    http: bytes
    payload: bytes


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """A response record, or a revisit without payload where ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, http, payload)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; with too few of them, the samples themselves are its content."""
    samples = [s for s in samples if s]
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


class ArchiveWriter:
    """Writes records to one archive file below ``folder`` (any place pyarrow can reach)."""

    def __init__(self, folder: str, dictionary: bytes, level: int = 3) -> None:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path, self.records, self.size = f"{folder}/{name}", 0, 0
        self.out = system.open_output_stream(f"{base}/{name}", compression=None)
        found = _dictionary(dictionary)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=found) if found else zstandard.ZstdCompressor(level=level)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def read_archive(path: str, chunk: int = 32 << 10) -> Iterator[Record]:
    """The records of one archive, frame by frame."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError("no dictionary frame in front")
        found = _dictionary(source.read(size))
        unpacker = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
        rest = source.read(chunk)
        while rest:
            frame, parts = unpacker.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data or source.read(chunk)
                    break
                rest = source.read(chunk)
                if not rest:
                    raise ValueError("an archive ends inside a frame")
            yield parse_record(b"".join(parts))


def plan_records(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): payloads of ``least`` bytes or more that a smaller page_id has are revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    copy = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("first").isNotNull() & copy, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes), already materialised.

    A null html is an empty payload; a null url leaves the target out. Payloads under ``least``
    bytes are always responses. Repeated rows with the smallest page_id are all responses; a row
    without page_id is a revisit if any row with an id has its payload. Other columns are
    ignored. An empty table writes nothing. The dictionary comes from a bounded sample
    (``SAMPLE_RECORDS`` records, ``SAMPLE_BYTES`` of each).
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    # A share of the rows chosen by a hash, about SAMPLE_RECORDS of them whatever the number of rows.
    share = min(1 << 20, -(-(SAMPLE_RECORDS << 20) // max(1, pages.count())))
    some = drawn(pages.select("page_id", "html"), share, "page_id").where("html IS NOT NULL")
    some = some.select("page_id", F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(2 * SAMPLE_RECORDS).collect()
    samples = [record_bytes(r.page_id, None, r.html.encode(), hashlib.sha256(r.html.encode()).hexdigest(), None) for r in some]
    dictionary = train_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                if writer is None:
                    writer = ArchiveWriter(folder, dictionary)
                writer.add(record_bytes(page_id, url, html.encode(), digest, refers_to))
                if writer.size >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        paths, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return stage(plan_records(pages, least).mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the listed archives.

    The digest of a response is computed from the payload that was read and must equal the
    record's own; a revisit has the digest and length of the payload it refers to.
    """
    ship(manifest.sparkSession)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(r: Record) -> tuple:
        digest, kind = r.fields["WARC-Payload-Digest"].removeprefix("sha256:"), r.fields["WARC-Type"]
        size = int(next(x for x in r.http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        if kind == "response" and (hashlib.sha256(r.payload).hexdigest() != digest or len(r.payload) != size):
            raise ValueError("a payload differs from its digest")
        number = lambda x: None if x is None else int(x)
        return number(r.fields.get("X-Page-Id")), r.fields.get("WARC-Target-URI"), size, digest, kind, number(r.fields.get("X-Refers-To-Page-Id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                for record in read_archive(path):
                    rows.append(row(record))
                    if len(rows) == 5000:
                        yield out()
                        rows = []
        if rows:
            yield out()

    spread = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
