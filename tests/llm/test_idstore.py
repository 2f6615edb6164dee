"""Token ids in raw files: the perfect hash, exact round trips, access by key."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import idstore
from shelfline.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
END = 1


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


def stored(spark, docs, rows, tokenizer, **options):
    """Write and read a store, compare every document with the library, and return the rows."""
    store = idstore.write_store(docs(rows), PATH, **options)
    read = idstore.fetch(store).collect()
    want = defaultdict(list)
    for key, text, *_ in rows:
        want[key].append(ids_of(tokenizer, text))
    got = defaultdict(list)
    for r in read:
        got[r.key].append(numbers(r.ids))
        assert len(numbers(r.ids)) == r.n
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    # Ascending keys, a null one first; every start is the sum of what stands before; occurrences count up.
    placed = sorted(read, key=lambda r: r.start)
    assert [r.key for r in placed] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    total, seen = 0, defaultdict(int)
    for r in placed:
        assert (r.start, r.occurrence) == (total, seen[r.key])
        total += r.n
        seen[r.key] += 1
    return store, read


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 1000, 50_000):
        a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.int64).view(np.uint64)
        b[: n // 3], a[n // 3 : n // 2] = 7, 9  # pairs that share one of the two hashes
        found = idstore.PerfectHash.build(a, b)
        assert sorted(found.slots(a, b)) == list(range(n))
    with pytest.raises(ValueError):
        idstore.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_bucket_round_trip_and_strangers():
    rng = np.random.default_rng(6)
    a, b, c, d = rng.integers(0, 1 << 63, (4, 20_000), dtype=np.int64).view(np.uint64)
    numbers = np.arange(20_000)
    bucket = idstore.IndexBucket.from_bytes(idstore.IndexBucket.build(a, b, numbers, 2 * numbers, 3 * numbers).to_bytes())
    record = bucket.records[bucket.find(a, b)]
    assert (record["shard"] == numbers).all() and (record["offset"] == 2 * numbers).all() and (record["n"] == 3 * numbers).all()
    assert (bucket.find(c, d) >= 0).sum() == 0
    with pytest.raises(ValueError):
        idstore.IndexBucket.from_bytes(b"something else")


def test_odd_rows(spark, docs, odd_rows, tokenizer):
    # Upper case, marks that follow a space, all kinds of white space, texts that look like special tokens.
    odd = "Á ́b é f g\x1ch\x85i İΣ <|endoftext|> <|startoftext|>x It's \t\r\n don't 123 가"
    rows = [*odd_rows, (-5, odd, "en", "a"), (1 << 40, odd * 3, "en", "a"), (None, odd, "en", "a"), (None, None, None, None)]
    stored(spark, docs, rows, tokenizer)
    stored(spark, docs, rows, tokenizer, partition_bytes=1000, file_ids=50, bucket_keys=3)


def test_random_texts(spark, docs, tokenizer):
    rng = random.Random(8)
    letters = ["'S", "<|ENDOFTEXT|>", "Å", "Ø", "ǅ", "ª", "²", "¼", "\xad", "\xa0", "ŉ", "x'll", "\x01", "a", "B", "é", "é", " ", " ", "\n", "\t", "́", "'s", "'", "1", "中", "😀", "<|endoftext|>", "　", "\x1d", "ß", "İ", "-"]
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 60))), "en", "s") for i in range(800)]
    stored(spark, docs, rows, tokenizer, file_ids=200, bucket_keys=37)


def test_one_key_over_many_files(spark, docs, tokenizer):
    """A key with most of the rows fills whole files, one file begins and ends inside it, and occurrences go on."""
    rows = [(1, "first", "en", "a")] * 5 + [(2, f"some words {i % 40}", "en", "a") for i in range(300)] + [(3, "last", "en", "a"), (None, "none", "en", "a")]
    store, read = stored(spark, docs, rows, tokenizer, file_ids=20, bucket_keys=50)
    assert store.table("shards").count() > 30
    assert sorted(r.occurrence for r in read if r.key == 2) == list(range(300))


def test_access_by_key(spark, docs, tokenizer):
    rows = [(i, f"text number {i} " * (i % 7), "en", "a") for i in range(200)] + [(7, "again", "en", "a")]
    store = idstore.write_store(docs(rows), PATH, bucket_keys=20)
    asked = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (150, 0), (150, 0), (150, 1), (999, 0), (None, 0)], "key bigint, occurrence int")
    got = {(r.key, r.occurrence): numbers(r.ids) for r in idstore.fetch(store, asked).collect()}
    assert sorted(got) == [(7, 0), (7, 1), (150, 0)]
    assert got[150, 0] == ids_of(tokenizer, rows[150][1])
    assert sorted([got[7, 0], got[7, 1]]) == sorted([ids_of(tokenizer, rows[7][1]), ids_of(tokenizer, "again")])


def test_empty_table_and_no_end(spark, docs, tokenizer):
    assert idstore.fetch(idstore.write_store(docs([]), PATH)).collect() == []
    read = idstore.fetch(idstore.write_store(docs([(1, "a b", "en", "a"), (2, None, "en", "a")]), PATH, end=None)).collect()
    assert {r.key: numbers(r.ids) for r in read} == {1: ids_of(tokenizer, "a b")[:-1], 2: []}


def test_every_plain_character(tokenizer):
    """Words of all characters of the shorter way, alone and beside others, are what the whole tokenizer gives."""
    encoder = idstore.Encoder(open(PATH, encoding="utf-8").read(), None)
    assert encoder.pattern is not None
    for c in map(chr, range(1, 0x260)):
        for word in (c, f"a{c}", f"{c}B", f"'{c}", f"x{c}.,{c}9", f"{c}\u0331", f"h{c}'ll"):
            assert np.frombuffer(encoder.encode([word])[0], encoder.kind).tolist() == ids_of(tokenizer, word)[:-1], repr(word)


def test_words_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(idstore, "KNOWN_WORDS", 5)
    encoder = idstore.Encoder(open(PATH, encoding="utf-8").read(), None)
    for i in range(40):
        text = f"one Two w{i}x, {i} é{i % 3}"
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == ids_of(tokenizer, text)[:-1]
        assert len(encoder.words) <= 12 and len(encoder.older) <= 12


def test_wide_ids():
    encoder = idstore.Encoder(open(PATH, encoding="utf-8").read(), 1 << 20)
    assert encoder.kind.itemsize == 4
    with pytest.raises(ValueError):
        idstore.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read(), 1)


def test_query(spark, sf_dir, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op12_token_ids"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.asc_nulls_first("doc_id")).select("doc_id", "text").collect()
    total = 0
    for key, text in docs:
        ids = ids_of(tokenizer, text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (total, len(ids), crc)
        total += len(ids)
    assert len(got) == len(docs)
