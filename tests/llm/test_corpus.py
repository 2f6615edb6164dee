"""Operators over the whole corpus, against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import decontaminate, host_rules, jaccard, mixing, substrings, warc
from shelfline.llm.common import drawn

from .conftest import PROSE


def near_copies(seed=3):
    """Groups of near copies with few and many changes, exact copies, and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, passage = [], " ".join(rng.choices(words, k=60))
    for group in range(6):
        base = rng.choices(words, k=rng.randrange(30, 200))
        for copy in range(8):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = rng.choice(words)
            joined = " ".join(text)
            out.append(joined + " " + passage if rng.random() < 0.2 else joined)
        out.append(" ".join(base))
    out += [out[0]] * 4 + [out[0].upper()] + [" ".join(rng.choices(words, k=50)) for _ in range(15)]
    rng.shuffle(out)
    return [(i * 3, t, "en", f"s{i % 3}") for i, t in enumerate(out)]


def plain_components(rows):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t, *_ in rows:
        w = split.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (key, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), 1 << 62 if key is None else key)
    name = lambda i: None if least[find(i)] == 1 << 62 else least[find(i)]
    return Counter((key, len(sets[i]), name(i)) for i, (key, *_) in enumerate(rows))


@pytest.mark.parametrize("which", ["copies", "odd"])
def test_jaccard(docs, odd_rows, which):
    rows = near_copies() if which == "copies" else odd_rows
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs(rows)).collect())
    assert got == plain_components(rows)


def test_pieces_have_bounded_rows():
    import pyarrow as pa

    from shelfline.llm.common import gathered

    batch = pa.RecordBatch.from_arrays([pa.array([""] * 230_000 + ["x" * 9_000_000, "y"])], ["text"])
    pieces = list(gathered([batch, batch]))
    assert sum(p.num_rows for p in pieces) == 2 * batch.num_rows
    assert max(p.num_rows for p in pieces) < 0xFFFF


def test_jaccard_of_nothing(docs):
    assert jaccard.jaccard_components(docs([]).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 9), (5, 5)], "x long, y long")
    assert {r.rid: r.label for r in jaccard.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def plain_removal(rows, length=50):
    first, out = {}, []
    for key, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], 1 << 62 if key is None else key)
    for key, t, *_ in rows:
        data, keep = (t or "").encode(), []
        number, cover = 1 << 62 if key is None else key, np.zeros(len((t or "").encode()), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < number:
                cover[i : i + length] = True
        step = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        keep = bytes(np.frombuffer(data, np.uint8)[~cover]) if data else b""
        out.append((key, len(data), int(cover.sum()), int((step == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("which", ["copies", "odd"])
def test_substrings(docs, odd_rows, which):
    rows = near_copies(5) if which == "copies" else odd_rows
    got = substrings.repeated_substrings(docs(rows)).drop("starts", "ends").collect()
    assert Counter(tuple(r) for r in got) == plain_removal(rows)


def test_substrings_of_a_hot_name(spark, docs, monkeypatch):
    """A common line in varying surroundings: no name keeps many different fragments, and no repeat is lost."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    noise = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(40, 90)))
    line = " this line stands in a great many documents of the corpus, with others around it é "
    texts = [noise() + (line if i % 3 else line[10:45]) + noise() for i in range(400)]
    rows = [(i * 7 % 400, t, "en", "s") for i, t in enumerate([*texts, *texts[:20], "ab" * 300, None])]
    monkeypatch.setattr(substrings, "HOT", 20)
    table = docs(rows).select("text", F.xxhash64("text").alias("mark")).where("text IS NOT NULL")
    hot = substrings.hot_names(table, sum(len(t.encode()) for _, t, *_ in rows if t))
    data = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    most = lambda found: max(Counter(n for n, _ in set(zip(found[0].tolist(), found[1].tolist()))).values())
    assert len(hot) and most(substrings.fragments(raw, offsets)) > 100
    assert most(substrings.fragments(raw, offsets, hot=hot)) < 20
    got = substrings.repeated_substrings(docs(rows)).drop("starts", "ends").collect()
    assert Counter(tuple(r) for r in got) == plain_removal(rows)


def test_substrings_of_nothing(docs):
    assert substrings.repeated_substrings(docs([]).limit(0)).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"\x00\x01a", b"abcdefgh"])
def test_two_stage_order(letters):
    rng = random.Random(7)
    for n in (1, 2, 50, 400):
        data = np.frombuffer(bytes(rng.choices(letters, k=n)) + b"\x00", np.uint8)
        smaller = substrings.suffix_types(data)
        text = data.tobytes() + b""
        for i in range(n):
            assert smaller[i] == (text[i:] < text[i + 1 :]) or data[i:].max() == 0
        order = substrings.two_stage_order(data, np.ones(n + 1, bool), smaller)
        assert sorted(order.tolist()) == list(range(n + 1))
        padded = text + b"\x00" * 60
        heads = [padded[i : i + 50] for i in order]
        assert heads == sorted(heads)
        prefixes = substrings.common_prefixes(data, order)
        for k in range(1, n + 1):
            a, b = heads[k - 1], heads[k]
            assert prefixes[k] == next((j for j in range(50) if a[j] != b[j]), 50)


def plain_hits(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("null" if name is None else str(name))
    out = []
    for key, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    found |= owners
                    hit.update(range(i, i + size))
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


ITEMS = [
    (1, "Seven old men sit by the cold river and talk about rain"),
    (2, "fox jumps"),
    (3, None),
    (4, "..."),
    (5, "fox jumps"),
    (6, "a a a a a a a a a a a a"),
    (None, "中文字"),
    (7, "quick brown fox jumps over a lazy dog while seven old men"),
]
HOLDERS = [
    (50, "A a a a a a a a a a, a a a a b", "en", "a"),
    (51, "fox jumps fox jumps fox", "en", "a"),
    (52, "SEVEN old men sit by the cold river and talk about snow, talk about rain", "en", "a"),
    (53, "fox", "en", "a"),
]


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, docs, odd_rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = odd_rows + HOLDERS
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.benchmark_hits(docs(rows), items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == plain_hits(rows, ITEMS)
    clean = decontaminate.decontaminated(docs(rows), items)
    assert clean.columns == docs(rows).columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[1] is None and texts[53] == "fox" and "river" not in texts[52] and texts[51] == "\n fox"
    assert decontaminate.benchmark_hits(docs(rows), items.limit(0)).where("n_hit > 0").isEmpty()


def test_many_blocks_and_clashing_names(spark, docs, odd_rows, monkeypatch):
    """Fifty blocks of items find what one block finds; columns may have the names used inside."""
    rows = odd_rows + HOLDERS
    items = spark.createDataFrame([*ITEMS, *((100 + i, f"talk about rain number {i}") for i in range(80)), (9, PROSE)], "item_id long, text string")
    names = ["_n", "_hit", "_items", "_spans", "_row", "_runs", "_words", "__N"]
    table = docs(rows).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    want = [Counter(map(str, f(table, items).collect())) for f in (decontaminate.benchmark_hits, decontaminate.decontaminated)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", decontaminate_bytes(items) // 25)
    assert decontaminate._blocks(items, "item_id", "text")[0] >= 50
    got = [Counter(map(str, f(table, items).collect())) for f in (decontaminate.benchmark_hits, decontaminate.decontaminated)]
    assert got == want
    assert decontaminate.decontaminated(table, items).columns == table.columns


def decontaminate_bytes(items):
    return items.agg(F.sum(F.octet_length("text") + 64)).first()[0]


def test_one_repeated_key_is_sampled(spark, docs):
    """Rows that share a key, or have none, are drawn each by itself."""
    for key in (None, 7):
        table = docs([(key, f"text {i}", "en", "a") for i in range(4000)])
        some = drawn(table, 1 << 18, "doc_id")
        assert 800 < some.count() < 1200 and some.columns == table.columns
    same = docs([(7, "same", "en", "a")] * 4000)
    assert 800 < drawn(same, 1 << 18, "doc_id", "text").count() < 1200


def test_rules(docs, odd_rows):
    def plain(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)

    rows = odd_rows + [(60, "a b c a b c\na b c\n\na b c # |", "en", "z"), (61, ("x y z " * 40), "en", "z"), (62, "only three words", None, None)]
    out = host_rules.host_rules(docs(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((i, *plain(t)) for i, t, *_ in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    assert host_rules.host_rules(docs(rows).limit(0)).count() == 0


def test_host_verdicts(docs):
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(i, "short", "en", "bad") for i in range(95)] + [(95 + i, good, "en", "bad") for i in range(5)]
    rows += [(200 + i, good, "en", f"h{i % 20}") for i in range(400)] + [(700, "short", "en", "tiny"), (701, good, "en", "tiny")]
    kept = {r.doc_id: r.kept for r in host_rules.host_rules(docs(rows)).collect()}
    assert not kept[96] and kept[205]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_warc(spark, tmp_path):
    big, small = "<p>größer</p>" * 20, "<p>"
    rows = [(5, "http://a/\r\nX: y", big), (3, "http://b/", big), (9, None, big), (1, "http://c/", small), (2, "http://c/", small), (7, "u", None), (8, "u", ""), (None, "n", big)]
    rows += [(20 + i, f"http://d/{i}", f"<html>page {i % 40} " + "text " * 50 + "</html>") for i in range(120)] + [(3, "http://b/", big)]
    manifest = warc.write_archives(pages(spark, rows), str(tmp_path / "out"))
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(manifest).collect()
    first = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, 1 << 60), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        copy = html in first and (i is None or i > first[html])
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first[html] if copy else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    path = manifest.first().path
    with open(path, "rb") as f:
        assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")
    records = list(warc.read_archive(path, chunk=7))
    assert len(records) == manifest.first().records
    with open(path, "r+b") as f:
        f.truncate(manifest.first().bytes - 3)
    with pytest.raises(Exception):
        list(warc.read_archive(path))


def test_warc_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []).limit(0))).count() == 0


def plain_shares(children, share):
    """Water filling: {name: (cap, weight)} to shares, by repeated redistribution."""
    out, open_ = dict.fromkeys(children, 0.0), {c for c, (_, w) in children.items() if w > 0}
    left = share
    while open_:
        total = sum(children[c][1] for c in open_)
        full = {c for c in open_ if left * children[c][1] / total >= children[c][0]}
        if not full:
            for c in open_:
                out[c] = left * children[c][1] / total
            break
        for c in full:
            out[c] = children[c][0]
        left -= sum(children[c][0] for c in full)
        open_ -= full
    return out


def test_shortages_go_to_siblings_first(spark):
    rows = [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d1", "fr", "c", 5), ("d2", "en", "a", 500), ("d2", "de", "e", 40)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    from pyspark.sql import functions as F

    weights = {"domain": {"d1": 3}, "source": {"b": 2}}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(leaves, F.lit(800), weights, 1).collect()}
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    caps = lambda p: sum(r[3] for r in rows if r[: len(p)] == p)
    for d, ds in plain_shares({d: (caps((d,)), w("domain", d)) for d in ("d1", "d2")}, 800).items():
        langs = sorted({r[1] for r in rows if r[0] == d})
        for lang, ls in plain_shares({x: (caps((d, x)), 1) for x in langs}, int(ds)).items():
            own = {r[2]: (r[3], w("source", r[2])) for r in rows if r[:2] == (d, lang)}
            for s, share in plain_shares(own, int(ls)).items():
                assert got[d, lang, s] == int(share)


def test_mix(docs, odd_rows):
    rows = odd_rows + [(100 + i, PROSE + f" {i}", "fr" if i % 5 else "de", f"s{i % 4}") for i in range(80)]
    out = mixing.mix(docs(rows), {"lang": {"de": 5}}, share=0.9, max_epochs=3).collect()
    tokens = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows)
    taken, leaves = sum(r.take_tokens for r in out), {(r.domain, r.lang, r.source) for r in out}
    assert int(0.9 * tokens) - 3 * len(leaves) - 10 <= taken <= int(0.9 * tokens)
    assert all(0 <= r.take_tokens <= r.n_tokens and 1 <= r.epoch <= 3 for r in out)
    for leaf in leaves:
        own = [r for r in out if (r.domain, r.lang, r.source) == leaf]
        last = max(r.epoch for r in own)
        assert sum(r.take_tokens < r.n_tokens for r in own) <= 1
        assert all(r.take_tokens == r.n_tokens for r in own if r.epoch < last)
    assert mixing.mix(docs(rows).limit(0)).count() == 0


def one_group(n, seed=1):
    """Near copies of one text of 120 words, two random words of each changed: links are many and all in few components."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base, out = rng.choices(words, k=120), []
    for i in range(n):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(120)] = rng.choice(words)
        out.append((i, " ".join(text), "en", "a"))
    return out


def test_pairs_grow_with_the_group(spark, docs, monkeypatch):
    """A group of near copies is verified with about as many pairs as it has texts, and no link between components is lost."""
    real, asked = jaccard.verified, []

    def counted(pairs, sets, *rest):
        pairs = jaccard.stage(pairs, "test-pairs")
        asked.append(pairs.count())
        return real(pairs, sets, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    totals = []
    for n in (200, 600):
        asked.clear()
        rows = one_group(n)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(rows)).collect())
        assert got == plain_components(rows)
        totals.append(sum(asked))
    assert totals[0] <= 3 * 200 and totals[1] <= 3 * 600


def test_both_ways_of_uniting_edges(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(rows, "x bigint, y bigint").repartition(4).where("x <> y")
    small = {r.rid: r.label for r in jaccard.components(edges).collect()}
    monkeypatch.setattr(jaccard, "FEW_EDGES", 10)
    assert {r.rid: r.label for r in jaccard.components(edges).collect()} == small
    assert len({small[1000 + i] for i in range(41)}) == 1


def test_mixed_texts(spark, docs, odd_rows):
    """With texts, the mix has the same rows, and every text is cut behind the tokens it gives."""
    rows = [*odd_rows, *((100 + i, f"  one\ttwo\n three {i} " + "w " * (i % 9), ("en", "de")[i % 2], f"s{i % 3}") for i in range(60))]
    weights = {"lang": {"en": 3}}
    plain = mixing.mix(docs(rows), weights, share=0.7)
    out = mixing.mix(docs(rows), weights, share=0.7, keep_text=True)
    assert out.columns == [*plain.columns, "text"]
    assert Counter(tuple(r) for r in plain.collect()) == Counter(tuple(r)[:-1] for r in out.collect())
    split = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {}
    for key, text, *_ in rows:
        texts.setdefault(key, []).append(text)
    cut = 0
    for r in out.collect():
        assert len(split.findall(r.text or "")) == r.take_tokens
        if r.take_tokens == r.n_tokens:
            assert r.text in texts[r.doc_id]
        else:
            cut += 1
            assert any(split.findall(t or "")[: r.take_tokens] == split.findall(r.text) for t in texts[r.doc_id])
    assert cut
    assert mixing.mix(docs([]).limit(0), weights, keep_text=True).count() == 0
