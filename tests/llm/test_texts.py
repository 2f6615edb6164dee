"""Token counts, language, personal data and quality, row by row, against plain versions."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfline.llm import language, personal, quality
from shelfline.llm.common import text_view
from shelfline.llm.token_counts import Counter, TokenCounter, token_counts


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [
    "", "a'sb", "don't 's  's '' 'll 'lx 're'rx 've", "  a", "a  ", "\n's", "\n\n  x\t y", "'r", "x'r", "'l'l", "<|endoftext|>a <|endoftext|>", "<|endoftext|",
    "a" * 3000, " " * 3000 + "x", "é'sß١٢ ½ 中文字   a\u0085b", "'" * 50, "''s", "1's", "!'s", "a\r\n\r\nb", "\x1c\x1d a", "  ", " \n ", "😀😀 'd",
]


def test_tokens_of_odd_texts(spec, library):
    counter = TokenCounter(spec)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in ODD]
    assert counter.count(pa.array(ODD)).tolist() == want
    assert [int(counter.count(pa.array([t]))[0]) for t in ODD] == want


def test_tokens_of_random_texts(spec, library):
    rng, counter = random.Random(5), TokenCounter(spec)
    texts = ["".join(rng.choice("ab  '\nsrdevlt19!é中 TheinG") for _ in range(rng.randrange(200))) for _ in range(400)]
    assert counter.count(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_table_is_bounded(spec, library):
    counter = TokenCounter(spec, max_states=300)
    texts = [" ".join(f"some{i}word{i * 7} more{i * 31}" for i in range(k, k + 50)) for k in range(0, 400, 50)]
    assert counter.count(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.counter.keys) < 3000


def test_long_text_in_blocks(spec, library, monkeypatch):
    from shelfline.llm import token_counts as module

    monkeypatch.setattr(module, "BLOCK", 1000)
    text = " ".join(f"wörd{i}  don't\n\n" for i in range(900))
    assert TokenCounter(spec).count(pa.array([text])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_neighbours_by_spines(spec):
    counter = Counter(spec)
    assert counter.compatible(None, b"the")
    assert not counter.compatible(b"t", b"he")  # they would have merged
    assert counter.compatible(b" the", b" cat")


def test_token_table(spark, docs, odd_rows, library):
    out = token_counts(docs(odd_rows), public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    want = []
    for i, t, *_ in odd_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i is None, i or 0, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts(docs(odd_rows).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def _lengths(counts, text, langs, order=3, least=language.LEAST):
    """Code lengths by definition, from counts[lang][context][byte]."""
    kept = {c for l in langs for c, f in counts[l].items() if len(c) == 0 or sum(f.values()) >= least}
    out = []
    for l in langs:
        total = 0
        for i, b in enumerate(text):
            past = (b"\x00" * 0 + text[:i])[-order:]
            past = [256] * (order - len(past)) + list(past)  # 256: front
            context = next(tuple(past[order - k :]) for k in range(order, -1, -1) if tuple(past[order - k :]) in kept)
            bits = 0.0
            while True:
                f = counts[l].get(context, {})
                if f.get(b):
                    bits += -np.log2(f[b] / (sum(f.values()) + len(f)))
                    break
                if f:
                    bits += -np.log2(len(f) / (sum(f.values()) + len(f)))
                if not context:
                    bits += 8
                    break
                context = context[1:]
                while context not in kept:
                    context = context[1:]
            total += int(np.rint(bits * language.UNIT))
        out.append(total)
    return out


def test_code_lengths_by_definition():
    rng = random.Random(2)
    langs, texts = ["aa", "bb"], {"aa": [bytes(rng.choices(b"abc ", k=300)) for _ in range(5)], "bb": [bytes(rng.choices(b"bcd ", [5, 1, 1, 2], k=300)) for _ in range(5)]}
    counts, rows = {l: {} for l in langs}, {}
    for which, l in enumerate(langs):
        for t in texts[l]:
            padded = [256, 256, 256, *t]
            for i in range(3, len(padded)):
                for k in range(4):
                    f = counts[l].setdefault(tuple(padded[i - k : i]), {})
                    f[padded[i]] = f.get(padded[i], 0) + 1
                code = 0
                for b in padded[i - 3 : i + 1]:
                    code = code * 257 + (0 if b == 256 else b + 1)
                rows[which, code] = rows.get((which, code), 0) + 1
    items = sorted(rows.items())
    trees = language.compile_trees(langs, np.array([k[0] for k, _ in items]), np.array([k[1] for k, _ in items]), np.array([float(n) for _, n in items]))
    probes = [b"abc cab", b"", b"dddd", b"zq a", b"b b b b"]
    raw = np.frombuffer(b"".join(probes), np.uint8)
    got = trees.lengths(raw, np.cumsum([0, *map(len, probes)]))
    for p, g in zip(probes, got.tolist()):
        assert np.allclose(g, _lengths(counts, p, langs), atol=len(p) + 1)


def test_language_table(spark, docs, odd_rows, sf_dir):
    trained = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = language.identify(docs(odd_rows), trained).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        text = next(t for i, t, *_ in odd_rows if i == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in trained.languages and 0 < r.score <= 1
    assert language.train(docs(odd_rows).limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs(odd_rows), None).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    table = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = language.identify(table, language.train(table)).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count()


PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in PATTERNS[0].finditer(text)]
    out += [(1, *m.span()) for m in PATTERNS[1].finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in PATTERNS[2].finditer(text) if 16 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PATTERNS[3].finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789.+-@ ab()é") for _ in range(rng.randrange(60)))
        assert personal.base_spans(text) == plain_spans(text)
    assert personal.base_spans("4" + "0" * 14 + "2 a.b@c.d.e@f.g") == plain_spans("4" + "0" * 14 + "2 a.b@c.d.e@f.g")
    assert personal.base_spans("1" * 200_000) == []


def test_personal_table(spark, docs, odd_rows, sf_dir):
    judge = personal.fit(spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/documents.parquet"))
    rows = [*odd_rows, (30, "mail bob.x@host.example.com or bob (at) host.example.com", "en", "a"), (32, "write to bob (at) host.example.com", "en", "a"), (31, "call +1 (974) 555-3436, ip 10.0.0.300 and 10.0.0.3", "en", "a")]
    out = {(r.doc_id, i): r for i, r in enumerate(personal.find_personal(docs(rows), judge).collect())}
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for (i, _), r in out.items():
        base = [(personal.KINDS[k], s, e) for k, s, e in plain_spans(texts[i])]
        assert [tuple(x) for x in r.base] == base
        assert set(base) <= {tuple(x) for x in r.spans}
    clean = {r.doc_id: r.text for r in personal.redact(docs(rows), judge).collect()}
    assert clean[1] is None and "bob.x@" not in clean[30] and "[email]" in clean[30]
    assert clean[31].startswith("call [phone], ip 10.0.0.300 and [ip]")
    assert clean[5] == texts[5]
    assert personal.candidates(texts[32]) and personal._worth(np.frombuffer(texts[32].encode(), np.uint8), np.array([0, len(texts[32])])) == [0]


DISGUISED = [
    ("email", "bob.w (at) mail7.example.com"), ("email", "annaé@mail3.example.com"), ("ip", "97 . 51 . 17 . 173"),
    ("card", "4845.1681.1440.7329"), ("phone", "1 (974) 555-3436"), ("phone", "001 (243) 555-5526"),
]
HARMLESS = ["2019-03-07", "07.03.2019", "1998-2004", "4845.1681.1440.7328", "97 . 51 . 17 . 300", "a..b@mail..com", "token 64b39b6405768150e041"]


def test_disguised_spans(spark, docs, sf_dir):
    """What the corpus holds in disguise is found and redacted, also by a judge fitted on that corpus."""
    given = spark.read.parquet(sf_dir.replace("0.001", "0.1") + "/documents.parquet").select("doc_id", "text")
    prose = "they met on a rainy day, {} was all it said and nothing else"
    planted = [(10_000_000 + i, prose.format(s)) for i, (_, s) in enumerate(DISGUISED * 40)]
    for table in (given, given.union(spark.createDataFrame(planted, given.schema))):
        judge = personal.fit(table)
        rows = [(i, prose.format(s), "en", "a") for i, s in enumerate([*(s for _, s in DISGUISED), *HARMLESS])]
        at = prose.index("{}")
        found = {r.doc_id: [tuple(x) for x in r.spans] for r in personal.find_personal(docs(rows), judge).collect()}
        clean = {r.doc_id: r.text for r in personal.redact(docs(rows), judge).collect()}
        for i, (kind, s) in enumerate(DISGUISED):
            assert found[i] == [(kind, at, at + len(s))]
            assert clean[i] == prose.format(f"[{kind}]")
        for i, s in enumerate(HARMLESS, len(DISGUISED)):
            if not personal.base_spans(s):
                assert clean[i] == prose.format(s)


def test_judge_is_fitted_on_all_texts(spark, docs, monkeypatch):
    """Every example of every text is fitted or held out; thresholds equal those of the whole held-out list."""
    from pyspark.ml.classification import GBTClassifier

    many = "".join(f"write to a{i}@mail{i}.example.com today. " for i in range(300))
    assert len(list(personal.examples(many, 1))) == 900
    rows = [(i, f"call +1 (974) 555-{i:04} or 10.0.{i % 250}.{i % 90 + 1} on 2019-03-{i % 28 + 1:02}", "en", "a") for i in range(6000)]
    rows.append((6000, many, "en", "a"))
    weights = []
    fit = GBTClassifier.fit

    def seen(self, table, *more):
        own = table.withColumn("weight", table["weight"] if "weight" in table.columns else F.lit(1.0))
        weights.append(own.agg(F.sum("weight")).first()[0])
        return fit(self, table, *more)

    monkeypatch.setattr(GBTClassifier, "fit", seen)
    held = []
    thresholds = personal._thresholds
    monkeypatch.setattr(personal, "_thresholds", lambda table, judge: held.extend(table.collect()) or thresholds(table, judge))
    judge = personal.fit(docs(rows))
    total = weights[0] + sum(r.n for r in held)
    assert total == sum(len(list(personal.examples(t, i))) for i, t, *_ in rows) >= 6000 * 4
    assert weights[0] > 0.6 * total
    for kind in range(len(personal.KINDS)):
        own = [(p, r.label, r.n) for r, p in zip(held, judge.probability(np.array([r.x for r in held]))) if r.x[0] == kind]
        want = math.inf
        for p in sorted({p for p, *_ in own}, reverse=True):
            passed = [(label, n) for q, label, n in own if q >= p]
            if p > 0.5 and sum(label * n for label, n in passed) >= personal.PRECISION * sum(n for _, n in passed):
                want = p
        assert judge.thresholds[kind] == want
    assert sum(t < math.inf for t in judge.thresholds) >= 2


def test_trees_from_print():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 0 <= 2.0)\n      Predict: 1.0\n     Else (feature 0 > 2.0)\n      Predict: 2.0\n    Else (feature 1 > 0.5)\n     Predict: -3.0\n"
    judge = personal.Judge(personal.parse_trees(text, [1.0]), [1.0], [0.5] * 4)
    margins = np.log(judge.probability(np.array([[1.0, 0.0], [3.0, 0.0], [0.0, 1.0]])))
    assert np.allclose(np.exp(margins), 1 / (1 + np.exp([-2.0, -4.0, 6.0])))


def test_quality(spark, docs, odd_rows, sf_dir):
    where = sf_dir.replace("0.001", "0.1")
    table, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = quality.fit(table, labels)
    rows = quality.assess(table, model).join(labels, "doc_id").where("xxhash64(doc_id, 'quality') IS NOT NULL")
    clean, bad = rows.where("quality = 1 AND toxic = 0"), rows.where("quality = 0 OR toxic = 1")
    assert clean.where("keep").count() >= 0.995 * clean.count()
    assert bad.where("NOT keep").count() >= 0.93 * bad.count()
    odd = quality.assess(docs(odd_rows), model)
    assert odd.count() == len(odd_rows)
    assert odd.where("low_score IS NULL OR toxic_score IS NULL OR NOT low_score BETWEEN 0 AND 1").isEmpty()
    assert quality.fit(table, labels.limit(0)) is None
    assert quality.assess(docs(odd_rows), None).where("keep").count() == len(odd_rows)


def test_quality_on_rows_it_was_not_fitted_on(spark, sf_dir):
    """The model is fitted on the labels of two thirds of the documents and judged on those of the rest."""
    where = sf_dir.replace("0.001", "0.1")
    table, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    seen = labels.where("pmod(xxhash64(doc_id, 'split'), 3) < 2")
    unseen = labels.join(seen.select("doc_id"), "doc_id", "left_anti")
    rows = quality.assess(table, quality.fit(table, seen)).join(unseen, "doc_id")
    clean, bad = rows.where("quality = 1 AND toxic = 0"), rows.where("quality = 0 OR toxic = 1")
    assert clean.count() > 500 and bad.count() > 100
    assert clean.where("keep").count() >= 0.99 * clean.count()
    assert bad.where("NOT keep").count() >= 0.9 * bad.count()


def plain_rates(rows, q):
    """Shrunken rates of paths from (host, path, p) rows, with loops."""
    paths, hosts = {}, {}
    for host, path, p in rows:
        paths.setdefault((host, path), []).append(p[q])
        hosts.setdefault(host, []).append(p[q])

    def strength(mean, scatter, noise):
        extra = scatter - noise
        return min(1e6, max(1.0, mean * (1 - mean) / extra - 1)) if 0 < mean < 1 and extra > 0 else 1e6

    mean = sum(map(sum, hosts.values())) / sum(map(len, hosts.values()))
    rates = [sum(x) / len(x) for x in hosts.values()]
    k = strength(mean, np.var(rates), np.mean([mean * (1 - mean) / len(x) for x in hosts.values()]))
    host_rate = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    apart = [(sum(x) / len(x) - host_rate[h]) ** 2 for (h, _), x in paths.items()]
    k = strength(mean, np.mean(apart), np.mean([host_rate[h] * (1 - host_rate[h]) / len(x) for (h, _), x in paths.items()]))
    return {(h, p): (sum(x) + k * host_rate[h]) / (len(x) + k) for (h, p), x in paths.items()}


def test_assess_equals_plain_evaluation(spark, docs, odd_rows, sf_dir):
    """Posteriors of a small table from the classifier's probabilities, rates by loops and odds by hand; one id repeats."""
    where = sf_dir.replace("0.001", "0.01")
    table, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = quality.fit(table, labels)
    rows = [*odd_rows, *((r.doc_id % 40, r.text, r.lang, r.source) for r in table.limit(150).collect())]
    texts = pa.array([t for _, t, *_ in rows], pa.string())
    p = model.probability(quality.describe(*text_view(texts), model.evidence))
    sites = [(source, lang, p[i]) for i, (_, _, lang, source) in enumerate(rows)]
    odds = lambda x: np.log(x / (1 - x))
    want = []
    rates = [plain_rates(sites, q) for q in range(2)]
    for i, (key, *_) in enumerate(rows):
        out = [key]
        for q in range(2):
            rate = min(max(rates[q][sites[i][:2]], 1e-6), 1 - 1e-6)
            score = 1 / (1 + np.exp(-(odds(p[i][q]) + odds(rate) - odds(model.parts[q][2]))))
            out += [p[i][q], rates[q][sites[i][:2]], score]
        want.append((*out, max(out[3], out[6]) <= 0.5))
    got = [(r.doc_id, r.low_doc, r.low_path, r.low_score, r.toxic_doc, r.toxic_path, r.toxic_score, r.keep) for r in quality.assess(docs(rows), model).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *np.round(r[1:7], 9), r[7])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:7], b[1:7], rtol=1e-9, atol=1e-12) and a[7] == b[7]


def test_judge_equals_the_fitted_model(spark):
    """The trees read from the printed model give the probabilities of the model itself."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import DenseVector

    rng = np.random.default_rng(3)
    x = rng.random((500, 6)).round(3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] * x[:, 1] > 0.2)).astype(float)
    table = spark.createDataFrame([(DenseVector(v), float(t)) for v, t in zip(x, y)], ["features", "label"])
    model = GBTClassifier(maxIter=7, maxDepth=personal.DEPTH, seed=1, stepSize=0.3).fit(table)
    judge = personal.Judge(personal.parse_trees(model.toDebugString, list(model.treeWeights)), list(model.treeWeights), [0.5] * len(personal.KINDS))
    want = np.array([r.probability[1] for r in model.transform(table).collect()])
    assert np.allclose(judge.probability(x), want, rtol=1e-12)


def test_site_rates_shrink(spark):
    rows = [("big", "en", 0.9)] * 300 + [("small", "en", 0.9)] * 2 + [("other", "en", 0.1)] * 500 + [("third", "fr", 0.1)] * 400
    scores = spark.createDataFrame(rows, "host string, path string, low double")
    rate = {r.host: r.low_path for r in quality.site_rates(scores, "low").collect()}
    assert rate["big"] > rate["small"] > rate["other"] and abs(rate["big"] - 0.9) < 0.02


def test_other_tokenizer_files_are_refused():
    import json

    from shelfline.llm.token_counts import check_spec

    spec = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    check_spec(spec)
    token = {"content": "<x>", "lstrip": True}
    changes = [
        {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [token]},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": {**spec["model"], "ignore_merges": True}},
        {"model": {**spec["model"], "end_of_word_suffix": "</w>"}}, {"model": {"type": "Unigram"}},
    ]
    for change in changes:
        with pytest.raises(ValueError):
            check_spec(spec | change)
    with pytest.raises(ValueError):
        check_spec(json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()))
