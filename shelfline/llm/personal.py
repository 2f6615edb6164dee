"""Personal data: wide generators, boosted trees over candidates, calibrated thresholds.

Base spans follow fixed patterns and always count. Around them, generators of high recall
propose overlapping candidates of the same kinds: addresses with odd letters or a spelled-out
at sign, numbers in groups, calls without a plus, four number parts with blanks or too large.
Gradient-boosted trees judge a candidate by its format and its surroundings. They learn from all
texts of the corpus itself: base spans, also disguised the way the generators allow
(positives), against spoiled ones in their place and candidates that fail a hard check
(negatives): check digit, size of a number part, count of digits, shape of a date, letters
right beside a number, empty parts of an address. Other candidates have no label, as they may
be personal. On the third of the texts that was not fitted, each kind gets the least threshold
at which ``PRECISION`` of what passes is positive. Chosen candidates that fail no hard check
and overlap neither a base span nor a more probable choice are added.

Only texts with a digit, an at sign or one that is spelled out can hold a span, and only those
are decoded. Only the distinct examples leave their partition, with the number of times they occur.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.lineage import scratch, stage
from shelfline.llm.common import ship, slices, text_view
from shelfline.operators.running import running_total_by

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Wide patterns of the generators.
_WIDE = (
    (0, re.compile(r"(?<!\S)[^\s@<>()\[\]{}|,;:\"']{1,64}(?:@| ?[(\[] ?at ?[)\]] ?)[^\s@<>()\[\]{}|,;:\"']+\.[^\W\d_]{2,24}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:\+|00)?[(]?[0-9][ ()./0-9-]{5,20}[0-9](?![0-9])")),
)
_EMPTY_PART = re.compile(r"^\.|\.\.|\.(?:@| ?[(\[])|[@)\]] ?[.-]|-\.|\.-")
_YEAR, _DAY = r"(?:19|20)[0-9]{2}", r"(?:0?[1-9]|[12][0-9]|3[01])"
#: Dates, also with an hour behind them, and spans of years.
_DATE = re.compile(rf"(?:{_YEAR}([./ -]){_DAY}\1{_DAY}|{_DAY}([./ -]){_DAY}\2{_YEAR})(?: [0-9]{{1,2}})?|{_YEAR} ?[-/] ?{_YEAR}")
#: Required precision, trees and their depth.
PRECISION, TREES, DEPTH = 0.98, 12, 3
#: Characters before and behind a candidate that its features see.
_LEFT, _RIGHT = 24, 12
#: Examples that a task puts together at once, and distinct examples of a partition of the fit.
AT_ONCE, FIT_ROWS = 1 << 13, 1 << 17
_NEAR = ("mail", "tel", "phone", "call", "card", "visa", "ip", "host", "token", "id", "no", "=")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((0, begin, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[Span]:
    """What the generators propose; candidates may overlap."""
    return [(kind, m.start(), m.end()) for kind, pattern in _WIDE for m in pattern.finditer(text)]


def impossible(text: str, span: Span) -> bool:
    """Whether a candidate fails a hard check of its kind."""
    kind, start, end = span
    s = text[start:end]
    if kind == 0:
        return bool(_EMPTY_PART.search(s))
    if kind == 1:
        return any(int(p) > 255 for p in re.findall("[0-9]+", s))
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return True
    digits = _digits(s)
    if kind == 2:
        return not (13 <= len(digits) <= 19 and luhn(digits))
    return not 8 <= len(digits) <= 15 or bool(_DATE.fullmatch(s) or _WIDE[1][1].fullmatch(s))


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and its surroundings."""
    kind, start, end = span
    s = text[start:end]
    digits = _digits(s)
    runs = [len(r) for r in re.findall("[0-9]+", s)]
    left, right = text[max(0, start - _LEFT) : start].lower(), text[end : end + _RIGHT].lower()
    before, after = left[-1:] or " ", right[:1] or " "
    out = [
        float(kind), len(s), len(digits), sum(c.isalpha() for c in s), sum(not c.isalnum() for c in s), len(runs), max(runs, default=0),
        min(runs, default=0), s.count("."), s.count("@"), s.count(" "), s.count("-"), s.startswith("+"), "(" in s, luhn(digits) if digits else False,
        len(set(digits)), s.isascii(), bool(runs) and max(map(int, re.findall("[0-9]{1,4}", s))) <= 255,
        before.isalnum(), before.isspace(), before in "\"'([{<", before in ".,;:", after.isalnum(), after.isspace(), after in "\"')]}>", after in ".,;:",
        sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), sum(not c.isalnum() and not c.isspace() for c in left),
    ]
    return [float(x) for x in out] + [float(word in left) for word in _NEAR]


def _around(text: str, span: Span) -> tuple[str, Span]:
    """The part of the text that the features of a span see: a long text is not copied for each of its spans."""
    kind, start, end = span
    left = max(0, start - _LEFT)
    return text[left : end + _RIGHT], (kind, start - left, end - left)


def _disguised(text: str, span: Span, rng: random.Random) -> tuple[str, Span] | None:
    """The text with a base span written in another way that a generator accepts."""
    kind, start, end = span
    s = text[start:end]
    if kind == 0:
        changed = rng.choice([s.replace("@", " (at) ", 1), s.replace("@", "é@", 1)])
    elif kind == 1:
        changed = s.replace(".", " . ")
    elif kind == 2:
        changed = ".".join(re.findall("[0-9]{1,4}", _digits(s)))
    else:
        changed = rng.choice([s[1:], "00" + s[1:]])
    return text[:start] + changed + text[end:], (kind, start, start + len(changed))


def _spoiled(text: str, span: Span, rng: random.Random) -> tuple[str, Span] | None:
    """The text with a base span that only looks like one: a hard check of its kind fails."""
    kind, start, end = span
    s = text[start:end]
    if kind == 0:
        made = rng.choice([s.replace("@", ".@", 1), s.replace("@", "@.", 1), s.replace("@", " (at) -", 1)])
    elif kind == 1:
        parts = s.split(".")
        parts[rng.randrange(4)] = str(rng.randrange(256, 1000))
        made = ".".join(parts)
    elif kind == 2:
        made = "".join(rng.choice("0123456789") for _ in range(end - start))
    else:
        year, month, day = rng.randrange(1950, 2050), rng.randrange(1, 13), rng.randrange(1, 29)
        made = rng.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}-{year + 3}", "+" + str(rng.randrange(10**5, 10**7))])
    changed = text[:start] + made + text[end:], (kind, start, start + len(made))
    return changed if impossible(*changed) else None


def examples(text: str, seed: int) -> Iterator[tuple[float, list[float]]]:
    """Labelled candidates of one text, all of them."""
    rng, base = random.Random(seed), base_spans(text)
    for span in base:
        near = _around(text, span)
        yield 1.0, features(*near)
        for label, made in ((1.0, _disguised(*near, rng)), (0.0, _spoiled(*near, rng))):
            if made:
                yield label, features(*made)
    taken = _union(base)
    for kind, start, end in candidates(text):
        if _free(taken, start, end) and impossible(text, (kind, start, end)):
            yield 0.0, features(text, (kind, start, end))


@dataclass
class Judge:
    """Boosted trees as arrays, and the threshold of each kind."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]
    thresholds: list[float]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(rows))
        for (feature, bound, left, right, value), weight in zip(self.trees, self.weights):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                inner = left[node] >= 0
                go_left = rows[np.arange(len(rows)), np.maximum(feature[node], 0)] <= bound[node]
                node = np.where(inner, np.where(go_left, left[node], right[node]), node)
            margin += weight * value[node]
        return 1 / (1 + np.exp(-2 * margin))


def parse_trees(description: str, weights: list[float]) -> list[tuple[np.ndarray, ...]]:
    """Trees from a model's printed form."""
    trees: list[list[list[float]]] = []
    stack: list[tuple[int, int]] = []
    for line in description.splitlines():
        if re.match(r"\s*Tree \d+", line):
            trees.append([])
            stack = []
            continue
        if not trees:
            continue
        nodes = trees[-1]
        if m := re.match(r"\s*If \(feature (\d+) <= (\S+)\)", line):
            _attach(nodes, stack, [float(m[1]), float(m[2]), -2.0, -2.0, 0.0])
            stack.append((len(nodes) - 1, 2))
        elif m := re.match(r"\s*Predict: (\S+)", line):
            _attach(nodes, stack, [-1.0, 0.0, -1.0, -1.0, float(m[1])])
    out = []
    for nodes in trees:
        t = np.array(nodes)
        out.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
    if len(out) != len(weights):
        raise ValueError("the printed model has another number of trees")
    return out


def _attach(nodes: list[list[float]], stack: list[tuple[int, int]], node: list[float]) -> None:
    nodes.append(node)
    while stack:
        parent, side = stack[-1]
        if nodes[parent][side] == -2.0:
            nodes[parent][side] = len(nodes) - 1
            return
        if side == 2:
            stack[-1] = (parent, 3)
        else:
            stack.pop()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Judge | None:
    """The judge, from all texts with a digit or an at sign; a hash of each row puts it to those fitted or held out. None without both classes.

    Equal examples count as one row with a weight. Neither examples nor scores come to the driver.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"[0-9@]|[(\[] ?at ?[)\]]"))
    rows = rows.select(F.xxhash64("key", "text", F.monotonically_increasing_id()).alias("h"), "text")

    def counted(found: Counter) -> pa.RecordBatch:
        held, labels, vectors = zip(*found)
        columns = [pa.array(held, pa.bool_()), pa.array(labels, pa.float64()), pa.array(vectors, pa.list_(pa.float64())), pa.array(found.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["check", "label", "x", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, "text"):
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                for label, vector in examples(t, h):
                    found[(h >> 20) % 3 == 0, label, tuple(vector)] += 1
                    if len(found) >= AT_ONCE:
                        yield counted(found)
                        found.clear()
        if found:
            yield counted(found)

    with scratch():
        made = rows.mapInArrow(run, "check boolean, label double, x array<double>, n bigint")
        table = stage(made.groupBy("check", "label", "x").agg(F.sum("n").alias("n")), "personal-examples")
        # At most four rows.
        size = {(r.check, r.label): r.rows for r in table.groupBy("check", "label").agg(F.count(F.lit(1)).alias("rows")).collect()}
        if not ((False, 0.0) in size and (False, 1.0) in size and any(check for check, _ in size)):
            return None
        # Only the driver needs the library for it.
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.functions import array_to_vector

        training = table.where("NOT check").select(array_to_vector("x").alias("features"), "label", F.col("n").cast("double").alias("weight"), "x")
        # In one order whatever the order of the rows, as sums of floats follow it.
        parts = -(-(size[False, 0.0] + size[False, 1.0]) // FIT_ROWS)
        training = training.repartition(parts, "label", "x").sortWithinPartitions("label", "x").drop("x")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3, weightCol="weight").fit(training)
        judge = Judge(parse_trees(model.toDebugString, list(model.treeWeights)), list(model.treeWeights), [math.inf] * len(KINDS))
        for r in _thresholds(table.where("check"), judge).collect():
            judge.thresholds[int(r.kind)] = r.p
    return judge


def _thresholds(held_out: DataFrame, judge: Judge) -> DataFrame:
    """(kind, p): the least score above one half down to which ``PRECISION`` of a kind's held-out examples are positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(at, AT_ONCE)
                x = own.column("x").flatten().to_numpy().reshape(own.num_rows, -1)
                columns = [pa.array(x[:, 0]), pa.array(judge.probability(x)), own.column("label"), own.column("n")]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "p", "label", "n"])

    scores = held_out.select("x", "label", "n").mapInArrow(run, "kind double, p double, label double, n bigint")
    scores = scores.groupBy("kind", (-F.col("p")).alias("down")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("good"))
    scores = running_total_by(scores, ["kind"], ["down"], "n", "all_n")
    scores = running_total_by(scores, ["kind"], ["down"], "good", "all_good")
    precise = scores.where((F.col("all_good") / F.col("all_n") >= PRECISION) & (F.col("down") < -0.5))
    return precise.groupBy("kind").agg((-F.max("down")).alias("p"))


def all_spans(text: str, judge: Judge | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans by kind and start."""
    base = base_spans(text)
    if judge is None:
        return base, base
    free = [c for c in candidates(text) if judge.thresholds[c[0]] < math.inf and not impossible(text, c)]
    chosen = list(base)
    if free:
        p = judge.probability(np.array([features(text, c) for c in free]))
        ranked = sorted((-float(q), c[1], c[2], c[0]) for q, c in zip(p, free) if q >= judge.thresholds[c[0]])
        chosen += _fitting(_union(base), ranked)
    return base, sorted(chosen)


def _fitting(taken: list[tuple[int, int]], ranked: list[tuple[float, int, int, int]]) -> list[Span]:
    """Candidates, most probable first, that overlap nothing taken before them."""
    out = []
    for _, s, e, kind in ranked:
        if _free(taken, s, e):
            insort(taken, (s, e))
            out.append((kind, s, e))
    return out


def _union(spans: list[Span]) -> list[tuple[int, int]]:
    """(start, end) in order; spans of two kinds may overlap: their union."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether nothing that is taken, in order and apart, overlaps this."""
    at = bisect_left(taken, (start, end))
    return (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start)


_MAY = np.zeros(256, bool)
_MAY[[*range(48, 58), 64]] = True
_SPELLED = re.compile(rb"[(\[] ?at ?[)\]]")


def _worth(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Texts that may hold a span: those with a digit, an at sign or a spelled-out one in brackets."""
    places = np.flatnonzero(_MAY[raw])
    if ((raw == 40) | (raw == 91)).any():
        places = np.append(places, [m.start() for m in _SPELLED.finditer(raw.tobytes())]).astype(np.int64)
    return np.unique(np.searchsorted(offsets, places, side="right") - 1).tolist()


def find_personal(docs: DataFrame, judge: Judge | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): base spans and all spans of every text, as arrays of (kind, start, end) in code points, end exclusive.

    A null or empty text has none. Rows are treated one by one, whatever their keys; other
    columns are not read. Without a judge only base spans are found.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(judge)
    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in slices(batches, "text"):
            raw, offsets = text_view(batch.column("text"))
            found: list[list[list[dict]]] = [[[] for _ in range(batch.num_rows)] for _ in range(2)]
            for i in _worth(raw, offsets):
                base, every = all_spans(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), judge)
                for out, own in zip(found, (base, every)):
                    out[i] = [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in own]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, arrow) for x in found)], ["key", "base", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def redact(docs: DataFrame, judge: Judge | None, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    names = docs.columns

    def clean(t: str) -> str:
        merged: list[list] = []
        for kind, s, e in sorted(all_spans(t, shared.value)[1], key=lambda x: (x[1], x[2])):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e, kind])
        parts, at = [], 0
        for s, e, kind in merged:
            parts += [t[at:s], f"[{KINDS[kind]}]"]
            at = e
        return "".join([*parts, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            raw, offsets = text_view(batch.column(text))
            hit = _worth(raw, offsets)
            if hit:
                texts = batch.column(text).to_pylist()
                for i in hit:
                    texts[i] = clean(texts[i])
                batch = batch.set_column(names.index(text), text, pa.array(texts, batch.schema.field(text).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def spans_text(column: str):
    """kind:start:end, comma-joined, of an array of spans."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
