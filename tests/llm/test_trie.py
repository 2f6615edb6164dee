"""The prefix trie against a plain one, and its centroid decomposition on odd trees."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shelfline.llm import trie

KIND = "conv_id bigint, turn bigint, role string, text string, key string, place bigint, a string, depth int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, every=20, most=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends, last = defaultdict(list), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(np.fmod(c, every))
        turns = own.get(base, [])[:h] + own[c][h:]
        prefix = ()
        for at in range(len(turns) + 1):
            prefix = hash((prefix, turns[at - 1])) if at else 0
            members[at, prefix].append((c, turns))
        ends[at, prefix].append(c)
    # Names of prefixes: the sequence itself would be quadratic in memory for long conversations.
    parent, saved, children = {}, {}, defaultdict(list)
    for (at, prefix), some in members.items():
        turns = some[0][1][:at]
        saved[at, prefix] = (len(some) - 1) * (len(WORD.findall(turns[-1][1])) if at else 0)
    for c, turns in {c: t for some in members.values() for c, t in some}.items():
        prefix = 0
        for at, turn in enumerate(turns, 1):
            here = hash((prefix, turn))
            parent[at, here] = (at - 1, prefix)
            prefix = here
    for node, above in parent.items():
        children[above].append(node)
    leaves, total = defaultdict(int), defaultdict(int)
    for node in sorted(members, reverse=True):
        leaves[node] += not children[node]
        total[node] += saved[node]
        if node in parent:
            leaves[parent[node]] += leaves[node]
            total[parent[node]] += total[node]
    least = {n: min(c for c, _ in some) for n, some in members.items()}
    out = [
        (least[n], n[0], least.get(parent.get(n)), len(members[n]), len(children[n]), leaves[n], total[n],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n in members
    ]
    return sorted(out, key=repr)


def built(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(*r, "k", 1, "a", 2) for r in rows], KIND).repartition(parts)
    return sorted(map(tuple, trie.prefix_trie(*trie.with_shared_heads(trie.numbered_turns(table)), **options).collect()), key=repr)


def conversations(n=150, seed=2, words=3):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choices(["yes", "no", "why"], k=rng.randrange(words)))
    return [(c, t, rng.choice(["user", "assistant", None]), say()) for c in range(0, 2 * n, 2) for t in range(rng.randrange(1, 7))]


def test_equals_plain(spark):
    rows = conversations()
    assert built(spark, rows) == plain(rows)


@pytest.mark.parametrize("small", [1, 25])
def test_rounds_on_spark(spark, small):
    rows = conversations(60, seed=3)
    assert built(spark, rows, small=small) == plain(rows)


def test_odd_rows(spark):
    rows = conversations(20, seed=4) + [
        (None, 0, "user", "no conversation"), (7, None, "user", "before all"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"),
        (8, 1, None, None), (9, 1, "", ""), (-3, 0, "user", "below zero"), (-20, 0, "user", "base"), (-20, 5, "x", "y z"),
        (10_000_000_001, 0, "user", "alone"), (41, 0, "us", "er\x00one"), (42, 0, "use", "r\x00one"), (11, 3, "user", "long " * 60_000), (13, 3, "user", "long " * 60_000),
    ]
    assert built(spark, rows) == plain(rows)


def test_one_long_conversation_and_many_copies(spark):
    """One conversation holds most turns and goes to many tasks; a third of the others are equal."""
    rows = [(5, t, "user", f"turn {t % 11}") for t in range(600)] + [(c, t, "user", f"turn {t}") for c in range(100, 200) for t in range(3)]
    rows += [(c, t, "user", f"turn {t % 11}") for c in (25, 45) for t in range(300 + c)]
    want = plain(rows)
    assert built(spark, rows) == want
    assert built(spark, rows, small=150) == want


def test_conversations_without_turns(spark):
    # All own turns lie before h and there is no base conversation: only the empty prefix is left.
    rows = [(c, 0, "user", "gone") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    want = plain(rows)
    assert built(spark, rows) == want and [r[1] for r in want] == [0]


def test_empty_table(spark):
    assert built(spark, []) == plain([]) == []


def forest_totals(parent, value):
    want = value.copy()
    for i in range(len(parent) - 1, -1, -1):  # parents come first
        if parent[i] >= 0:
            want[parent[i]] += want[i]
    return want


@pytest.mark.parametrize("shape", ["random", "deep", "wide", "chain", "many"])
def test_forest(shape):
    rng = np.random.default_rng(1)
    n = 3000
    low = {"random": lambda i: 0, "deep": lambda i: max(0, i - 3), "wide": lambda i: 0, "chain": lambda i: i - 1, "many": lambda i: max(0, i - 20)}[shape]
    high = (lambda i: 1) if shape == "wide" else (lambda i: i)
    parent = np.array([-1, *(int(rng.integers(low(i), high(i))) for i in range(1, n))])
    if shape == "many":
        parent[rng.random(n) < 0.2] = -1
    depth = np.zeros(n, np.int64)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 0
    own, values = rng.integers(1, 5, n), [rng.integers(-9, 9, n), np.ones(n, np.int64)]
    names = rng.permutation(n)  # rows in any order
    place = np.argsort(names)
    moved = np.where(parent[names] >= 0, place[parent[names]], -1)
    found = trie.Forest(moved, depth[names], forest_totals(parent, own)[names], [v[names] for v in values]).totals()
    for got, v in zip(found, values):
        assert (got == forest_totals(parent, v)[names]).all()
