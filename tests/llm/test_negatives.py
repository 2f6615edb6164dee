"""Hard negatives against brute force, and the parts they are made of."""

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfline.llm import negatives

KIND = "vec_id bigint, embedding array<float>, label int, id string, key string, part int, block bigint, score bigint"


def plain(rows, every=10, positives=5, wanted=10):
    """The result by comparing every anchor with every row."""
    whole = []
    for key, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    late = lambda key: (key is None, key or 0)
    out = Counter()
    for i, (anchor, own, label) in enumerate(whole):
        if anchor is None or anchor % every:
            continue
        found = [(score(own, v), key, other) for j, (key, v, other) in enumerate(whole) if j != i]
        found.sort(key=lambda x: (-x[0], late(x[1])))
        for best, positive, _ in [x for x in found if x[2] == label][:positives]:
            window = [x for x in found if x[2] != label and 30 * best <= 100 * x[0] <= 90 * best]
            for rank, (negative, key, _) in enumerate(window[:wanted], 1):
                out[anchor, positive, rank, key, best, negative] += 1
    return out


def mined(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(*r[:3], "i", "k", 1, 2, 3) for r in rows], KIND).repartition(parts)
    return Counter(tuple(r) for r in negatives.mine_negatives(table, F.expr("vec_id % 10 = 0"), **options).collect())


def vectors(n, dims=6, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(300)
    assert mined(spark, rows, block_rows=7) == plain(rows)
    assert mined(spark, rows, block_rows=64, at_once=9) == plain(rows)


def test_odd_rows(spark):
    rows = vectors(60) + [
        (10, None, 1), (20, [0.5] * 6, None), (30, [0.1, None, 0.2, 0.3, 0.1, 0.1], 1), (40, [float("nan")] * 6, 2),
        (50, [0.2, float("inf"), 0.1, 0.1, 0.1, 0.1], 0), (None, [0.2] * 6, 1), (None, [0.2] * 6, 0), (70, [], 1), (80, [0.4], 2),
        (90, [0.3] * 8, 0), (-10, [-0.2] * 6, 1), (0, [0.0] * 6, 2),
    ]
    assert mined(spark, rows, block_rows=5) == plain(rows)


def test_ties_and_repeated_rows(spark):
    # One vector holds most rows, under several labels; anchors and other rows repeat whole.
    rows = [(i, [0.5, 0.25], i % 3) for i in range(120)] + [(i, [0.4, 0.1], 1) for i in range(100, 140)]
    rows += [(20, [0.5, 0.25], 2)] * 3 + [(7, [0.3, 0.1], 0)] * 4
    assert mined(spark, rows, block_rows=8) == plain(rows)


def test_negative_scores_and_large_components(spark):
    # A positive with a score below zero has an empty window; sums beyond 2**53 stay exact.
    rows = [(0, [1.0, -1.0], 0), (1, [-1.0, 1.0], 0), (2, [1.0, 0.5], 1), (3, [-0.5, 0.5], 1)]
    assert mined(spark, rows) == plain(rows) == Counter()
    large = [(i, [200_000.0 + i, 150_000.0 - 3 * i], i % 2) for i in range(40)]
    large += [(100 + i, [60_000.0 + 7 * i, 31.0 * i], i % 2) for i in range(40)]
    assert mined(spark, large, block_rows=4) == plain(large) != Counter()


def test_no_anchors_and_empty_table(spark):
    assert mined(spark, [(1, [0.5], 0), (2, [0.5], 1)]) == Counter()
    assert mined(spark, []) == Counter()
    assert mined(spark, [(10, None, None)]) == Counter()


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in negatives.hilbert_keys(cells, bits)]
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(0)
    a, v = rng.integers(-90, 90, (20, 5)), rng.integers(-90, 90, (50, 5))
    lower, upper = negatives.score_bounds(a, v.min(0)[None], v.max(0)[None])
    assert (lower[:, 0] <= (a @ v.T).min(1)).all() and (upper[:, 0] >= (a @ v.T).max(1)).all()


def test_zone_maps_skip_blocks(spark):
    """Tight groups far apart: proofs and bounds leave few blocks to read."""
    rng = random.Random(4)
    rows = [(i, [3.0 * ((i % 8) >> b & 1) + rng.gauss(0, 0.01) + 1 for b in range(3)], i % 2) for i in range(800)]
    table = spark.createDataFrame([(i, v, x, i % 100 == 0) for i, v, x in rows], "id bigint, vector array<double>, label bigint, is_anchor boolean")
    blocks = negatives.write_blocks(table, block_rows=10)
    own = blocks.anchors.where("anchor_id = 0").toArrow()
    vector = np.frombuffer(own["vector"][0].as_py(), np.int32)[None]
    ends = np.iinfo(np.int64)
    about = [own[c].to_numpy() for c in ("label", "block", "place")]
    windows = negatives.Windows(vector, *about, np.zeros(1, np.int64), np.array([ends.min + 1]), np.array([ends.max]), True, 5)
    assert negatives.search(blocks, windows).count() == 5
    zones = [negatives._zones(b, 3) for b in blocks.table.select("part", "block", "label", "n", "lo", "hi").toArrow().combine_chunks().to_batches()]
    needed = sum(int(windows.needs(z).sum()) for z in zones)
    assert 0 < needed <= sum(len(z["n"]) for z in zones) // 4
