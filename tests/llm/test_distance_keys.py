"""Hard negatives against scoring every pair; what the search leaves unread."""

import math

import numpy as np
import pytest

from quotemill.llm import distance_keys
from quotemill.llm.shared import ship

SCHEMA = "vec_id long, embedding array<double>, label int, block long, key double, score string"


def plain(rows):
    """rows: vec_id, embedding, label."""
    kept = {}
    for vec, x, label in rows:
        if vec is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if vec not in kept or (x, label) > kept[vec]:
            kept[vec] = (x, label)
    own = {v: ([int(c * 256 // 1) for c in x], (label + 1) % 10 if v % 7 == 0 else label) for v, (x, label) in kept.items()}
    out = []
    for a, (x, label) in own.items():
        if a % 50:
            continue
        scored = sorted((-sum(map(int.__mul__, x, y)), v, other == label) for v, (y, other) in own.items() if v != a and len(y) == len(x))
        for minus, positive, _ in [s for s in scored if s[2]][:5]:
            fit = [(m, v) for m, v, same in scored if not same and 50 * -minus <= 100 * -m <= 95 * -minus]
            out += [(a, positive, i + 1, v, -minus, -m) for i, (m, v) in enumerate(fit[:3])]
    return sorted(out)


def mined(spark, rows):
    ship(spark)
    frame = spark.createDataFrame([(*r, 1, 1.0, "s") for r in rows], SCHEMA)
    found = distance_keys.hard_negatives(frame)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def clustered(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    return [(i, [float(c) for c in centres[i % 12] + rng.normal(size=dim) * 0.3], int(rng.integers(4))) for i in range(n)]


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 3) / 4], int(rng.integers(3))) for i in range(160)]
    rows += [(200 + i, [0.5, 0.5, 0.25], i % 2) for i in range(120)]  # one vector many times
    rows += [(1, None, 1), (None, [1.0, 1.0, 1.0], 1), (350, [1.0, None, 1.0], 1), (351, [math.nan, 1.0, 1.0], 1), (352, [math.inf, 0.0, 0.0], 1), (353, [1.0, 1.0, 1.0], None)]
    rows += [(0, [0.5, 0.5, 0.5], 1), (0, [0.5, 0.25, 0.5], 2), (400, [0.0, 0.0, 0.0], 1), (450, [], 1), (451, [], 1), (452, [], 2), (500, [1.0, 2.0], 1), (501, [1.0, 1.0], 1), (502, [2.0, 0.1], 2), (503, [1.0, 0.5], 2), (550, [1.0] * 5, 3)]
    want = plain(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == []
    assert mined(spark, [(None, None, None)]) == []


def test_large_components(spark):
    """Products beyond doubles are exact; those beyond 64 bits don't fail."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.integers(-(1 << 21), 1 << 21, 4)], i % 3) for i in range(120)]
    assert mined(spark, rows) == plain(rows)
    assert distance_keys.products(np.array([[3e9, 1.0]]), np.array([[3e9, 7.0]])).tolist() == [[min(9 * 10**18 + 7, (1 << 63) - 1)]]
    assert len(mined(spark, [(i, [1e300, -1e300 * (i % 3)], i % 2) for i in range(60)])) >= 0


@pytest.mark.parametrize("sizes", [(64, 16, 2), (4096, 1024, 8)])
def test_against_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "GROUP", "MET"), sizes):
        monkeypatch.setattr(distance_keys, name, value)
    rows = clustered(1500)
    assert mined(spark, rows) == plain(rows)


def test_reads_a_part_where_keys_tell(spark, monkeypatch):
    """In clusters the search ends with most blocks unread, and with the exact result."""
    for name, value in (("BLOCK", 32), ("GROUP", 8)):
        monkeypatch.setattr(distance_keys, name, value)
    read, real = [], distance_keys._pairs

    def counted(*args):
        out = real(*args).checkpoint()
        read.append(out.count())
        return out

    monkeypatch.setattr(distance_keys, "_pairs", counted)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    points = [c + rng.normal(size=8) * 0.02 for c in (centres / np.linalg.norm(centres, axis=1)[:, None])[np.arange(3000) % 12]]
    rows = [(i, (x / np.linalg.norm(x)).tolist(), i % 4) for i, x in enumerate(points)]
    assert mined(spark, rows) == plain(rows)
    assert sum(read[:3]) < 0.3 * (3000 / 32) * (60 / 8)  # of the positives' search
