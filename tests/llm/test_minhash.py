import random
import re

import numpy as np
from pyspark.sql import functions as F

from quotemill.llm import minhash
from quotemill.llm.components import components

from . import cases


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


class _Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _plain(texts):
    """Size of each named row's set, and each doc_id's component, by comparing all pairs of different sets."""
    sets = [(d, _set(t)) for d, t, _, _ in texts if d is not None]
    union = _Union()
    for d, _ in sets:
        union.find(d)
    by_set = {}
    for d, s in sets:
        if s:
            union.join(by_set.setdefault(s, d), d)
    different = list(by_set)
    for i, s in enumerate(different):
        for t in different[i + 1 :]:
            if 100 * len(s & t) >= 75 * len(s | t):
                union.join(by_set[s], by_set[t])
    return sets, union


def _check(spark, texts):
    rows = minhash.near_duplicates(cases.documents(spark, texts)).collect()
    sets, union = _plain(texts)
    want = sorted((d, len(s), union.find(d), union.find(d) == d) for d, s in sets)
    named = [r for r in rows if r.doc_id is not None]
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in named) == want
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert len(rows) == len(texts)


def test_odd_rows(spark):
    _check(spark, cases.TEXTS)
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = minhash.deduplicated(cases.documents(spark))
    assert kept.columns == cases.SCHEMA.replace(",", "").split()[::2]


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_groups_around_the_threshold(spark):
    rng = random.Random(5)
    texts, number = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 80, 300]))]
        for _ in range(rng.choice([2, 5, 20])):
            texts.append((number, " ".join(_edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))), "en", "a"))
            number += 1
    _check(spark, texts)


def test_large_buckets_are_split_and_cut(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "FEW", 8)
    monkeypatch.setattr(minhash, "GROUP_PAIRS", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(_edited(rng, base, rng.randrange(0, 12))), "en", "a") for i in range(150)]
    _check(spark, texts)


def test_a_single_shared_band_is_enough_in_large_buckets(spark, monkeypatch):
    """Pairs over the threshold that share one band only, in a bucket with more strays than FEW."""
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "FEW", 8)
    rng = np.random.default_rng(4)
    bands, rows = minhash.BANDS, minhash.ROWS
    found = rng.integers(0, 1 << 32, (60, bands * rows + minhash.MORE), dtype=np.uint32)
    for i in range(0, 60, 2):
        found[i + 1] = found[i]
        found[i + 1, rows : bands * rows : rows] += np.uint32(1)
    found[:, :rows] = found[0, :rows]
    own = spark.createDataFrame([(i, 100, minhash.packed_signatures(found)[i]) for i in range(60)], "rep long, n long, signature binary")
    members = minhash._members(own)
    shared = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    none = spark.createDataFrame([], "node long, component long")
    got = minhash._candidates(members.join(shared, "key"), none, own).collect()
    assert sorted((r.a, r.b) for r in got) == [(i, i + 1) for i in range(0, 60, 2)]


def test_components_of_a_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    union = _Union()
    for a, b in edges:
        if a is not None and a != b:
            union.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: union.find(x) for x in union.up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
