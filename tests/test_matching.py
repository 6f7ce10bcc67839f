"""Fuzzy matching against scoring every pair, and rules on odd part numbers."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quotemill.functions import part_numbers, similarity
from quotemill.operators import matching


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("ABC01", max_size=12), st.text("ABC01", max_size=12))
def test_common_subsequence(a, b):
    assert similarity.common(a, b) == _lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)


def test_score_of_a_stretch():
    assert similarity.score("LM358", "XXLM358YY") == 100.0
    assert similarity.score("", "A") == 0.0
    assert similarity.score("ABC", "XYZ") == 0.0
    assert SequenceMatcher(None, "AB12", "AB13").ratio() * 100 == similarity.ratio("AB12", "AB13")


@settings(max_examples=150, deadline=None)
@given(st.text("AB01\u00e9", max_size=70), st.lists(st.text("AB01\u00e9", max_size=70), max_size=8))
def test_many_scores_at_once(query, keys):
    keys = sorted(set(keys))
    many = similarity.Keys(keys)
    import numpy as np

    got = many.scores(query, np.arange(len(keys)))
    want = [similarity.score(query, k) for k in keys]
    assert got.tolist() == want
    assert all(b >= w - 1e-9 for b, w in zip(many.bounds(query), want) if query)


def test_best_keys_lose_nothing_to_the_bound(monkeypatch):
    monkeypatch.setattr(similarity.Keys, "CHUNK", 16)
    monkeypatch.setattr(similarity.Keys, "FIRST", 11)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABCDE01234") for _ in range(rng.randrange(4, 12)))
    many = similarity.Keys(sorted({word() for _ in range(300)}))
    for query in [word() for _ in range(20)]:
        want = sorted((-similarity.score(query, k), k) for k in many.keys)[:10]
        assert many.best(query, 10) == [(-s, k) for s, k in want]


CATALOG = [("LM358-N", "Active", 5), ("LM358-NX9", "Active", 0), ("ABC10I0", "Obsolete", 0), ("STM32F103C8T6", "Active", 9)]
INPUTS = [
    (1, "lm358-n", "exact", "LM358-N"),
    (2, " LM358 / N -TR QTY 100", "exact", "LM358-N"),
    (3, "ABCIO1O", "confusable_variant", "ABC10I0"),
    (4, "STM32F1", "prefix", "STM32F103C8T6"),
    (5, "STM32F103C8X6", "fuzzy", "STM32F103C8T6"),
    (6, "", None, None),
    (7, None, None, None),
    (8, "QQQQQQQQ", None, None),
]


@pytest.fixture(scope="module")
def matched(spark):
    catalog = spark.createDataFrame(CATALOG, "mpn string, lifecycle_status string, authorized_stock long")
    inputs = spark.createDataFrame([(i, t) for i, t, *_ in INPUTS], "input_id long, input_string string")
    found, near = matching.cascade(inputs, catalog)
    return found.collect(), near.collect()


def test_cascade_takes_the_first_tier_that_matches(matched):
    best = {r.input_id: (r.method, r.mpn) for r in matched[0] if r.rank == 1}
    assert best == {i: (method, mpn) for i, _, method, mpn in INPUTS if method}


def test_near_misses_are_for_inputs_without_candidates(matched):
    assert {r.input_id for r in matched[1]} == {8}
    assert len({r.mpn for r in matched[1]}) <= matching.NEAR_MISSES


def test_fuzzy_tasks_hold_a_block_of_requests(spark, monkeypatch):
    """Blocks follow the number of requests and keys, and lose no pair."""
    monkeypatch.setattr(matching, "BLOCK", 8)
    monkeypatch.setattr(matching, "QUERY_BLOCK", 8)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ABCDE01234") for _ in range(rng.randrange(5, 12)))
    keys, asked = sorted({word() for _ in range(200)}), [(i, word()) for i in range(120)]
    inputs = spark.createDataFrame(asked, "input_id long, key string")
    catalog = spark.createDataFrame([(k,) for k in keys], "part_key string")
    sides = matching.fuzzy_blocks(inputs, catalog)
    for side in sides:
        assert max(r["count"] for r in side.groupBy("r", "k").count().collect()) <= 4 * matching.BLOCK
    got = sorted((r.input_id, r.key_rank, r.part_key) for r in matching.fuzzy_scores(inputs, catalog, 3).collect())
    want = []
    for i, query in asked:
        best = sorted((-similarity.score(query, k), k) for k in keys)[:3]
        want += [(i, n + 1, k) for n, (_, k) in enumerate(best)]
    assert got == sorted(want)


def test_normalising_is_stable(spark):
    rows = [(i, t) for i, t, *_ in INPUTS]
    once = part_numbers.normalized(spark.createDataFrame(rows, "input_id long, input_string string"))
    twice = part_numbers.normalized(once.selectExpr("input_id", "display AS input_string"))
    assert [r.key for r in once.orderBy("input_id").collect()] == [r.key for r in twice.orderBy("input_id").collect()]
