import random
import re
from itertools import combinations

from quotemill.llm import decontaminate

from . import cases

WINDOW, MOST = decontaminate.WINDOW, decontaminate.SUBSTITUTIONS


def test_masks_find_every_window_with_two_substitutions():
    for wrong in combinations(range(WINDOW), MOST):
        assert any(
            not any(shift + p in wrong for p in mask) for mask in decontaminate.MASKS for shift in range(WINDOW - mask[-1])
        ), wrong


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _plain(docs, items):
    """Pairs of documents and items with a window that agrees but for two tokens, all alignments tried; shorter items
    stand whole and exactly."""
    found = set()
    for d, t, *_ in docs:
        x = _tokens(t)
        for item, text in items:
            y = _tokens(text)
            if 0 < len(y) < WINDOW and any(x[i : i + len(y)] == y for i in range(len(x))):
                found.add((d, item))
            for i in range(len(x) - WINDOW + 1):
                for j in range(len(y) - WINDOW + 1):
                    if sum(a == b for a, b in zip(x[i : i + WINDOW], y[j : j + WINDOW])) >= WINDOW - MOST:
                        found.add((d, item))
    return found


def _planted():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, items[4][1])]
    docs = []
    for i in range(80):
        passage = _tokens(items[i % 25][1])
        for _ in range(i % 5):
            passage[rng.randrange(len(passage))] = word()
        filler = [word() for _ in range(rng.randrange(40))]
        docs.append((i, ", ".join(filler[: i % 7] + [p.upper() for p in passage] + filler[i % 7 :]), "en", "a"))
    return docs, items


def test_same_pairs_as_brute_force(spark):
    docs, items = _planted()
    got = decontaminate.overlaps(cases.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == _plain(docs, items)
    sizes = {i: len(_tokens(t)) for i, t in items}
    assert all(min(WINDOW - MOST, sizes[r.item_id]) <= r.n_matches <= r.n_tokens for r in rows)
    short = [r for r in rows if sizes[r.item_id] < WINDOW]
    texts = {d: _tokens(t) for d, t, *_ in docs}
    assert short and all(r.n_matches == r.n_tokens == sizes[r.item_id] and texts[r.doc_id][r.doc_start : r.doc_start + r.n_tokens] == _tokens(dict(items)[r.item_id]) for r in short)


def test_documents_with_a_passage_go(spark):
    docs, items = _planted()
    frame = cases.documents(spark, docs)
    kept = decontaminate.decontaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in _plain(docs, items)}


def test_rows_go_not_ids(spark):
    """Clean rows stay beside contaminated ones of their doc_id, null or repeated."""
    items = spark.createDataFrame([(1, cases.BASE)], "item_id long, text string")
    docs = [(None, cases.BASE, "en", "a"), (None, "clean", "en", "b"), (None, None, "en", "c"), (5, "clean " + cases.BASE, "en", "d"), (5, "clean", "en", "e"), (6, cases.BASE, "en", "f")]
    frame = cases.documents(spark, docs)
    kept = decontaminate.decontaminated(frame, items)
    assert kept.columns == frame.columns
    assert sorted(r.source for r in kept.collect()) == ["b", "c", "e"]


def test_items_side_beyond_the_bound_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = _planted()
    got = decontaminate.overlaps(cases.documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == _plain(docs, items)


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, cases.BASE, "x"), (2, None, "x"), (3, "short", "x")], "item_id long, text string, tokens string")
    none = items.limit(0)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(cases.documents(spark), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (None, 1)}
    words = spark.createDataFrame([(4, "one TWO!"), (5, "two"), (6, "two one"), (7, "!?")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(cases.documents(spark), words).collect()} == {(6, 4), (6, 5), (7, 4), (7, 5)}
    assert decontaminate.overlaps(cases.documents(spark), none).count() == 0
    assert decontaminate.overlaps(cases.empty(spark), items).count() == 0
    assert decontaminate.decontaminated(cases.documents(spark), none).count() == len(cases.TEXTS)
