from collections import defaultdict

import pytest

from quotemill.llm import line_dedup

from . import cases


def _plain(rows, sites):
    """doc_id and text to the text that is left, by the rule as it stands in words."""
    seen, first = defaultdict(set), {}
    each = [(d, t, s, place, line) for d, t, s in rows if t is not None for place, line in enumerate(t.split("\n"))]
    for d, t, s, place, line in each:
        key = line.strip(" \t\r")
        if key:
            if s is not None:
                seen[key].add(s)
            if d is not None:
                first[key] = min(first.get(key, (d, place)), (d, place))
    out = {}
    for d, t, _ in rows:
        keep = []
        for place, line in enumerate((t or "").split("\n")):
            key = line.strip(" \t\r")
            if not (key and len(seen[key]) >= sites and first.get(key) != (d, place)):
                keep.append(line)
        out[d, t] = None if t is None else "\n".join(keep)
    return out


def _documents(spark):
    rows = [(i, f"own line {i}\ncookie notice\n  shared {i % 3} \n\nlast", "en", f"site{i % 12}") for i in range(60)]
    rows += [(100 + i, "only nine sites", "en", f"site{i}") for i in range(9)]
    rows += [(200, None, "en", "site1"), (201, "", None, None), (202, "cookie notice\ncookie notice", "en", None), (None, "cookie notice\nx", "en", "q")]
    return rows, cases.documents(spark, rows)


@pytest.mark.parametrize("most", [0, 500_000])
def test_boilerplate_goes_and_first_copies_stay(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    rows, docs = _documents(spark)
    got = {(r.doc_id, r.n): r.text for r in line_dedup.without_boilerplate(docs).selectExpr("doc_id", "text", "__lines AS n").collect()}
    want = _plain([(d, t, s) for d, t, _, s in rows], line_dedup.SITES)
    assert len(got) == len(rows)
    assert sorted((str(d), str(t)) for (d, _), t in got.items()) == sorted((str(d), str(t)) for (d, _), t in want.items())


def test_threshold_is_exact_on_both_sides(spark):
    rows = [(i, f"at {n} sites", "en", f"s{i}") for n in (9, 10, 11) for i in range(n)]
    rows = [(k, t, lang, s) for k, (_, t, lang, s) in enumerate(rows)]
    gone = line_dedup.report(cases.documents(spark, rows)).where("n_removed > 0").collect()
    assert len(gone) == 9 + 10


def test_documents_of_boilerplate_alone_go_and_columns_stay(spark):
    rows, docs = _documents(spark)
    kept = line_dedup.cleaned(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert 202 not in found and 200 in found and 201 in found
    assert all(r.n_chars == len(r.text) for r in found.values() if r.text is not None)


def test_odd_rows(spark):
    docs = cases.documents(spark)
    assert line_dedup.report(docs).count() == docs.count()
    assert line_dedup.report(cases.empty(spark)).count() == 0
    assert line_dedup.cleaned(cases.empty(spark)).count() == 0
