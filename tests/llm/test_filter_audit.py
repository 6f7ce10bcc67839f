"""Filters applied in every order, one document after another, against counts by inclusion and exclusion."""

import re
from collections import defaultdict
from itertools import permutations

from quotemill.llm import filter_audit

from . import cases


def plain(docs, labels):
    """docs: doc_id, text, lang, source; labels: doc_id, quality, toxic."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, text, _, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = defaultdict(list)
    for d, text, _, source in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and least[text] < d,
        }
        rows[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, marked in rows.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = marked
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                shapley[f] += len(gone)
                every, alone = sum(f in x[0] for x in marked), sum(x[0] == {f} for x in marked)
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), i + 1] = [len(left), len(gone), every - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    frame = spark.createDataFrame([(*x, "n", 1) for x in labels], "doc_id long, quality int, toxic int, text string, n int")
    rows = filter_audit.audit(docs, frame).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (6, 1, 1), (None, 1, 1), (9, 0, 1), (6, 1, 1)]


def test_odd_rows(spark):
    assert audited(spark, cases.documents(spark), LABELS) == plain(cases.TEXTS, LABELS)
    assert audited(spark, cases.documents(spark), []) == plain(cases.TEXTS, [])
    assert audited(spark, cases.empty(spark), LABELS) == {}


def test_copies_across_parts(spark):
    """Copies of a text by thousands in one part, the first in another; repeated doc_ids; null texts are copies of empty ones."""
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(5, many, "en", "z")] + [(10 + i, many, "en", "hot") for i in range(2000)] + [(10, many, "en", "hot"), (5, many, "en", "z"), (5, many, "en", "hot")]
    docs += [(None, many, "en", "hot")] * 3 + [(3, None, None, ""), (4, "", None, None), (2, "\U0001f600A", "en", None), (7, "a a a $", "en", "z"), (8, "a\ta\x0ba\x0ca\ra\na a", "en", "z")]
    assert audited(spark, cases.documents(spark, docs), LABELS) == plain(docs, LABELS)
