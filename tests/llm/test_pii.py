"""Base spans against plain patterns; what the trees add; odd rows and very long texts."""

import hashlib
import random
import re
import time

import pytest

from quotemill.llm import pii
from quotemill.llm.shared import ship

from . import cases

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def named(spans):
    return [(pii.KINDS[k], a, b) for k, a, b in spans]


def test_base_rules():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@x", ".", "..", "-", " ", "  ", "+", "+4", "(", ")", "1", "25", "255", "256", "0007", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "é", "１２", "\U0001f600", "%_", "x@y.z", "\n", "9" * 25]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(14)))
        assert named(pii.base_spans(text)[0]) == plain(text), text


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "a." * 200_000, "1" * 300_000, "1." * 200_000, "12 34 " * 8_000, "+1" + "(" * 200_000, "+" * 200_000, "a@" * 150_000, "x at " * 50_000, "a@b." * 50_000):
        began = time.time()
        assert len(pii.base_spans(text)[0]) < 100_000
        assert sum(1 for _ in pii.candidates(text)) < 40 * len(text)
        assert time.time() - began < 20


def test_trees_fit_what_no_line_can():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, (4000, 5)).astype(float)
    y = ((x[:, 0] > 3) != (x[:, 1] > 3)) & (x[:, 2] > 1)
    trees = pii.boosted(x[:3000], y[:3000].astype(float))
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.98


def test_threshold():
    import numpy as np

    assert pii.calibrated(np.array([0.9, 0.8, 0.7, 0.6]), np.array([True, True, False, True])) == 0.8
    assert pii.calibrated(np.array([0.9, 0.9]), np.array([True, False])) == 2.0
    assert pii.calibrated(np.array([]), np.array([], bool)) == 2.0


@pytest.fixture(scope="module")
def trees(spark):
    ship(spark)
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_adds_what_rules_miss(trees):
    rng = random.Random(8)
    words = "thon that reand of shing ednd in the les and".split()
    some = lambda: " ".join(rng.choices(words, k=6))
    hit, n = dict.fromkeys(pii.KINDS, 0), 60
    for i in range(n):
        phone = f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d}"
        address = ".".join(str(rng.randrange(10, 250)) for _ in range(4))
        card = next(c for c in (f"{rng.randrange(10**15, 10**16)}" for _ in range(999)) if pii.luhn(c))
        cards = f"{card} {card[::-1]}"
        for kind, text, span in (
            ("phone", f"{some()} {phone} {address} {some()}", phone),
            ("card", f"{some()} {cards} {some()}", card),
            ("email", f"{some()} {rng.choice(words)}.{i} (at) mail{i % 9} (dot) example (dot) com {some()}", None),
            ("ip", f"{some()} {address.replace('.', '[.]')} {some()}", None),
        ):
            base = pii.base_spans(text)[0]
            found = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added(text, trees, base)]
            hit[kind] += any(k == kind and (span is None or s == span) for k, s in found)
    assert all(h >= 0.8 * n for h in hit.values()), hit
    clean = [f"{some()} {rng.randrange(10**9, 10**14)} {some()} {i}.{i + 3}.{i} {some()} at home dot {some()} 4111111111111112" for i in range(300)]
    assert sum(bool(pii.added(t, trees, [])) for t in clean) <= 6


def test_documents(spark, trees):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.found(docs, trees).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        wrote = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(wrote).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(wrote) <= set(spans) and len(spans) == len(wrote) + r.n_added
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])))
    hidden = {r.doc_id: r.text for r in pii.redacted(docs, trees).collect()}
    assert not any(plain(t) for t in hidden.values())


def test_odd_rows(spark, trees):
    for model in (trees, None):
        rows = pii.found(cases.documents(spark), model).collect()
        assert len(rows) == len(cases.TEXTS)
        assert all(r.spans == "" and r.n_added == 0 and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
        assert pii.found(cases.empty(spark), model).count() == 0
        assert pii.redacted(cases.documents(spark), model).schema == cases.documents(spark).schema
    assert pii.fit(cases.empty(spark)) is None and pii.fit(cases.documents(spark)) is None
    docs = cases.documents(spark, [(1, "x@y.zz " * 3, "en", "a")] * 40 + [(2, "nothing 12 here", "en", "a")])
    rows = pii.found(docs, pii.fit(docs)).collect()
    assert len(rows) == 41 and {r.n_email for r in rows} == {0, 3}


def test_every_candidate_of_every_row_teaches(spark):
    docs = cases.documents(spark, [(i, "12345678901234 " + " x ".join(f"10.0.0.{j}" for j in range(90)), "en", "a") for i in range(3)])
    # more candidates than 64 in a text, and equal texts count each
    assert pii._lessons(docs).agg({"true": "sum"}).first()[0] >= 3 * 90
