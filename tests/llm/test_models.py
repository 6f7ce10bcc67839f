"""Toxicity, language and nearest neighbours: held-out accuracy, recall and odd rows."""

import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import hnsw, language_id, licenses, toxicity

from . import cases

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    """At sf0.01 fifty toxic rows are all there is to learn from; the next size has enough."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    found = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert found.count() == docs.count()
    told = found.where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").select("score", "toxic").toPandas()
    good, bad = told["score"][told["toxic"] == 1].to_numpy(), told["score"][told["toxic"] == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.9


def test_long_texts_in_stretches():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choice(words, 30)).encode() for _ in range(40)]
    ids, first = toxicity.buckets(docs)
    model = toxicity.train([ids[i:j] for i, j in zip(first, first[1:])], np.arange(40) % 2)
    for text in (b" ".join(docs), b"w1", b"w1, w2", b" .. " + docs[0] + b" ;; ", b"x" * 300, b" " * 300):
        want = toxicity.score(model, model.tables(), [text])
        for stretch in (1, 7, 40, 100):
            assert np.allclose(toxicity.score(model, model.tables(), [text], stretch), want)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (8, 0, "x"), (6, None, "x"), (None, 1, "x"), (2, 0, "x")], "doc_id long, toxic int, text string")
    for docs, n in ((cases.documents(spark), len(cases.TEXTS)), (cases.empty(spark), 0)):
        for known in (labels, labels.limit(0)):
            rows = toxicity.scored(docs, toxicity.fit(docs, known)).collect()
            assert len(rows) == n
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
            assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity_learns_from_a_bounded_sample(spark):
    """One row a doc_id, however often it repeats, and no more bytes than the bound."""
    docs = cases.documents(spark, [(1, f"word{i} " * 20, "en", "a") for i in range(500)] + [(i, "x" * 1000, "en", "a") for i in range(3, 60)] + [(90, "y" * 50_000, "en", "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 5000, 20_000).collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 5 < len(ids) and sum(len(r.text) for r in rows) <= 20_000
    assert toxicity._sample(docs, labels, 5000).count() == sum(zlib.crc32(str(d).encode()) % 4 != 2 for d in [1, *range(3, 60), 90])


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND n_chars > 400")
    model = language_id.learn(docs)
    one, other = (docs.where(F.col("lang") == x).orderBy("doc_id").first().text[:300] for x in model.languages[:2])
    mixed = cases.documents(spark, [(1, one + "\n" + other, None, None)])
    spans = language_id.identified(mixed, model, with_spans=True).first().spans
    assert {s.lang for s in spans} >= set(model.languages[:2])
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))


def test_language_rejects_rows_not_ids(spark):
    """Clean rows stay beside bad ones of their doc_id, null or repeated."""
    text = "the quick brown fox jumps over the lazy dog"
    docs = [(None, text, "en", "a"), (None, None, "en", "b"), (None, "123 456", "en", "c"), (7, text, "en", "d"), (7, "", "en", "e"), (8, text, "en", "f")]
    docs += [(100 + i, text, "en", "g") for i in range(20)]
    frame = cases.documents(spark, docs)
    kept = language_id.accepted(frame)
    assert kept.schema == frame.schema
    want = sorted(repr((d, t, s)) for d, t, _, s in docs if t == text)
    assert sorted(repr((r.doc_id, r.text, r.source)) for r in kept.collect()) == want


def test_letters_and_marks():
    """Letters of late planes are letters; marks belong to letters and are none alone."""
    words = language_id.words_of(["\U00030001" * 3, "\u0301\u0301", "e\u0301te", "a\n\u0301b", ""])
    assert np.diff(words.first).tolist() == [1, 0, 1, 2, 0]
    assert words.letters.tolist() == [3, 4, 1, 1]
    many = np.zeros((3, 300), np.float32)
    many[:, 280] = 1.0
    assert language_id.viterbi(many, np.array([0, 3]), 2.0).tolist() == [280] * 3


def test_language_odd_rows(spark):
    rows = language_id.predicted(cases.documents(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    assert all((r.lang_pred == "und") == (r.score == 0) for r in rows if r.doc_id in (4, 5, 10))
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 10)} == {"und"}
    assert language_id.predicted(cases.empty(spark)).count() == 0
    assert language_id.accepted(cases.documents(spark)).columns == cases.documents(spark).columns
    unlabelled = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predicted(unlabelled).collect()} == {"und"}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    scores = rng.normal(0, 3, (11, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 11])
    labels = language_id.viterbi(scores, first, 2.0)
    for i, j in zip(first[:-1], first[1:]):
        paths = np.stack(np.meshgrid(*[np.arange(3)] * (j - i), indexing="ij"), -1).reshape(-1, j - i) if j > i else np.zeros((1, 0), int)
        value = [scores[np.arange(i, j), p].sum() - 2.0 * (p[1:] != p[:-1]).sum() for p in paths]
        own = labels[i:j]
        assert np.isclose(scores[np.arange(i, j), own].sum() - 2.0 * (own[1:] != own[:-1]).sum(), max(value), atol=1e-4)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, dim string")


def _exact(rows, k=5):
    by_id = {i: np.array(v, np.float64) for i, v, *_ in rows}
    ids = np.array(sorted(by_id))
    x = np.stack([by_id[i] for i in ids])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % 50 == 0]:
        sims = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(sims, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), sims[i]) for i in order]
    return out


def test_neighbours_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 700)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=24).tolist(), "x", "y") for i in range(2500)]
    rows += [(3000 + i, rows[50][1], "x", "y") for i in range(40)]  # one vector of many rows
    table = _vectors(spark, rows)
    got = {}
    for r in hnsw.nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = _exact([(i, np.float32(v).astype(float).tolist()) for i, v, *_ in rows])
    assert set(got) == set(want) and all(sorted(x) == [1, 2, 3, 4, 5] for x in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    assert [v for _, (v, _) in sorted(got[50].items())] == [3000, 3001, 3002, 3003, 3004]


@pytest.mark.parametrize("shard", [1500, 32_768])
def test_recall_on_the_table_of_embeddings(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in hnsw.nearest(table, table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect() if r.embedding is not None and None not in r.embedding]
    want = _exact([(i, v) for i, v in rows if np.isfinite(v).all() and any(v)])
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits / (5 * len(want)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "x", "y"), (1, [1.0, 0.1], "x", "y"), (2, None, "x", "y"), (3, [0.0, 0.0], "x", "y"), (4, [nan, 1.0], "x", "y")]
    rows += [(5, [None, 1.0], "x", "y"), (6, [], "x", "y"), (None, [1.0, 1.0], "x", "y"), (7, [float("inf"), 1.0], "x", "y"), (50, [1.0, 0.0, 0.0], "x", "y")]
    table = _vectors(spark, rows)
    got = [(r.query_id, r.rank, r.vec_id) for r in hnsw.nearest(table, table.where("vec_id % 50 = 0")).collect()]
    assert got == [(0, 1, 1)]
    assert hnsw.nearest(table.limit(0), table).count() == 0
    assert hnsw.nearest(table, table.limit(0)).count() == 0


def test_licences(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 100)
    texts = [
        (1, "Copyright (c) 2020 Someone\n" + mit.replace("Software", "SOFTWARE").replace(",", " ,"), "en", "a"),
        (2, mit.replace("sublicense", "sub-licence"), "en", "a"),
        (3, mit + " and more", "en", "a"),
        (4, "Some text.\n  licensed under the APACHE licence version 2.0\nMore.", "en", "a"),
        (5, None, None, None), (6, "", None, None), (7, "...\n\n", None, None), (None, "All rights reserved", None, None), (8, cases.LONG, "de", "c"),
    ]
    got = {r.doc_id: r for r in licenses.scanned(cases.documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[1].whole_document == got[2].whole_document == "MIT" and got[3].whole_document is None
    assert (got[4].licenses, got[4].n_hits, got[4].n_texts) == ("Apache-2.0", 1, 6)
    assert [(got[i].n_texts, got[i].licenses) for i in (5, 6, 7)] == [(0, "")] * 3
    assert got[None].whole_document == "LicenseRef-all-rights-reserved"
    assert licenses.scanned(cases.empty(spark)).count() == 0


def test_licences_within_documents(spark):
    """Wrapped anew, between other paragraphs; a notice over two lines; equal words in a row; a table of one's own."""
    by_id = {}
    for name, text in licenses.KNOWN:
        by_id[name] = max(by_id.get(name, ""), text, key=len)
    wrap = lambda t, n: "\n\n".join("\n".join(textwrap.wrap(p, n)) for p in t.split("\n\n"))
    texts = [(i, f"# A tool\nand its notes\n\n{wrap(t, 40 + i)}\n\nThe end, sub licence licence.", "en", "a") for i, t in enumerate(by_id.values())]
    texts.append((90, "See below.\nLicensed under the\nMIT License\nThat is all.", "en", "a"))
    got = {r.doc_id: r for r in licenses.scanned(cases.documents(spark, texts)).collect()}
    for i, name in enumerate(by_id):
        assert name in got[i].licenses.split(","), name
    assert got[90].licenses == "MIT"
    own = spark.createDataFrame([("a", "licence licence\nlicense"), ("b", "")], "license_id string, known string")
    docs = cases.documents(spark, [(1, "License, licence: LICENCE", None, None), (2, "", None, None)])
    assert [(r.doc_id, r.whole_document) for r in licenses.scanned(docs, own).orderBy("doc_id").collect()] == [(1, "a"), (2, None)]
    assert licenses.scanned(docs, own.limit(0)).where("n_hits > 0").count() == 0


def test_native_operators_have_no_python(spark):
    import inspect

    from quotemill.llm import decontaminate

    random.seed(0)
    for module in (decontaminate, licenses):
        source = inspect.getsource(module)
        assert not any(x in source for x in ("mapIn", "applyIn", "udf", ".rdd", "toPandas", "pandas"))
