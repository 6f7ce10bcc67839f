"""The pipeline stage by stage, and the corpus queries against their SQL."""

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from quotemill.llm import decontaminate, language_id, line_dedup, minhash, packing, queries

from . import cases

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_what_the_operators_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "language":
            bad = {r.doc_id for r in language_id.predicted(docs).where("lang_pred = 'und' OR score < 0.25").collect()}
            assert ids == before - bad
        elif name == "lines":
            assert not line_dedup.report(docs).where("n_removed = 0").join(out, "doc_id", "left_anti").count()
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
        elif name == "benchmark":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == before - {r.doc_id for r in decontaminate.overlaps(docs, items).collect()}
        else:
            assert ids == before
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == COLUMNS
        sizes.append(len(ids))
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows(spark, name, stage):
    docs = cases.documents(spark)
    kept = stage(spark, docs, SF)
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    if name != corpus_pipeline.STAGES[-1][0]:
        assert kept.columns == docs.columns and len(rows) <= len(cases.TEXTS)
        assert (5 in ids) == (4 in ids) == (name != "language")  # null and empty texts
        assert {1, 6} & set(ids)
    else:
        assert {d for d, *_ in cases.TEXTS} == set(ids)
    if name == "near_duplicates":
        assert 1 in ids and 2 not in ids and ids.count(None) == 2
    assert stage(spark, cases.empty(spark), SF).count() == 0


def test_run_ends_with_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    rows = sorted(repr([r[columns.index(c)] for c in names]) for r in want.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_send_small_batches(spark, name, stage):
    session = spark.newSession()
    stage(session, cases.empty(session), SF)
    docs = session.range(0, 4000, 1, 1).selectExpr("id", "repeat('words and more ', 400) AS text")  # 24 MB in one task

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    found = docs.mapInArrow(size, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 4000
    assert max(r.bytes for r in found) < 4 << 20


def test_a_row_over_the_limit_passes_whole(spark):
    session = spark.newSession()
    text = "words and more " * 300_000  # 4.5 MB
    docs = session.createDataFrame([(1, "few words"), (2, text), (3, None)], "doc_id long, text string").coalesce(1)
    rows = corpus_pipeline.sequences(session, docs, SF).collect()
    plain = packing.packed(spark.createDataFrame(docs.collect(), docs.schema)).collect()
    told = [sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x) for x in (rows, plain)]
    assert told[0] == told[1] and {r.doc_id for r in rows} == {1, 2, 3}
