"""Token files, packing and token counts, against the tokenizers library itself."""

import itertools
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotemill.llm import packing, rans, token_counts, token_output
from quotemill.llm.shared import shared_folder
from quotemill.llm.tokenization import Encoder, encoder

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def _ids(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [2]


def test_cached_parts_encode_as_whole_texts(whole):
    texts = ["", " ", "  a  b ", "don't stop.  Now!", "x\n\n y\t z", "naïve café — 日本 語", "a" * 3000, "1,000.50 €", " lead", "trail ", "a ?b !", "it's we'll 'tis", cases.TEXTS[13][1]]
    own = encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("room", [3000, 96 << 20])
def test_cached_parts_encode_as_whole_texts_of_any_signs(room):
    """White space of all kinds, marks, contractions, special tokens; a cache that overflows in each block too."""
    rng, own = random.Random(5), Encoder(PATH, room)
    signs = [*"ab \u00e9B1'_.#-\n\n  \t\r\u00a0\u3000\x1c\x85\u00f1\u65e5\u0130\u00bd", "don't", "<|endoftext|>", " word", "word.", "\nWord", "x" * 80]
    for _ in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(20)]
        assert own.encode(texts) == own._whole(texts)
    assert own._held <= room + 20_000


def test_files_return_every_document(spark, whole):
    docs = cases.documents(spark)
    rows = token_output.token_files(docs, with_ids=True).collect()
    order = sorted(cases.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(order)
    start = 0
    for got in sorted(rows, key=lambda r: r.start):
        ids = np.array(got.ids, "<u4")
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert any(d == got.doc_id and _ids(whole, t) == got.ids for d, t, _, _ in order)
        start += len(ids)
    names = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert names == [d for d, *_ in order]
    assert token_output.token_files(cases.empty(spark)).count() == 0
    apart = token_output.token_files(docs, with_ids=True, shares=3).collect()
    assert sorted((r.start, r.n_tokens, r.ids) for r in apart) == sorted((r.start, r.n_tokens, r.ids) for r in rows)


def test_damaged_table_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    token_output.write_blocks(cases.documents(spark), path)
    table = spark.read.parquet(f"{path}/table").selectExpr("ids", "counts", "crc + 1 AS crc")
    table.write.parquet(f"{path}-other/table")
    token_output.read_table(spark, path)
    with pytest.raises(ValueError):
        token_output.read_table(spark, f"{path}-other")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001])
def test_blocks_round_trip_from_any_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32)
    table = rans.table(np.bincount(ids, minlength=5001) + 1)
    raw = rans.encode_block(ids, [7, None], [n // 3, n - n // 3], table, every=16)
    block = rans.Block(raw)
    symbols = table.symbols()
    assert np.array_equal(block.decode(table, symbols), ids)
    assert block.doc_ids == [7, None]
    for parts in (1, 2, 7):
        shares = [block.documents(table, symbols, k, parts) for k in range(parts)]
        assert [x for i, j, _ in shares for x in range(i, j)] == [0, 1]
        assert np.array_equal(np.concatenate([x for _, _, x in shares]), ids)
    steps = -(-n // block.lanes)
    for first in range(0, steps, max(1, steps // 5)):
        assert np.array_equal(block.decode(table, symbols, first, first + 3), ids[first * block.lanes : (first + 3) * block.lanes])
    if n > 1000:
        assert len(raw) < 2 * n
        damaged = bytearray(raw)
        damaged[-3] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(damaged))


def _check_packed(rows, texts, whole, places):
    ids = [(d, _ids(whole, t)) for d, t, _, _ in texts]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    spans = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= places and 0 <= r.offset <= places - r.length
        spans[r.sequence_id].append((r.offset, r.length))
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
    for d, _ in ids:
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        want = [x for x, y in ids if x == d]
        assert sum(r.piece == 0 for r in pieces) == len(want)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    for d, own in ids:
        if sum(x == d for x, _ in ids) == 1:
            for r in by_doc[d]:
                assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    return len(spans)


def test_packed_pieces_are_gapless_and_whole(spark, whole):
    docs = cases.documents(spark)
    rows = packing.packed(docs).collect()
    n = _check_packed(rows, cases.TEXTS, whole, 1024)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 1024) + 1
    assert packing.packed(cases.empty(spark)).count() == 0


def test_packing_small_sequences(spark, whole):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(["word"] * int(n)), "en", "a") for i, n in enumerate(rng.integers(0, 70, 300))]
    rows = packing.packed(cases.documents(spark, texts), places=32).collect()
    n = _check_packed(rows, texts, whole, 32)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 32) + 1


def test_packing_writes_no_more_files_than_tasks_that_encode(spark, whole, tmp_path):
    """Hadoop starts processes for each file, and each counts with an executor's memory until it is loaded."""
    texts = [(i, " ".join(["word"] * (i % 97)), "en", "a") for i in range(300)] + [(300, "word " * 5000, "en", "a")]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    there = {k: spark.conf.get(k) for k in held}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {*folder.rglob("part-*")}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packing.packed(cases.documents(spark, texts).repartition(3)).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in there.items():
            spark.conf.set(k, v)
    _check_packed(spark.read.parquet(str(tmp_path / "out")).collect(), texts, whole, 1024)
    assert len({*folder.rglob("part-*")} - before) <= 3
    assert len([*(tmp_path / "out").glob("part-*")]) <= 3 + 1  # Spark's first task writes one without rows too


def test_plan_uses_up_counts_and_fills_exactly():
    counts = np.zeros(100, np.int64)
    counts[[60, 25, 15, 40, 50]] = 10, 10, 10, 5, 4
    plan = packing.plan(counts, 100)
    assert plan.left.sum() == 0 and np.array_equal(plan.used, counts)
    assert plan.sequences == 14  # 1400 places


def test_complements_against_trying_all():
    rng = np.random.default_rng(6)
    for _ in range(60):
        left = rng.integers(0, 3, 24) * (rng.random(24) < 0.5)
        own = int(rng.integers(1, 24))
        left[own], left[0] = max(1, left[own]), 0
        sums, gap, have = packing._Sums(left, 24), 24 - own, left.copy()
        have[own] -= 1
        pool = sorted((int(x) for x in np.repeat(np.arange(24), have)), reverse=True)
        fits = [c for k in (1, 2, 3) for c in itertools.combinations(pool, k) if sum(c) == gap]
        got = sums.complement(gap, own)
        assert (got is None) == (not fits)
        assert got is None or tuple(got) == max((c for c in fits if len(c) == len(fits[0])))


ONE = {"byte_bpe_50k/1": 0}


def _totals(rollup):
    return {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()}


def test_rollup_is_additive_and_idempotent(spark, whole):
    docs = cases.documents(spark)
    rollup = token_counts.new_rollup(spark)
    counted = token_counts.counted(docs, versions=ONE)
    assert rollup.apply("a", inserts=counted) and not rollup.apply("a", inserts=counted)
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, s in cases.TEXTS:
        want[s, lang][0] += 1
        want[s, lang][1] += len(_ids(whole, t)) - 1
    assert _totals(rollup) == want
    revised = counted.where("doc_id = 1").selectExpr("doc_id", "source", "lang", "tokenizer_version", "100L AS n_tokens")
    gone = counted.where("doc_id IN (6, 99)").select("doc_id", "tokenizer_version")
    assert rollup.apply("b", deletes=gone, revisions=revised)
    assert rollup.apply("empty")
    want["a", "en"][0] -= 2
    want["a", "en"][1] += 100 - (len(_ids(whole, cases.BASE)) - 1) - 2 * (len(_ids(whole, "one two")) - 1)
    assert _totals(rollup) == want
    assert rollup.apply("c", inserts=token_counts.counted(cases.empty(spark), versions=ONE))
    assert _totals(rollup) == want


def test_rollup_of_odd_batches(spark, monkeypatch):
    """Deleted and revised at once, moved to another group, ids that are null; with snapshots in between."""
    monkeypatch.setattr(token_counts, "COMPACT_AFTER", 2)
    rows = lambda values: spark.createDataFrame([(d, s, "en", "v", n) for d, s, n in values], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    rollup = token_counts.new_rollup(spark)
    rollup.apply("1", inserts=rows([(1, "a", 10), (2, "a", 5), (3, "b", 7), (None, "a", 1), (None, "b", 2), (4, "b", 3), (4, "b", 3)]))
    rollup.apply("2", deletes=rows([(1, "a", 0)]), revisions=rows([(1, "a", 7)]))
    assert _totals(rollup) == {("a", "en"): [2, 6], ("b", "en"): [4, 15]}
    rollup.apply("3", revisions=rows([(3, "c", 8), (3, "c", 6), (None, "a", 4), (4, "b", 2)]))
    assert _totals(rollup) == {("a", "en"): [3, 13], ("b", "en"): [2, 4], ("c", "en"): [1, 8]}
    rollup.apply("4", deletes=rows([(None, "a", 0), (9, "a", 0)]))
    assert not rollup.apply("1", inserts=rows([(1, "a", 10)]))
    assert _totals(rollup) == {("a", "en"): [1, 5], ("b", "en"): [2, 4], ("c", "en"): [1, 8]}
    assert rollup._numbers("snapshots") == [2, 4]


def test_two_batches_at_once_are_ordered(spark):
    """A batch that another overtakes starts anew from its ledger."""
    rows = lambda n: spark.createDataFrame([(1, "a", "en", "v", n)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    rollup = token_counts.new_rollup(spark)
    rollup.apply("load", inserts=rows(10))
    own, overtaken = rollup._summed, []

    def slow(name):
        own(name)
        if not overtaken:
            overtaken.append(name)
            token_counts.TokenRollup(spark, rollup.folder).apply("other", revisions=rows(20))

    rollup._summed = slow
    assert rollup.apply("mine", revisions=rows(3))
    assert _totals(rollup) == {("a", "en"): [1, 3]} and rollup._numbers("commits") == [1, 2, 3]


def test_commits_are_whole_or_absent(spark, monkeypatch):
    """A writer that dies before its commit has its name leaves nothing; a commit without content is an error for all."""
    monkeypatch.setattr(token_counts, "COMPACT_AFTER", 3)
    rows = lambda d, n: spark.createDataFrame([(d, "a", "en", "v", n)], "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")
    rollup = token_counts.new_rollup(spark)
    rollup.apply("load", inserts=rows(1, 10))

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(rollup, "_published", dies)
    with pytest.raises(KeyboardInterrupt):
        rollup.apply("lost", inserts=rows(2, 5))
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "COMPACT_AFTER", 3)
    assert rollup._numbers("commits") == [1] and _totals(rollup) == {("a", "en"): [1, 10]}
    assert rollup.apply("lost", inserts=rows(2, 5)) and _totals(rollup) == {("a", "en"): [2, 15]}
    assert not rollup._published("commits/000000000002", {"batch_id": "x", "folder": "y"})
    rollup._fs().create(rollup._path("commits/000000000003"), False).close()
    for read in (rollup.totals, rollup.ledger, lambda: rollup.apply("delete", deletes=rows(2, 0)), lambda: rollup.has("load")):
        with pytest.raises(Exception):  # noqa: B017  Spark's or the rollup's own
            read()
    rollup._fs().delete(rollup._path("commits/000000000003"), False)
    assert rollup.apply("delete", deletes=rows(2, 0)) and rollup._numbers("snapshots") == [3]
    assert rollup.has("load") and rollup.has("delete") and not rollup.has("other")
    assert sorted(r.batch_id for r in spark.read.parquet(f"{rollup.folder}/snapshot-3/ids").collect()) == ["delete", "load", "lost"]


def test_maintained_totals_against_brute_force(spark, whole):
    texts = [*cases.TEXTS, (20, "a\nb\na\nb", "en", "a"), (21, "x y\nx y", "de", "b"), (22, "z\nz", "de", "b")]
    labels = spark.createDataFrame([(1, 0, 5), (22, 0, 5), (7, 1, 5), (99, 0, 5), (None, 1, 5)], "doc_id long, quality int, source int")
    want = defaultdict(lambda: [0, 0])
    for d, t, lang, s in texts:
        if d not in (1, 22):
            lines = (t or "").split("\n")
            # a revision counts for all rows of its doc_id; no doc_id here has several that differ
            n = len(_ids(whole, "\n".join(dict.fromkeys(lines))))
            for version, extra in token_counts.VERSIONS.items():
                want[s, lang, version][0] += 1
                want[s, lang, version][1] += n - 1 + extra
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in token_counts.maintained(cases.documents(spark, texts), labels).collect()}
    assert got == want
    assert token_counts.maintained(cases.empty(spark), labels).count() == 0
