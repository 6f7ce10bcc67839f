"""Operator 10: language of texts and of spans within them.

A word is a run of letters. The script of its first letter narrows the languages to those seen in that script;
each of these gives the word a score, the mean log probability of its three-letter pieces times their number,
plus that of the word as a whole. A Viterbi pass over a document's words finds the best languages for all of
them together, where each change costs a penalty. Words of one label in a row are a span; a document's language
is that of most letters.

The tables of counts are learned from a sample of the labelled documents, bounded by TRAIN_ROWS and chosen by a
hash of doc_id, each whole. Scoring uses the text alone.

Null text, or one without letters: `und`, score 0. Letters in scripts of no learned language: all languages
compete, and such letters add nothing to the score. No labelled documents: `und` everywhere. Ties: the language
first in the alphabet. Null doc_id: not learned from, scored. Rows with one doc_id: scored each. A very long text
is scored whole, alone in its block: memory follows its words. A mark counts with the letter before it; marks alone
are no letters. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import string_blocks
from .words import mix

TRAIN_ROWS = 6000
SWITCH_PENALTY = 8.0
PIECE_BITS, WORD_BITS = 16, 17
UNKNOWN = "und"
#: Share of a language's training letters in a script that makes it a candidate there.
SCRIPT_SHARE = 0.001
#: A document whose language covers less of its letters is rejected by the pipeline.
LEAST_SCORE = 0.25
#: First and last code point of scripts' blocks.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["Other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_tables: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point its script's number plus 2 if it is a letter, 1 for a mark, which belongs to the word of the
    letter before it, else 0."""
    if not _tables:
        kinds = {"L": 2, "M": 1}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
        for name, low, high in SCRIPTS:
            part = table[low : high + 1]
            part[part > 1] = SCRIPT_NAMES.index(name) + 2
        _tables.append(table)
    return _tables[0]


@dataclass
class Words:
    """Words of some texts: bucket of each letter's piece, and of each word; where words and texts begin."""

    pieces: np.ndarray
    starts: np.ndarray
    whole: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    first: np.ndarray
    spans: np.ndarray


def words_of(texts: list[str]) -> Words:
    lowered = [x.lower() if len(x.lower()) == len(x) else x for x in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = script_table()[points]
    # a mark without a letter before it is no word
    real = kind > 1
    last = np.maximum.accumulate(np.where(kind != 1, np.arange(len(kind)), 0)) if len(kind) else np.zeros(0, np.int64)
    real |= (kind == 1) & (kind[last] > 1)
    kind = np.where(real, np.maximum(kind, 2), 0)
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = real
    begin = np.flatnonzero(~letter[:-1] & letter[1:])
    end = np.flatnonzero(letter[:-1] & ~letter[1:])
    x = np.where(kind > 0, points, 0).astype(np.uint64)
    x = np.concatenate([np.zeros(1, np.uint64), x, np.zeros(1, np.uint64)])
    at = np.flatnonzero(kind > 0)
    own = x[at + 1]
    piece = mix(x[at] * np.uint64(0x9E3779B97F4A7C15) + own * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 2] * np.uint64(0x165667B19E3779F9))
    lengths = end - begin
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(begin) else np.zeros(0, np.int64)
    # a word's hash: the sum of its letters' pieces, each with its place in the word
    place = np.arange(len(at), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(piece + place), dtype=np.uint64)])
    whole = mix(summed[starts + lengths] - summed[starts])
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return Words(
        (piece >> np.uint64(64 - PIECE_BITS)).astype(np.int32), starts,
        (whole >> np.uint64(64 - WORD_BITS)).astype(np.int32), kind[begin] - 2 if len(begin) else np.zeros(0, np.uint8),
        lengths, np.searchsorted(begin, edges), np.stack([begin, end]) if len(begin) else np.zeros((2, 0), np.int64),
    )


@dataclass
class Model:
    languages: list[str]
    pieces: np.ndarray  # log probabilities, bucket by language
    words: np.ndarray
    scripts: np.ndarray  # script by language: is it a candidate

    def scores(self, words: Words) -> np.ndarray:
        """Word by language; languages that the script excludes are far below."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        out = np.add.reduceat(self.pieces[words.pieces], words.starts, axis=0) + self.words[words.whole]
        allowed = self.scripts[words.script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, np.float32(-1e6)).astype(np.float32)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word. first: where each text's words begin, and the end. All texts go along together."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    kind = np.min_scalar_type(max(1, scores.shape[1]))  # of labels: a byte each for up to 255 languages
    came = np.zeros(scores.shape, kind)
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with more words than the step
    value = scores[begin[: active[0]]].astype(np.float64)
    own = np.arange(scores.shape[1], dtype=kind)
    ends = np.zeros(len(order), kind)
    ends[: active[0]] = value.argmax(axis=1)
    for t in range(1, steps):
        n = active[t]
        value = value[:n]
        best = value.argmax(axis=1)
        moved = value[np.arange(n), best] - penalty
        switch = value < moved[:, None]
        at = begin[:n] + t
        came[at] = np.where(switch, best[:, None].astype(kind), own)
        value = np.where(switch, moved[:, None], value) + scores[at]
        ends[:n] = value.argmax(axis=1)
    label = ends.copy()
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        labels[at] = label[:n]
        if t:
            label[:n] = came[at, label[:n]]
    return labels


def _learnable(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Counts of pieces and words by language, over some `rows` documents."""
    labelled = _learnable(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    total = labelled.select("doc_id").count()
    if total > rows:
        share = int(rows / total * (1 << 30))
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                words = words_of([t for t, x in zip(texts, langs) if x == lang])
                sums = found.setdefault(lang, [np.zeros(1 << PIECE_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)])
                sums[0] += np.bincount(words.pieces, minlength=1 << PIECE_BITS)
                sums[1] += np.bincount(words.whole, minlength=1 << WORD_BITS)
                sums[2] += np.bincount(words.script, weights=words.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, sums in found.items():
            for table, counts in enumerate(sums):
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(seen), pa.string()), pa.array([table] * len(seen), pa.int32()), pa.array(seen, pa.int32()), pa.array(counts[seen])],
                    ["lang", "kind", "bucket", "n"],
                )

    counted = labelled.select("text", "lang").mapInArrow(run, "lang string, kind int, bucket int, n long")
    rows_ = counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets by language
    languages = sorted(rows_["lang"].unique())
    sizes = [1 << PIECE_BITS, 1 << WORD_BITS, len(SCRIPT_NAMES)]
    tables = [np.zeros((n, len(languages))) for n in sizes]
    number = {x: k for k, x in enumerate(languages)}
    for kind, table in enumerate(tables):
        part = rows_[rows_["kind"] == kind]
        table[part["bucket"].to_numpy(), part["lang"].map(number).to_numpy(int)] = part["n"].to_numpy()
    logs = [np.log((t + 0.5) / (t.sum(axis=0) + 0.5 * len(t))).astype(np.float32) for t in tables[:2]]
    # only what tells languages apart matters, and the same is taken from all
    logs = [x - x.mean(axis=1, keepdims=True) if len(languages) else x for x in logs]
    return Model(languages, logs[0], logs[1], tables[2] > SCRIPT_SHARE * tables[2].sum(axis=0))


def _told(batches: Iterator[pa.RecordBatch], model: Model, with_spans: bool, penalty: float) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """Slices of the batches, each with the columns lang_pred and score (with_spans: also spans) of its rows."""

    def told(texts, held, begin) -> list[pa.Array]:
        scores = np.concatenate([h[0] for h in held])
        letters = np.concatenate([h[1] for h in held]).astype(np.float64)
        script = np.concatenate([h[3] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])
        first = np.concatenate([h[2][:-1] + b for h, b in zip(held, base)] + [base[-1:]])
        n, many = len(texts), len(model.languages)
        if not many:
            labels = np.zeros(len(scores), np.int32)
        else:
            labels = viterbi(scores, first, penalty)
        doc = np.repeat(np.arange(n), np.diff(first))
        votes = np.zeros((n, max(1, many)))
        np.add.at(votes, (doc, labels), letters)
        sure = np.zeros((n, max(1, many)))
        if many:
            known = model.scripts[script].any(axis=1) if len(script) else np.zeros(0, bool)
            np.add.at(sure, (doc, labels), letters * known)
        best, total = votes.argmax(axis=1), votes.sum(axis=1)
        some = (total > 0) & (many > 0)
        columns = [
            pa.array([model.languages[k] if s else UNKNOWN for k, s in zip(best, some)], pa.string()),
            pa.array(np.where(some, sure[np.arange(n), best] / np.maximum(total, 1), 0.0)),
        ]
        if with_spans:
            places = np.concatenate([h[4] - _offsets(h, texts, begin) for h in held], axis=1)
            columns.append(pa.array(_spans(labels, first, places, model.languages), _SPANS))
        return columns

    for part, texts in string_blocks(batches, limit=1 << 19):
        held, stop = [], 0
        while stop < len(texts):
            # scores of some texts at a time, labels for all of them
            upto, size = stop, 0
            while upto < len(texts) and (upto == stop or size + len(texts[upto]) < 1 << 18):
                size += len(texts[upto])
                upto += 1
            words = words_of(texts[stop:upto])
            held.append((model.scores(words), words.letters, words.first, words.script, words.spans, stop))
            stop = upto
        yield part, told(texts, held, 0)


def identified(docs: DataFrame, model: Model, with_spans: bool = False, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score of every row; with_spans: also start, end (in characters) and lang of spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets by language, bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in _told(batches, sent.value, with_spans, penalty):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    names = ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * with_spans
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _offsets(held: tuple, texts: list[str], begin: int) -> np.ndarray:
    """Where the text of each word begins in the joined ones."""
    first, stop = held[2], held[5] - begin
    sizes = np.cumsum([0] + [len(t) + 1 for t in texts[stop : stop + len(first) - 1]])[:-1]
    return np.repeat(sizes, np.diff(first))


def _spans(labels: np.ndarray, first: np.ndarray, places: np.ndarray, languages: list[str]) -> list[list[dict]]:
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        cuts = i + 1 + np.flatnonzero(labels[i + 1 : j] != labels[i : j - 1]) if j > i else np.zeros(0, int)
        edges = [i, *cuts.tolist(), j] if j > i and languages else []
        out.append(
            [{"start": int(places[0, a]), "end": int(places[1, b - 1]), "lang": languages[labels[a]]} for a, b in zip(edges, edges[1:])]
        )
    return out


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from the rows not held out."""
    found = identified(docs, learn(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language could be told.

    Each row is judged by its own text: others of its doc_id, null too, neither hold it nor take it along.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (lang, score) in _told(batches, sent.value, False, SWITCH_PENALTY):
            yield part.filter(pc.and_(pc.not_equal(lang, UNKNOWN), pc.greater_equal(score, LEAST_SCORE)))

    return docs.mapInArrow(run, docs.schema)


def held_out_row(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
