"""Operator 5: packing documents into sequences of a fixed length.

Only a histogram of lengths is needed to decide which lengths share a sequence, and it has as many rows as a
sequence has places, whatever the input. Exact complements first: an index holds the sums of one, two and three
lengths that occur; for a piece of length L the gap is looked up there, and what adds up to it is used as often as
all of it is there. What is left goes to the fullest open sequence that takes it. Each decision is a run: `times`
sequences alike. A piece then finds its run by its rank among the pieces of its length.

Null text: an empty document, of the end id alone. Null doc_id: packed, and stays null. Rows with one doc_id, and
equal rows, are documents each. Ties among complements: the one of the longest piece, then of the next. A very long
text is cut in pieces; it is encoded whole, alone in its block. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, written
from .tokenization import END_ID, TEXT_BYTES, default_vocabulary, encoder

PLACES = 1024
#: Bytes of text encoded at once where memory is dearer than time: a fifth more CPU seconds, some 50 MB less in a worker.
FEW_BYTES = TEXT_BYTES // 2


def pieces_of(n: int, places: int = PLACES) -> list[int]:
    """Lengths of a document's pieces; only the first may be shorter than the others."""
    if n <= places:
        return [n]
    first = n % places
    return [first] * bool(first) + [places] * (n // places)


class _Plan:
    """Runs: pieces of `length` with ranks from `low` stand at `offset` of the sequences from `sequence` on."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.used = np.zeros_like(counts)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, low, high, first sequence, offset
        self.sequences = 0

    def place(self, length: int, times: int, sequence: int, offset: int) -> None:
        low = int(self.used[length])
        self.runs.append((length, low, low + times, sequence, offset))
        self.used[length] += times
        self.left[length] -= times

    def open(self, times: int) -> int:
        first, self.sequences = self.sequences, self.sequences + times
        return first


class _Sums:
    """Sums of one, two and three of the lengths that are left, by hash: a length for its own sum, pairs of lengths
    under the sum of both, and under a sum of three the longest of them, the other two being a pair of the rest.

    Entries of lengths that are used up are taken out when they are met, so each is passed over once.
    """

    def __init__(self, left: np.ndarray, places: int):
        self.left = left
        lengths = np.flatnonzero(left)[::-1].tolist()
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(lengths):
            for b in lengths[i:]:
                if a + b < places:
                    self.pairs.setdefault(a + b, []).append((a, b))  # longest first
        self.triples: dict[int, list[int]] = {}
        sums = np.zeros(places, bool)
        sums[list(self.pairs)] = True
        for a in lengths:
            # the other two are no longer than a
            for rest in np.flatnonzero(sums[: min(2 * a, places - 1 - a) + 1]).tolist():
                self.triples.setdefault(a + rest, []).append(a)

    def _pair(self, total: int, most: int, taken: dict[int, int]) -> list[int] | None:
        entries = self.pairs.get(total)
        if not entries:
            return None
        if any(self.left[a] <= 0 or self.left[b] <= 0 for a, b in entries[:1]):
            entries[:] = [(a, b) for a, b in entries if self.left[a] > 0 and self.left[b] > 0]
        for a, b in entries:
            if a <= most and self.left[a] >= taken.get(a, 0) + 1 + (a == b) and self.left[b] >= taken.get(b, 0) + 1 + (a == b):
                return [a, b]
        return None

    def complement(self, gap: int, own: int) -> list[int] | None:
        """Up to three lengths there that add up to the gap, one piece of length `own` being taken; longest first."""
        if self.left[gap] > (gap == own):
            return [gap]
        if found := self._pair(gap, gap, {own: 1}):
            return found
        heads = self.triples.get(gap, [])
        if heads and self.left[heads[0]] <= 0:
            heads[:] = [a for a in heads if self.left[a] > 0]
        for a in heads:
            taken = {own: 1}
            taken[a] = taken.get(a, 0) + 1
            if self.left[a] >= taken[a] and (found := self._pair(gap - a, a, taken)):
                return [a, *found]
        return None


def plan(counts: np.ndarray, places: int = PLACES) -> _Plan:
    """counts[L]: pieces of length L, for L below `places`. Every run uses up a length or fills a class of gaps."""
    p = _Plan(np.asarray(counts, np.int64))
    sums = _Sums(p.left, places)
    for length in range(places - 1, 0, -1):
        while p.left[length] > 0:
            rest = sums.complement(places - length, length)
            if rest is None:
                break
            lengths = [length, *rest]
            each = {x: lengths.count(x) for x in lengths}
            times = min(int(p.left[x]) // k for x, k in each.items())
            first, offset = p.open(times), 0
            for x in lengths:
                p.place(x, times, first, offset)
                offset += x
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of open sequences with it
    for length in range(places - 1, 0, -1):
        while p.left[length] > 0:
            there = int(p.left[length])
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                fit = places // length
                times, copies = (there // fit, fit) if there >= fit else (1, there)
                first = p.open(times)
                for k in range(copies):
                    p.place(length, times, first, k * length)
                if rest := places - copies * length:
                    gaps.setdefault(rest, []).append((first, times))
                continue
            first, times = gaps[gap].pop()
            take = min(times, there)
            p.place(length, take, first, places - gap)
            if rest := gap - length:
                gaps.setdefault(rest, []).append((first, take))
            if times > take:
                gaps[gap].append((first + take, times - take))
            if not gaps[gap]:
                del gaps[gap]
    return p


def _measured(docs: DataFrame, vocabulary: str, places: int, at_once: int) -> DataFrame:
    """A row a document: its length, its pieces' checksums, and its place among those of its task. And a row a task,
    which alone has counts: of its short pieces by length, and at 0 of its full ones."""

    types = {
        "doc_id": pa.int64(), "task": pa.int32(), "n": pa.int64(), "kind": pa.int32(), "rank": pa.int64(),
        "full_rank": pa.int64(), "crcs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        short, full = np.zeros(places, np.int64), 0
        end = np.array([END_ID], "<u4").tobytes()
        for part in slices(batches, limit=at_once):
            lengths, sums, kinds, ranks, fulls = [], [], [], [], []
            for ids in encode(part.column("text")):
                ids += end
                n = len(ids) // 4
                cuts = np.cumsum([0, *pieces_of(n, places)]).tolist()
                kind = n % places  # 0: no piece is short
                lengths.append(n)
                sums.append([zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(cuts, cuts[1:])])
                kinds.append(kind)
                ranks.append(int(short[kind]))
                fulls.append(full)
                short[kind] += 1
                full += n // places
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([task] * part.num_rows, pa.int32()), pa.array(lengths, pa.int64()),
                    pa.array(kinds, pa.int32()), pa.array(ranks, pa.int64()), pa.array(fulls, pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())), pa.nulls(part.num_rows, pa.list_(pa.int64())),
                ],
                [*types],
            )
        if short.any():
            short[0] = full
            own = {"task": [task], "counts": [short.tolist()]}
            yield pa.RecordBatch.from_arrays([pa.array(own.get(c, [None]), t) for c, t in types.items()], [*types])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, task int, n long, kind int, rank long, full_rank long, crcs array<long>, counts array<long>"
    )


def packed(docs: DataFrame, vocabulary: str | None = None, places: int = PLACES, at_once: int = TEXT_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece. at_once: bytes of text encoded at once."""
    measured = written(_measured(docs, vocabulary or default_vocabulary(), places, at_once), "lengths")
    documents, tasks = measured.where("counts IS NULL"), measured.where("counts IS NOT NULL")
    counts = tasks.select("task", F.posexplode("counts").alias("kind", "n"))
    totals = np.zeros(places, np.int64)
    for row in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # a row a length at most
        totals[row.kind] = row.n
    totals[0] = 0  # full pieces need no plan
    runs = plan(totals, places)
    # ranks in all tasks: the counts of the tasks before, in one row a task. Rows of a task stay together, so the pieces
    # stand in no more files than the documents, whatever the number of shuffle partitions
    earlier = Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", F.struct("kind", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).alias("x"))
    before = before.groupBy("task").agg(F.sort_array(F.collect_list("x"))["base"].alias("bases"))
    ranked = documents.join(before, "task").select(
        "doc_id", "n", "kind", "crcs",
        (F.get("bases", F.col("kind")) + F.col("rank")).alias("rank"),
        (F.get("bases", F.lit(0)) + F.col("full_rank")).alias("full_rank"),
    )
    table = np.array(sorted(runs.runs), np.int64).reshape(-1, 5)
    sequences = runs.sequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, _, first, offset = table.T
        bounds = np.searchsorted(length, np.arange(places + 1))
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list[int]] = [[] for _ in range(7)]
            for doc, n, kind, sums, rank, full in zip(*(rows[c] for c in rows)):
                start = 0
                for k, (size, crc) in enumerate(zip(pieces_of(n, places), sums)):
                    if size < places:
                        i = bounds[kind] + int(np.searchsorted(low[bounds[kind] : bounds[kind + 1]], rank, "right")) - 1
                        sequence, at = int(first[i]) + rank - int(low[i]), int(offset[i])
                    else:
                        sequence, at, full = sequences + full, 0, full + 1
                    for column, value in zip(out, (doc, k, start, size, crc, sequence, at)):
                        column.append(value)
                    start += size
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
