"""Operator 13: hard negatives by one-dimensional distance keys.

The largest inner product becomes the least distance: a vector x gets the further component sqrt(M^2 - |x|^2), M the
largest length, and a query 0; then distance^2 = |q|^2 + M^2 - 2 * score.

1. Each vector's key is its nearest pivot and the distance to it. Vectors are stored sorted by (pivot, distance) in
   blocks, each with its least and greatest distance.
2. Anchors, sorted alike, are searched for a group at a time. A vector at a distance of t to u from a query that lies
   d from a pivot has a key from max(d - u, t - d) to d + u: only blocks that meet this interval can hold it. The
   search starts with the keys at d and expands; what it has found bounds u, and it ends when no unread block meets the
   interval of the last place: nothing nearer is left unread.
3. The first search finds an anchor's positives among rows of its label. The second finds, for each of them, rows of
   other labels with scores in its range: an annulus around the anchor.

A block and the groups that ask for it meet in one task, a bounded number of groups at a time, so a block that all
groups ask for is many tasks. Where distances are all alike, as with random vectors of many dimensions, every block is
read: then this is a scan in blocks. Scores are exact: products of doubles where these are exact, else of integers.

Rows with a null vec_id, label or vector, or with a null or non-finite component, or one that times 256 is none, take no
part. Vectors of other lengths meet only their like; empty ones score 0. Rows of one vec_id: the one with the greatest vector, then label.
Scores beyond 64 bits are held at their ends. Fewer rows than asked for: all of them. Ties: the smaller vec_id. Very
long vectors make smaller blocks. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SCALE, LABELS, POSITIVES, NEGATIVES = 256, 10, 5, 3
#: In hundredths of the positive's score: the range of a negative's.
LOW, HIGH = 50, 95
#: Vectors of a block and anchors of a group, and components of either.
BLOCK, GROUP, VALUES = 4096, 1024, 1 << 18
#: Groups that meet a block in one task.
MET = 8
#: Pivots, and the rows and components of the sample that they are fitted on.
PIVOTS, SAMPLE_ROWS, SAMPLE_VALUES = 16, 2048, 1 << 20
#: Cells that an axis of distances is cut in, to find blocks by equality.
CELLS = 1024
#: How far a search goes, step by step: towards the distance of the last place found, or to where the farthest vector
#: lies if places are still empty.
STEPS = ((0.0, 0.0), (0.5, 1 / 16), (1.0, 1 / 4), (1.0, 1.0))
_NONE = np.iinfo(np.int64).min


@dataclass
class Space:
    """size: what components are divided by, so that no square overflows; top: M^2 after that."""

    pivots: np.ndarray
    size: float
    top: float

    def sides(self, x: np.ndarray) -> np.ndarray:
        """x with its further component."""
        x = x / self.size
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))[:, None]])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors, already with a further component, from the pivots, cut or filled to their length."""
        p = np.zeros((len(self.pivots), x.shape[1]))
        n = min(x.shape[1], self.pivots.shape[1]) - 1
        p[:, :n], p[:, -1] = self.pivots[:, :n], self.pivots[:, -1]
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T
        return np.sqrt(np.maximum(square, 0))

    def distance(self, score: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The distance at which a vector has the score, from a query of squared length `own`; rounded up a little."""
        square = own + self.top - 2 * score.astype(np.float64) / self.size / self.size
        return np.sqrt(np.maximum(square, 0) + 1e-9 * (own + self.top))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exact, as 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in side] for side in (a, b)]
    limit = np.iinfo(np.int64).max
    return np.array([[max(-limit, min(limit, sum(map(int.__mul__, x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(a), len(b))


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label, dim, vector (whole numbers as doubles, in bytes), most (the largest of them): one row a vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec, label, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
                if None in x:
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(np.asarray(x, np.float64) * SCALE)
                if np.isfinite(x).all():
                    out.append((vec, label, len(x), x.tobytes(), float(np.abs(x).max(initial=0))))
            columns = zip(*out) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["vec_id", "label", "dim", "vector", "most"])

    named = table.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = named.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    one = rows.groupBy("vec_id").agg(F.max(F.struct("embedding", "label")).alias("r")).select("vec_id", "r.label", "r.embedding")
    return one.mapInArrow(run, "vec_id long, label long, dim int, vector binary, most double")


def _held(batch: pa.RecordBatch | pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py()) for x in batch.column(column)]


def space(rows: DataFrame) -> Space | None:
    """Pivots: k-means of a bounded sample that hashes pick. None without rows."""
    row = rows.agg(F.count("*").alias("n"), F.max("most").alias("most"), F.max("dim").alias("dim")).first()
    if not row.n:
        return None
    size = row.most or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square = [float(np.square(x / size).sum()) for x in _held(batch, "vector")]
            yield pa.RecordBatch.from_arrays([pa.array(square, pa.float64())], ["square"])

    top = rows.select("vector").mapInArrow(run, "square double").agg(F.max("square")).first()[0]
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, row.dim)))
    some = rows.where("dim > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vector").collect()
    sample = np.zeros((max(1, len(some)), min(row.dim, SAMPLE_VALUES)))
    for at, x in zip(sample, some):
        x = np.frombuffer(x.vector)[: len(at)]
        at[: len(x)] = x
    # lengths are rounded: a little more than the longest
    own = Space(np.zeros((1, 1)), size, top * (1 + 1e-12))
    points = own.sides(sample)
    own.pivots = points[:: max(1, len(points) // PIVOTS)][:PIVOTS].copy()
    for _ in range(5):
        nearest = own.to_pivots(points).argmin(axis=1)
        for k in range(len(own.pivots)):
            if (nearest == k).any():
                own.pivots[k] = points[nearest == k].mean(axis=0)
    return own


def stored(rows: DataFrame, own: Space, limit: int, name: str) -> DataFrame:
    """Blocks of at most `limit` vectors, sorted by (pivot, distance): block (the first vec_id in it), dim, pivot, low and
    high distance, ids, labels, vectors."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            held = _held(batch, "vector")
            pivot, key = np.zeros(len(held), np.int32), np.zeros(len(held))
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                for some in np.array_split(of, -(-len(of) * (int(d) + 1) // VALUES)):
                    far = own.to_pivots(own.sides(np.stack([held[i] for i in some])))
                    pivot[some] = far.argmin(axis=1)
                    key[some] = far.min(axis=1)
            columns = [*(batch.column(c) for c in ("dim", "vec_id", "label", "vector")), pa.array(pivot), pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "vec_id", "label", "vector", "pivot", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            dim, pivot, keys, ids, labels, vectors = (list(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": ids[0], "dim": dim[0], "pivot": pivot[0], "low": min(keys), "high": max(keys),
                        "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "vectors": b"".join(vectors),
                    }
                ],
                pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), *[(c, pa.binary()) for c in ("ids", "labels", "vectors")]]),
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "pivot", "key", "vec_id", "label", "vector"))):
                if held and (row[:2] != held[0][:2] or len(held) >= min(limit, max(1, VALUES // max(1, row[0])))):
                    yield block()
                held.append(row)
        if held:
            yield block()

    order = ["dim", "pivot", "key", "vec_id"]
    keys = rows.mapInArrow(keyed, "dim int, vec_id long, label long, vector binary, pivot int, key double")
    # vec_id as well: copies of one vector by millions are many partitions
    there = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "block long, dim int, pivot int, low double, high double, ids binary, labels binary, vectors binary"
    return written(there.mapInArrow(blocks, kinds), name)


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"]).reshape(len(ids), -1)


def _limits(row: dict, n: int) -> np.ndarray:
    """Least and greatest score of each anchor's slots: anchors x slots x 2; an empty range is a slot without use."""
    return np.frombuffer(row["limits"], np.int64).reshape(n, -1, 2)


def _asked(groups: DataFrame, found: DataFrame, own: Space, k: int, step: tuple[float, float]) -> DataFrame:
    """grp, dim and, for each pivot, the interval of keys read so far and the one to read: hull (2 x 2 x pivots)."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in group.to_pylist():
            ids, _, vectors = _matrix(row)
            limits = _limits(row, len(ids))
            scaled = vectors / own.size
            square = (scaled * scaled).sum(axis=1)
            far = own.to_pivots(np.hstack([scaled, np.zeros((len(ids), 1))]))
            last, counts = np.full(limits.shape[:2], np.iinfo(np.int64).max), np.zeros(limits.shape[:2], np.int64)
            at, slot = np.searchsorted(ids, found.column("anchor_id").to_numpy()), found.column("slot").to_numpy()
            np.minimum.at(last, (at, slot), found.column("score").to_numpy())
            np.add.at(counts, (at, slot), 1)
            # without a score to bound it, a search goes as far as any vector lies
            free = np.broadcast_to((np.sqrt(square) + np.sqrt(own.top))[:, None] * 1.01, last.shape)
            least = np.where(counts >= k, last, limits[:, :, 0])
            u = np.where(least == _NONE, free, own.distance(least, square[:, None]))
            t = np.where(limits[:, :, 1] == np.iinfo(np.int64).max, 0, own.distance(limits[:, :, 1], square[:, None]) - 1e-4 * (np.sqrt(square) + np.sqrt(own.top))[:, None])
            t = np.clip(t, 0, u)
            u = t + np.where(counts >= k, *step) * (u - t)
            used = limits[:, :, 0] <= limits[:, :, 1]
            before = np.frombuffer(row["hull"]).reshape(2, 2, -1)[1] if row["hull"] else np.stack([np.full(len(own.pivots), np.inf), np.full(len(own.pivots), -np.inf)])
            after = before.copy()
            slack = 1e-7 * np.sqrt(own.top + square.max(initial=0))
            for p, d in enumerate(far.T[:, :, None]) if used.any() else ():
                if step[0]:
                    low, high = np.maximum(d - u, t - d), d + u
                else:
                    low = high = np.broadcast_to(d, used.shape)
                after[0, p] = min(after[0, p], low[used].min() - slack)
                after[1, p] = max(after[1, p], high[used].max() + slack)
            out.append({"grp": row["grp"], "dim": row["dim"], "hull": np.stack([before, after]).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.int64()), ("dim", pa.int32()), ("hull", pa.binary())]))

    return groups.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(run, "grp long, dim int, hull binary")


def _pairs(asked: DataFrame, blocks: DataFrame, own: Space) -> DataFrame:
    """grp, block: the blocks that meet the interval to read and not the one read before."""
    width = 4 * (own.top**0.5 or 1.0) / CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hull = np.stack(_held(batch, "hull")).reshape(batch.num_rows, 4, -1) if batch.num_rows else np.zeros((0, 4, 0))
            k = hull.shape[2]
            ends = [pa.array(hull[:, i].reshape(-1)) for i in range(4)]
            named = [pa.array(np.repeat(batch.column(c).to_numpy(), k)) for c in ("grp", "dim")]
            yield pa.RecordBatch.from_arrays([*named, pa.array(np.tile(np.arange(k, dtype=np.int32), batch.num_rows)), *ends], ["grp", "dim", "pivot", "a0", "b0", "a", "b"])

    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    rows = asked.mapInArrow(run, "grp long, dim int, pivot int, a0 double, b0 double, a double, b double")
    rows = rows.where("a <= b AND (a < a0 OR b > b0)").withColumns({"a": F.greatest("a", F.lit(0.0)), "b": F.least("b", F.lit(width * CELLS))})
    rows = rows.where("a <= b").withColumn("cell", cells("a", "b"))
    there = blocks.select("block", "dim", "pivot", "low", "high").withColumn("cell", cells("low", "high"))
    both = rows.join(there, ["dim", "pivot", "cell"])
    # told once, in the first cell that both have
    first = F.col("cell") == F.greatest(F.floor(F.col("low") / width), F.floor(F.col("a") / width))
    return both.where(first & F.expr("low <= b AND high >= a AND NOT (low <= b0 AND high >= a0)")).select("grp", "block")


def _met(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """grp, anchor_id, slot, score, vec_id: the best k of each block for each slot of the anchors that ask for it."""

    def run(asking: pa.Table, block: pa.Table) -> pa.Table:
        (there,) = block.to_pylist()
        ids, labels, vectors = _matrix(there)
        order = np.argsort(ids)  # the first of equal scores is the one of the smaller vec_id
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        out = [np.zeros((5, 0), np.int64)]
        for row in asking.to_pylist():
            anchors, own_labels, own = _matrix(row)
            limits = _limits(row, len(anchors))
            scores = products(own, vectors)
            fits = ((own_labels[:, None] == labels[None]) == same) & (anchors[:, None] != ids[None])
            for slot in range(limits.shape[1]):
                low, high = limits[:, slot, :1], limits[:, slot, 1:]
                left = np.where(fits & (scores >= low) & (scores <= high), scores, _NONE)
                for _ in range(min(k, len(ids))):
                    best = left.argmax(axis=1)
                    top = np.take_along_axis(left, best[:, None], axis=1)[:, 0]
                    some = np.flatnonzero(top != _NONE)
                    if not len(some):
                        break
                    out.append(np.stack([np.full(len(some), row["grp"]), anchors[some], np.full(len(some), slot), top[some], ids[best[some]]]))
                    left[some, best[some]] = _NONE
        found = np.concatenate(out, axis=1)
        return pa.table([found[0], found[1], found[2].astype(np.int32), found[3], found[4]], ["grp", "anchor_id", "slot", "score", "vec_id"])

    parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / MET).alias("parts"))
    dealt = pairs.join(parts, "block").withColumn("share", F.pmod(F.xxhash64("grp"), F.col("parts")))
    asking = dealt.select("block", "share", "grp").join(groups.select("grp", "ids", "labels", "vectors", "limits"), "grp")
    there = dealt.select("block", "share").distinct().join(blocks.select("block", "ids", "labels", "vectors"), "block")
    there = there.withColumnsRenamed({"block": "of", "share": "part"})
    both = asking.groupBy("block", "share").cogroup(there.groupBy("of", "part"))
    return both.applyInArrow(run, "grp long, anchor_id long, slot int, score long, vec_id long")


def _searched(groups: DataFrame, blocks: DataFrame, own: Space, k: int, same: bool) -> DataFrame:
    """grp, anchor_id, slot, score, vec_id, rank: the best k of each anchor's slots, of its label or of the others."""
    spark = groups.sparkSession
    found = spark.createDataFrame([], "grp long, anchor_id long, slot int, score long, vec_id long, rank int")
    groups = groups.withColumn("hull", F.lit(None).cast("binary"))
    place = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    for step in STEPS:
        asked = written(_asked(groups, found, own, k, step), "asked")
        groups = groups.drop("hull").join(asked.select("grp", "hull"), "grp")
        pairs = _pairs(asked, blocks, own).checkpoint()
        if not pairs.isEmpty():
            both = found.drop("rank").unionByName(_met(pairs, groups, blocks, k, same))
            found = written(both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), "found")
    return found


def _with_limits(groups: DataFrame, found: DataFrame | None, limits: Callable[[int], tuple[int, int]]) -> DataFrame:
    """groups with the limits of each anchor's slots: of one without limits, or of one for each row found, by its score."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in group.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            held = np.zeros((len(ids), POSITIVES, 2), np.int64)
            held[:, :, 0] = 1
            for anchor, rank, score in zip(*(found.column(c).to_pylist() for c in ("anchor_id", "rank", "score"))):
                held[np.searchsorted(ids, anchor), rank - 1] = limits(score)
            out.append({"grp": row["grp"], "limits": held.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.int64()), ("limits", pa.binary())]))

    if found is None:
        free = np.array([_NONE, np.iinfo(np.int64).max]).tobytes()
        return groups.withColumn("limits", F.expr(f"unhex(repeat('{free.hex()}', cast(length(ids) / 8 as int)))"))
    both = groups.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(run, "grp long, limits binary")
    return written(groups.join(both, "grp"), "limits")


def _range(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative to a positive of this score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors with these in order of their vec_ids."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            ids, labels, vectors = _matrix(row)
            order = np.argsort(ids)
            row |= {"ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": vectors[order].tobytes()}
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def hard_negatives(table: DataFrame, anchors: str = "vec_id % 50 = 0") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors: which rows are."""
    rows = written(usable(table), "vectors")
    own = space(rows)
    if own is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = stored(rows, own, BLOCK, "blocks")
    groups = stored(rows.where(anchors), own, GROUP, "groups")
    groups = groups.mapInArrow(_by_id, groups.schema).withColumnRenamed("block", "grp")
    positives = _searched(_with_limits(groups, None, _range), blocks, own, POSITIVES, True)
    negatives = _searched(_with_limits(groups, positives, _range), blocks, own, NEGATIVES, False)
    named = positives.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


ORACLE = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
