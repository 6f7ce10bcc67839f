"""Operator 9: nearest neighbours by a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards of some SHARD_ROWS by a hash, a task each. A shard's index is one row: its vectors, and for each
level a flat array of neighbours, -1 where there is none. A vector is on level l and below with probability
M**-l. On a level its neighbours are chosen among its nearest there: one is taken if it is nearer to the vector
than to all taken before, so links point in many directions; links are made both ways. A search walks greedily
down to level 0 and there keeps the best EF found. Queries, in blocks, meet every shard; each returns its best,
by the exact measure, and the best of all shards are merged.

Equal vectors are one entry of the index, with the least vec_ids of its copies, as many as a result can hold.

Vectors null, zero, or holding nulls or non-finite numbers take no part; nor do rows without vec_id. Vectors of
other lengths are in shards of their own and meet only their like. Repeated vec_ids: the row of the greatest
vector counts. Ties of nearness: the smaller vec_id, as far as both are found. Fewer candidates than asked for: all of them. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Vectors of a shard: a query is sent to each shard, so fewer and larger ones are less work.
SHARD_ROWS = 32_768
QUERY_BLOCK = 2048
M, EF = 16, 96
#: Nearest vectors that a level's links are chosen among.
POOL = 48


@dataclass
class Graph:
    vectors: np.ndarray  # of length 1, 32-bit
    levels: list[tuple[np.ndarray, np.ndarray]]  # nodes on the level, and their neighbours; from the bottom up


def _nearest(x: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    """For each node of a level the k nearest others there, nearest first."""
    own, out = x[nodes], []
    for i in range(0, len(nodes), 256):
        sims = own[i : i + 256] @ own.T
        sims[np.arange(len(sims)), i + np.arange(len(sims))] = -np.inf
        top = np.argpartition(-sims, min(k, len(nodes) - 1) - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
        out.append(nodes[top])
    return np.concatenate(out)


def _diverse(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
    """Links of each node: from its pool, nearest first, those nearer to it than to all chosen before."""
    out = np.full((len(nodes), most), -1, np.int32)
    for i in range(0, len(nodes), 512):
        near = pool[i : i + 512]
        v = x[near]
        to_node = np.einsum("bkd,bd->bk", v, x[nodes[i : i + 512]])
        between = np.einsum("bkd,bjd->bkj", v, v)
        taken = np.zeros(near.shape, bool)
        for k in range(near.shape[1]):
            closest = np.where(taken, between[:, k], -np.inf).max(axis=1)
            taken[:, k] = (to_node[:, k] > closest) & (taken.sum(axis=1) < most)
        # room that is left goes to the nearest of the others
        order = np.argsort(np.where(taken, 0, 1), axis=1, kind="stable")[:, :most]
        out[i : i + 512, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def _both_ways(x: np.ndarray, nodes: np.ndarray, links: np.ndarray, most: int) -> np.ndarray:
    """The links and their reverses; of too many, a node's own first, then the nearest."""
    number = np.full(len(x), -1, np.int64)
    number[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), links.shape[1])
    b = links.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    source, target = np.concatenate([a, number[b]]), np.concatenate([b, nodes[a]])
    own = np.repeat([0, 1], len(a))
    pairs = source * len(x) + target
    _, keep = np.unique(pairs, return_index=True)  # the first copy is the node's own link
    source, target, own = source[keep], target[keep], own[keep]
    sims = np.einsum("nd,nd->n", x[nodes[source]], x[target])
    order = np.lexsort((-sims, own, source))
    source, target = source[order], target[order]
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    out = np.full((len(nodes), most), -1, np.int32)
    fits = rank < most
    out[source[fits], rank[fits]] = target[fits]
    return out


def build(vectors: np.ndarray, seed: int = 11) -> Graph:
    """vectors: rows, none of them zero."""
    x = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    x = np.ascontiguousarray(x, np.float32)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)).astype(int)
    levels = []
    for l in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= l).astype(np.int32)
        most = 2 * M if l == 0 else M
        if len(nodes) < 2:
            levels.append((nodes, np.full((len(nodes), most), -1, np.int32)))
            continue
        pool = _nearest(x, nodes, min(POOL, len(nodes) - 1))
        links = _diverse(x, nodes, pool, min(M, pool.shape[1]))
        levels.append((nodes, _both_ways(x, nodes, links, most)))
    return Graph(x, levels)


def _similarities(x: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    sims = np.einsum("qkd,qd->qk", x[np.maximum(ids, 0)], queries)
    return np.where(ids >= 0, sims, -np.inf)


def search(graph: Graph, queries: np.ndarray, ef: int = EF) -> np.ndarray:
    """For each query (of length 1) up to ef nodes, nearest first, -1 where there are fewer. All walk together."""
    x, n = graph.vectors, len(queries)
    top_nodes = graph.levels[-1][0]
    here = np.full(n, top_nodes[0], np.int32)
    best = queries @ x[top_nodes[0]]
    for nodes, links in reversed(graph.levels[1:]):
        number = np.full(len(x), -1, np.int64)
        number[nodes] = np.arange(len(nodes))
        moving = np.arange(n)
        while len(moving):
            near = links[number[here[moving]]]
            sims = _similarities(x, queries[moving], near)
            k = sims.argmax(axis=1)
            value = sims[np.arange(len(moving)), k]
            better = value > best[moving]
            moving, near, k, value = moving[better], near[better], k[better], value[better]
            here[moving], best[moving] = near[np.arange(len(moving)), k], value
    links = graph.levels[0][1]
    found = np.full((n, ef), -1, np.int32)
    value = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)  # entries without a node need no look
    found[:, 0], value[:, 0], done[:, 0] = here, best, False
    seen = np.zeros((n, len(x)), bool)
    seen[np.arange(n), here] = True
    rows = np.arange(n)
    at_once = 4  # nodes that a query looks at in one step
    while len(rows):
        order = np.argsort(np.where(done[rows], np.inf, -value[rows]), axis=1, kind="stable")[:, :at_once]
        open_ = ~np.take_along_axis(done[rows], order, 1)
        picked = np.where(open_, np.take_along_axis(found[rows], order, 1), -1)
        done[rows[:, None], order] = True
        near = np.where(picked[:, :, None] >= 0, links[np.maximum(picked, 0)], -1).reshape(len(rows), -1)
        near = np.where((near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)], near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # the same node from two sides
        r, c = np.nonzero(near >= 0)
        seen[rows[r], near[r, c]] = True
        sims = _similarities(x, queries[rows], near)
        all_ids = np.concatenate([found[rows], near], axis=1)
        all_values = np.concatenate([value[rows], sims.astype(np.float32)], axis=1)
        all_done = np.concatenate([done[rows], near < 0], axis=1)
        order = np.argsort(-all_values, axis=1, kind="stable")[:, :ef]
        found[rows] = np.take_along_axis(all_ids, order, 1)
        value[rows] = np.take_along_axis(all_values, order, 1)
        done[rows] = np.take_along_axis(all_done, order, 1)
        rows = rows[~done[rows].all(axis=1)]
    return found


def _usable(table: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part, one a vec_id."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(sound).groupBy("vec_id").agg(F.max("v").alias("v"))


def index(vectors: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """The shards' indexes, and for each entry (its least vec_id) up to `copies` of the vec_ids with its vector."""
    keyed = vectors.withColumn("key", F.xxhash64(F.col("v").cast("string"))).withColumn("dim", F.size("v"))
    # least vec_ids of each vector: in salted parts first, as a vector may be that of many rows
    part = Window.partitionBy("key", "v", "salt").orderBy("vec_id")
    few = keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = few.withColumn("k", F.row_number().over(part)).where(F.col("k") <= copies)
    whole = Window.partitionBy("key", "v").orderBy("vec_id")
    few = few.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= copies)
    few = few.withColumn("entry", F.min("vec_id").over(Window.partitionBy("key", "v")))
    few = written(few.select("entry", "vec_id", "v", "dim", "k"), "vectors")
    entries = few.where("k = 1")
    sizes = entries.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    dealt = entries.join(F.broadcast(sizes), "dim")  # a row a length of vectors
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("entry"), F.col("shards")).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("entry").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.array(table.column("v").to_pylist(), np.float64)[order]
        graph = build(v)
        flat = [np.concatenate([nodes[:, None], links], axis=1).astype(np.int32) for nodes, links in graph.levels]
        return pa.table(
            {
                "dim": pa.array([v.shape[1]], pa.int32()),
                "shard": table.column("shard").slice(0, 1),
                "ids": pa.array([ids[order].astype(np.int64).tobytes()]),
                "vectors": pa.array([v.tobytes()]),
                "levels": pa.array([[x.tobytes() for x in flat]], pa.list_(pa.binary())),
            }
        )

    built = dealt.select("dim", "shard", "entry", "v").groupBy("dim", "shard").applyInArrow(
        run, "dim int, shard int, ids binary, vectors binary, levels array<binary>"
    )
    return written(built, "index"), few.select("entry", "vec_id")


def _read(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    levels = []
    for k, raw in enumerate(row["levels"]):
        flat = np.frombuffer(raw, np.int32).reshape(-1, 1 + (2 * M if k == 0 else M))
        levels.append((flat[:, 0], flat[:, 1:]))
    x = np.ascontiguousarray(v / np.linalg.norm(v, axis=1, keepdims=True), np.float32)
    return Graph(x, levels), np.frombuffer(row["ids"], np.int64), v


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of `table` nearest to each of `queries`, itself left out."""
    copies = k + 1
    built, few = index(_usable(table), copies)
    asked = _usable(queries)
    count = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = built.groupBy("dim").agg(F.collect_set("shard").alias("shards"))  # numbers only
    sent = asked.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block"))
    sent = sent.join(F.broadcast(shards), "dim").select("dim", F.explode("shards").alias("shard"), "block", "vec_id", "v")
    ready = built.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))

    def run(indexes: pa.Table, wanted: pa.Table) -> pa.Table:
        out = ([], [], [])
        if indexes.num_rows and wanted.num_rows:
            graph, ids, v = _read(indexes.to_pylist()[0])
            names = wanted.column("vec_id").to_numpy()
            q = np.array(wanted.column("v").to_pylist(), np.float64)
            unit = q / np.linalg.norm(q, axis=1, keepdims=True)
            lengths = np.linalg.norm(v, axis=1)
            for i in range(0, len(names), 256):
                found = search(graph, unit[i : i + 256].astype(np.float32), ef)[:, : 2 * copies]
                exact = np.einsum("qkd,qd->qk", v[np.maximum(found, 0)], q[i : i + 256])
                exact /= lengths[np.maximum(found, 0)] * np.linalg.norm(q[i : i + 256], axis=1)[:, None]
                for name, nodes, scores in zip(names[i : i + 256], found, exact):
                    some = nodes >= 0
                    order = np.lexsort((ids[nodes[some]], -scores[some]))[:copies]
                    out[0].append(np.full(len(order), name))
                    out[1].append(ids[nodes[some][order]])
                    out[2].append(scores[some][order])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "entry": pa.array(flat[1].astype(np.int64)), "score": pa.array(flat[2].astype(np.float64))})

    found = ready.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(
        run, "query_id long, entry long, score double"
    )
    named = found.join(few, "entry").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
