"""Matching requests with a catalog: five tiers, each for what the ones before left.

The fuzzy tier and near misses hold each distinct query against every key, in blocks of both: how many signs are common
at all, a word a key, rules out nearly all pairs at a nanosecond or two each, how many are common in order most others,
and what is left is scored (similarity.Keys). Pairs of signs tell little where numbers are dense: an index of them met more
rows than there are pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import similarity
from quotemill.functions.part_numbers import base_of, key_of, normalized
from quotemill.functions.risk import is_dead
from quotemill.sources.session import checkpointed, large, ship, spread

CANDIDATES, NEAR_MISSES, PREFIX_LEAST = 10, 3, 6
FUZZY_LEAST, FUZZY_LOW, FUZZY_HIGH = 82.0, 0.5, 0.8
#: Catalog keys, and distinct queries, that a task of the fuzzy tier holds at about.
BLOCK, QUERY_BLOCK = 65536, 4096


def keyed(catalog: DataFrame) -> DataFrame:
    """catalog with part_key and part_base."""
    key = key_of(F.upper("mpn"))
    return catalog.withColumn("part_key", key).withColumn("part_base", base_of(F.col("part_key")))


def _part(catalog: DataFrame) -> DataFrame:
    return catalog.select("mpn", "part_key", "part_base", "lifecycle_status", "authorized_stock")


def ranked(hits: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The hits of an input in order: the literal number, then live, then stocked parts, then by number."""
    literal = F.upper("mpn") != F.upper(F.btrim("input_string"))
    order = [F.desc("confidence"), literal, is_dead(F.col("lifecycle_status")), F.coalesce(F.col("authorized_stock"), F.lit(-1)) == 0, "mpn"]
    rank = F.row_number().over(Window.partitionBy("input_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("input_id", "rank", "mpn", "confidence", "method")


def _hits(found: DataFrame, confidence: float, method: str) -> DataFrame:
    return found.select(
        "input_id", "input_string", "mpn", "lifecycle_status", "authorized_stock",
        F.lit(confidence).alias("confidence"), F.lit(method).alias("method"),
    )


def exact(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """inputs: input_id, input_string, key and what normalized() adds."""
    return _hits(inputs.where("key <> ''").join(large(_part(catalog)), F.col("key") == F.col("part_key")), 1.0, "exact")


def variant(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first other reading, in order, that the catalog has."""
    each = inputs.select("input_id", "input_string", F.posexplode("variants").alias("at", "reading"))
    found = each.join(large(_part(catalog)), F.col("reading") == F.col("part_key"))
    first = F.min("at").over(Window.partitionBy("input_id"))
    return _hits(found.withColumn("first", first).where("at = first"), 0.95, "confusable_variant")


def prefix(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Parts whose key begins with the input's, the first ten by key.

    Keys and inputs are sorted together, over all tasks, which gives each part its place and each input the number of
    parts before it; the parts that begin with the input follow it at once, so it meets the ten places after it and no
    others, however many parts begin so.
    """
    asked = inputs.where(F.length("key") >= PREFIX_LEAST).select("key").distinct()
    names = [f.name for f in _part(catalog).schema]
    none = [F.lit(None).cast(catalog.schema[n].dataType).alias(n) for n in names if n != "part_key"]
    both = _part(catalog).where("part_key IS NOT NULL").select(F.col("part_key").alias("text"), F.lit(1).alias("is_part"), *[n for n in names if n != "part_key"])
    both = both.unionByName(asked.select(F.col("key").alias("text"), F.lit(0).alias("is_part"), *none))
    order = ["text", "is_part", "mpn"]  # an input stands before the part of its own key
    ranges = checkpointed(both.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("range").agg(F.sum("is_part").alias("n"))  # a row a task
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).select("range", "before")
    here = F.sum("is_part").over(Window.partitionBy("range").orderBy(*order))
    placed = ranges.withColumn("here", here).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("here"))
    after = placed.where("is_part = 0").select(F.col("text").alias("key"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + CANDIDATES)).alias("place"))
    parts = placed.where("is_part = 1").select("place", F.col("text").alias("part_key"), *[n for n in names if n != "part_key"])
    found = after.join(large(parts), "place").where(F.startswith("part_key", "key")).drop("place")
    return _hits(inputs.where(F.length("key") >= PREFIX_LEAST).join(large(found), "key"), 0.85, "prefix")


def base_part(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Parts of the input's key and a grade; if there are none, the part of the input's key without its grade."""
    parts = large(_part(catalog))
    with_grade = inputs.where("key <> ''").join(parts.where("part_base <> part_key"), F.col("key") == F.col("part_base"))
    without = inputs.where("base_key <> key").join(parts, F.col("base_key") == F.col("part_key"))
    without = without.join(large(with_grade.select("input_id").distinct()), "input_id", "left_anti")
    return _hits(with_grade, 0.85, "base_part").unionByName(_hits(without, 0.85, "base_part"))


def fuzzy_confidence(score: Column) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - FUZZY_LEAST) / (100.0 - FUZZY_LEAST)))
    return FUZZY_LOW + share * (FUZZY_HIGH - FUZZY_LOW)


def common_grams(s: int, least: float = FUZZY_LEAST) -> int:
    """Grams that a key of s signs has at least in common with one as long or longer, if their score is `least` or more:
    over stretches of w signs and, beyond s, whole keys."""
    need = [(math.ceil(least * (s + w) / 200 - 1e-9), w) for w in range(1, 2 * s + 1)]
    return min((3 * common - s - w - 1 for common, w in need if common <= min(s, w)), default=s)


def alike(wanted: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """query, score, part_key of all pairs that score FUZZY_LEAST or more; with `most` at least each query's best so many.
    wanted: query; keys: part_key; both distinct."""

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        names = similarity.Keys(sorted(there["part_key"]))
        out = list(names.above(sorted(asked["query"]), FUZZY_LEAST, most)) if names.keys else []
        return pd.DataFrame(out, columns=["query", "score", "part_key"])

    return _each_block(*_blocks(wanted, keys), run)


def fuzzy_found(inputs: DataFrame, catalog: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """input_id, key_rank, score, part_key: of each input's most alike keys those that score FUZZY_LEAST or more."""
    wanted = inputs.where("key <> ''").select(F.col("key").alias("query")).distinct()
    found = alike(wanted, catalog.where("part_key <> ''").select("part_key").distinct(), most)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "part_key"))
    best = found.withColumn("key_rank", rank).where(F.col("key_rank") <= most)
    return inputs.select("input_id", F.col("key").alias("query")).join(large(best), "query").select("input_id", "key_rank", "score", "part_key")


def _blocks(wanted: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted (query) and keys (part_key), each with r and k: a block of queries meets a block of keys.

    Both sides are counted first, so that a block holds about BLOCK or QUERY_BLOCK of them, at any size, and queries are
    dealt further while there are few blocks for all tasks.
    """
    ship(wanted.sparkSession)
    tasks = 4 * int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many_keys = max(1, -(-keys.count() // BLOCK))
    asked = wanted.count()
    many = max(1, -(-asked // QUERY_BLOCK), min(asked, -(-tasks // many_keys)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    wanted = wanted.withColumn("r", F.pmod(F.xxhash64("query"), F.lit(many))).withColumn("k", every(many_keys))
    keys = keys.withColumn("k", F.pmod(F.xxhash64("part_key"), F.lit(many_keys))).withColumn("r", every(many))
    # a task each: blocks are few bytes but much work, so they mustn't be put together by their bytes
    return wanted.repartition(many * many_keys, "r", "k"), keys.repartition(many * many_keys, "r", "k")


def _each_block(wanted: DataFrame, keys: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return wanted.groupBy("r", "k").cogroup(keys.groupBy("r", "k")).applyInPandas(run, "query string, score double, part_key string")


def fuzzy_blocks(inputs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct queries and catalog keys in blocks, see _blocks."""
    return _blocks(inputs.where("key <> ''").select(F.col("key").alias("query")).distinct(), catalog.select("part_key").distinct())


def fuzzy_scores(inputs: DataFrame, catalog: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """input_id, key_rank, score, part_key: each input's most alike keys.

    Distinct queries and catalog keys are dealt to blocks, and each query meets every block of keys once; their best
    are merged, and go to all inputs of that query. Inputs that get here are those that no equality found.
    """

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        names = similarity.Keys(sorted(there["part_key"]))
        out = list(names.best_of_each(sorted(asked["query"]), most)) if names.keys else []
        return pd.DataFrame(out, columns=["query", "score", "part_key"])

    found = _each_block(*fuzzy_blocks(inputs, catalog), run)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "part_key"))
    best = found.withColumn("key_rank", rank).where(F.col("key_rank") <= most)
    return inputs.select("input_id", F.col("key").alias("query")).join(large(best), "query").select("input_id", "key_rank", "score", "part_key")


def fuzzy(scored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates from 82 on: by confidence, live parts first, then by number."""
    found = scored.where(F.col("score") >= FUZZY_LEAST).join(large(_part(catalog)), "part_key")
    found = found.withColumn("confidence", fuzzy_confidence(F.col("score")))
    order = [F.desc("confidence"), is_dead(F.col("lifecycle_status")), "mpn"]
    rank = F.row_number().over(Window.partitionBy("input_id").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= CANDIDATES)
    return found.select("input_id", "rank", "mpn", "confidence", F.lit("fuzzy").alias("method"))


def near_misses(scored: DataFrame, catalog: DataFrame) -> DataFrame:
    """For inputs with no candidate: one part of each of the three most alike keys."""
    top = F.max("score").over(Window.partitionBy("input_id"))
    left = scored.withColumn("top", top).where((F.col("top") < FUZZY_LEAST) & (F.col("key_rank") <= NEAR_MISSES))
    first = catalog.groupBy("part_key").agg(F.min("mpn").alias("mpn"))
    return left.join(large(first), "part_key").select(
        "input_id", F.col("key_rank").alias("rank"), "mpn", (F.col("score") / 100).alias("confidence"), F.lit("near_miss").alias("method")
    )


def read(requests: DataFrame) -> DataFrame:
    """requests with what normalized() adds, once: the rules are dear, all tiers need them and filter by them."""
    return checkpointed(normalized(spread(requests)))


def cascade(requests: DataFrame, catalog: DataFrame, with_fuzzy: bool = True, inputs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates (input_id, rank, mpn, confidence, method) and near misses of all requests. inputs: read(requests), if
    it is there already.

    A tier counts for the inputs that no earlier one has found.
    """
    catalog = checkpointed(_part(keyed(spread(catalog))))
    inputs = read(requests) if inputs is None else inputs
    hits = [tier(inputs, catalog).withColumn("tier", F.lit(i)) for i, tier in enumerate((exact, variant, prefix, base_part))]
    every = reduce(DataFrame.unionByName, hits)
    first = F.min("tier").over(Window.partitionBy("input_id"))
    out = ranked(every.withColumn("first", first).where("tier = first"))
    if not with_fuzzy:
        return out, out.limit(0)
    out = checkpointed(out)
    left = inputs.join(large(out.select("input_id").distinct()), "input_id", "left_anti")
    found = checkpointed(fuzzy_found(left, catalog))
    rest = left.join(large(found.select("input_id").distinct()), "input_id", "left_anti")
    return out.unionByName(fuzzy(found, catalog)), near_misses(fuzzy_scores(rest, catalog, NEAR_MISSES), catalog)


def accuracy(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Top-1, top-3 and false positives by kind of request. requests: input_id, kind, expected_mpn."""
    hit = candidates.join(large(requests.select("input_id", "expected_mpn")), "input_id")
    best = hit.groupBy("input_id").agg(
        F.min(F.when(F.col("mpn") == F.col("expected_mpn"), F.col("rank"))).alias("hit_rank"), F.count("*").alias("found")
    )
    each = requests.join(large(best), "input_id", "left")
    known = F.col("expected_mpn").isNotNull()
    return each.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.avg(F.when(known, (F.coalesce(F.col("hit_rank"), F.lit(99)) <= 1).cast("int"))).alias("top1"),
        F.avg(F.when(known, (F.coalesce(F.col("hit_rank"), F.lit(99)) <= 3).cast("int"))).alias("top3"),
        F.avg(F.when(~known, (F.coalesce(F.col("found"), F.lit(0)) > 0).cast("int"))).alias("false_positive"),
    )
