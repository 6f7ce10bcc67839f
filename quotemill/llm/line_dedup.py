"""Operator 1: lines that stand on many sites are boilerplate; all copies but the first go.

A line is what stands between line feeds, without blanks at its ends; an empty one is none. Its key is 128
bits of hash. Per key a HyperLogLog sketch of the sites is built in the tasks and merged by aggregation. Where
the estimate is near the threshold, within the sketch's error and more, distinct sites are counted exactly.
The first copy (least doc_id, then place) stays, so no content is lost altogether. Only keys and places are
shuffled until the end; texts move once, to be joined with the places that go.

Null text: no lines, stays null. Null site: no site of its own, so it adds nothing to a line's spread; its
lines are removed like others. Null doc_id: its copies count and go like others, and are never the first.
Rows with equal doc_id and text are treated alike. Ties for the first copy: the place, then a hash of the text. A very
long text is one row, its lines rows of hashes. Empty input: no rows. Other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SITES = 10
LG_K = 12
#: Estimates from SITES less to SITES more than this share are settled by exact counts. Six standard errors
#: of a sketch of 2**12 registers (1.04 / 64).
NEAR = 0.1
#: Boilerplate lines (16 bytes and the place of the first copy each) that may be broadcast, and shares of one beyond it.
BROADCAST_ROWS, SALTS = 500_000, 16


def _parts(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_rows(docs: DataFrame, site: str) -> DataFrame:
    lines = docs.select(
        F.col("doc_id"), F.col(site).cast("string").alias("site"), F.xxhash64("text").alias("version"),
        F.posexplode(_parts(F.col("text"))).alias("place", "line"),
    )
    line = F.btrim("line", F.lit(" \t\r"))
    return lines.select("doc_id", "site", "version", "place", F.unhex(F.md5(line)).alias("key")).where(F.length(line) > 0)


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """key, and doc_id and place of the first copy, of lines that stand on `sites` sites or more."""
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "place", "version"))).alias("first")
    spread = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"), first, F.count("*").alias("copies")
    )
    margin = max(1, round(sites * NEAR))
    spread = written(spread.where(F.col("copies") >= sites).where(F.col("estimate") >= sites - margin), "spread")
    clear = spread.where(F.col("estimate") > sites + margin)
    near = spread.where(F.col("estimate") <= sites + margin)
    exact = (
        lines.join(near.select("key"), "key", "left_semi")
        .select("key", "site").distinct()
        .groupBy("key").agg(F.count("site").alias("exact")).where(F.col("exact") >= sites)
    )
    return clear.select("key", "first").unionByName(near.join(exact, "key").select("key", "first"))


def removed_places(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """doc_id, version (hash of the text), places: the lines of each document that go, by place from 0."""
    lines = _line_rows(docs, site)
    found = written(boilerplate(lines, sites), "boilerplate")
    if found.count() <= BROADCAST_ROWS:
        there = lines.join(F.broadcast(found), "key")
    else:  # a line of very many documents is SALTS keys
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
        there = salted.join(found.select("*", every), ["key", "salt"])
    gone = there.where(
        "first IS NULL OR NOT (doc_id <=> first.doc_id AND place = first.place AND version = first.version)"
    )
    return gone.groupBy("doc_id", "version").agg(F.collect_set("place").alias("places"))


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """docs with all columns, text without the lines that go, and __removed and __lines, their numbers."""
    places = removed_places(docs.select("doc_id", "text", site), site, sites).select(
        F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.col("places").alias("__places")
    )
    same = (docs["doc_id"].eqNullSafe(places["__doc"])) & (F.xxhash64(docs["text"]) == places["__version"])
    joined = docs.join(places, same, "left")
    parts = _parts(F.col("text"))
    keep = F.filter(parts, lambda _, i: ~F.array_contains("__places", i))
    text = F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    counted = F.size(F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(" \t\r"))) > 0))
    return joined.select(
        *[(text.alias("text") if c == "text" else F.col(c)) for c in docs.columns],
        F.coalesce(F.size("__places"), F.lit(0)).cast("long").alias("__removed"),
        F.when(F.col("text").isNull(), 0).otherwise(counted).cast("long").alias("__lines"),
    )


def report(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, text_md5 of the text that is left, of every row."""
    cleaned = without_boilerplate(docs.select("doc_id", "text", site), site, sites)
    return cleaned.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
        F.md5("text").alias("text_md5"),
    )


def cleaned(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """docs without boilerplate lines. Documents of nothing else go; n_chars, if there, follows the text."""
    out = without_boilerplate(docs, site, sites)
    out = out.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, text, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS line
  FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents)
), marked AS (
  SELECT doc_id, source, text, place, trim(line, ' ' || chr(9) || chr(13)) AS line, line AS whole FROM lines
), spread AS (
  SELECT line, min(row(doc_id, place)) FILTER (WHERE doc_id IS NOT NULL) AS first
  FROM marked WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), told AS (
  SELECT m.*, s.line IS NOT NULL AND row(m.doc_id, m.place) IS DISTINCT FROM s.first AS gone
  FROM marked m LEFT JOIN spread s ON m.line = s.line
), each AS (
  SELECT doc_id, text, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(whole, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS rest
  FROM told GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(e.n_lines, 0) AS n_lines, coalesce(e.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(e.rest) END AS text_md5
FROM documents d LEFT JOIN each e ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.text = e.text
"""
