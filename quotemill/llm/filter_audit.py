"""Operator 12: which filters remove what, in any order, by inclusion and exclusion.

1. A document's five filters become flags. The fifth asks for a smaller doc_id with the same text: documents are
   counted by a digest of the text, flags and part, so only a row for each different text and part is held against
   the least doc_id of its text, however many copies there are.
2. For each of the 32 sets of filters, the documents of a part that fail all of them are counted at once, as sums of
   products of flags: in all, of good quality, and toxic.
3. All else follows from these 32 numbers. Survivors of a set of filters are the alternating sum over its subsets (a
   Möbius inversion); what a step removes is the difference of two survivors; documents failing one filter only are
   the alternating sum over the sets that hold it. The number of documents that a set of filters removes is a game
   whose Harsanyi dividends are the joint counts with alternating signs: a filter's share over all 120 orders is the
   sum of 120 / size over the sets that hold it.

Null text: an empty one. Null source: the part with an empty name, as an empty source is. Null doc_id: has no smaller
one and is none; without labels. Rows of one doc_id: each counts, none is a copy of the other. Several labels of one
doc_id: good or toxic if any says so. Very long texts are taken whole. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters in the order of their bits; the last is that of copies.
FILTERS = "ABCDE"
_SETS = 1 << len(FILTERS)
_COPIES = _SETS >> 1


def failures(text: Column) -> dict[str, Column]:
    """What fails of a text by itself: too short, too repetitive, too many capitals, signs of markup."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags A to D (1: fails), good, toxic, and n documents, of which `copies` have a smaller doc_id's text."""
    text = F.coalesce("text", F.lit(""))
    marks = {k: v.cast("long").alias(k) for k, v in failures(text).items()}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), *marks.values(),
    )
    same = ["part", "digest", *marks]
    rows = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality"), yes("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    # rows without doc_id may be many and have no label: they stay out of the join
    every = named.unionByName(rows.where("doc_id IS NULL").withColumns({c: F.lit(None).cast("long") for c in ("quality", "toxic")}))
    every = every.withColumns({"good": F.coalesce("quality", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    # a doc_id's rows of one text together, then the least doc_id of each text, part and label with its number of rows
    by = [*same, "good", "toxic"]
    each = every.groupBy(*by, "doc_id").agg(F.sum("n").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    held = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("named"), first.alias("first"))
    least = held.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    return held.join(least, "digest").select("part", *marks, "good", "toxic", "n", F.coalesce(F.col("named") - own, F.lit(0)).alias("copies"))


def joint(rows: DataFrame) -> DataFrame:
    """part and arrays all, good, toxic: at each set of filters (bits) the documents that fail all of them."""

    def count(weight: Column, s: int) -> Column:
        product = F.col("copies") if s & _COPIES else F.col("n")
        for k, name in enumerate(FILTERS[:-1]):
            if s >> k & 1:
                product = product * F.col(name)
        return F.sum(product * weight)

    of = {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = rows.groupBy("part").agg(*[count(w, s).alias(f"{k}{s}") for k, w in of.items() for s in range(_SETS)])
    return sums.select("part", *[F.array(*[f"{k}{s}" for s in range(_SETS)]).alias(k) for k in of])


def _survivors(counts: str) -> Column:
    """At each set of filters the documents that fail none of them."""
    term = f"aggregate(sequence(0, {_SETS - 1}), 0L, (sum, s) -> sum + if(s & p = s, if(bit_count(s) % 2 = 0, 1, -1) * {counts}[s], 0L))"
    return F.expr(f"transform(sequence(0, {_SETS - 1}), p -> {term})")


def _over(counts: str, weight: str) -> str:
    """The sum over the sets s that hold the step's filter."""
    return f"aggregate(sequence(0, {_SETS - 1}), 0L, (sum, s) -> sum + if(s & bit > 0, {weight} * {counts}[s], 0L))"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    orders = len(list(permutations(FILTERS)))
    found = joint(flagged(docs, labels)).withColumns({f"left_{k}": _survivors(f"`{k}`") for k in ("all", "good", "toxic")})
    steps = found.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("bit", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)"))
    steps = steps.withColumn("before", F.expr("aggregate(sequence(1, step), -bit, (sum, k) -> sum + shiftleft(1, ascii(substr(filter_order, k, 1)) - 65))"))
    lost = lambda k: F.expr(f"left_{k}[before] - left_{k}[before + bit]")
    return steps.select(
        "part", "filter_order", "step", F.expr("left_all[before + bit]").alias("kept"), lost("all").alias("removed"),
        (F.expr("`all`[bit]") - lost("all")).alias("redundant"), F.expr(_over("`all`", "if(bit_count(s) % 2 = 1, 1, -1)")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.expr(_over("`all`", f"if(bit_count(s) % 2 = 1, 1, -1) * ({orders} div bit_count(s))")).alias("shapley"),
    )


#: Plainly: each order applied to each pattern of failed filters.
ORACLE = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), least AS (SELECT text, min(doc_id) AS least FROM rows GROUP BY text),
known AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS failed
  FROM rows JOIN least USING (text) LEFT JOIN known USING (doc_id)
), patterns AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY part, failed
), orders(filter_order) AS (
  SELECT '' UNION ALL
  SELECT filter_order || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS filters(f) WHERE NOT contains(filter_order, f)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), applied AS (
  SELECT part, filter_order, step, f, n, good, toxic, failed, contains(failed, f) AS fails,
    length(translate(failed, earlier, '')) < length(failed) AS gone
  FROM patterns, steps
), counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM applied GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
