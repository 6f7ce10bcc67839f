"""Operator 4: benchmark passages in training texts, by spaced seeds. Built-in functions only.

Tokens are runs of letters and digits in lower case. A passage of an item stands in a document if, somewhere,
13 tokens in line agree but for 2 at most. Two fixed masks of six positions each find all such places: whatever
2 of 13 positions differ, one mask, at one shift, sees only tokens that agree (test_decontaminate proves it by
trying all). The hashes of what the masks see are joined with those of the items; that gives alignments, a
document's token beside an item's token. Around each, the tokens are then compared one by one.

Only hashes meet in the join. The items' side is broadcast if its number of rows, counted first, is under a
bound; else Spark shuffles both. Only documents with a hit are read again, to compare tokens.

Items with fewer than 13 tokens match where all their tokens stand in line, without exception: the hash of the whole item is
joined with those of as many tokens in line of the documents, for each such length that an item has. Null items and
those without tokens match nothing. Null or empty text: no match.
Null doc_id: rows are compared like others and come back as null. Rows with one doc_id: a match in any counts;
the same match is told once. A very long text is one row of hashes. Ties: as overlaps() says. decontaminated() drops only the rows that match, whatever their doc_id. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Positions that each mask reads; it ignores the others.
MASKS = [(0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8)]
WINDOW = 13
SUBSTITUTIONS = 2
#: Rows of items' hashes (16 bytes and two numbers each) that may be broadcast.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    words = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(words) > 0, F.split(words, " "))


def _seeds(rows: DataFrame, *names: str) -> DataFrame:
    """names, mask and place, seed: a hash for each mask at each place of the tokens that it fits."""
    hashes = F.transform(F.col("tokens"), lambda w: F.xxhash64(w))
    rows = rows.select(*names, F.size("tokens").alias("size"), hashes.alias("hashes"))

    def of_mask(k: int) -> Column:
        places = F.sequence(F.lit(0), F.col("size") - (MASKS[k][-1] + 1))
        return F.transform(places, lambda i: F.xxhash64(F.lit(k), *[F.get("hashes", i + p) for p in MASKS[k]]))

    both = rows.select(*names, F.explode(F.array(*map(of_mask, range(len(MASKS))))).alias("seeds"))
    return both.select(*names, F.posexplode("seeds").alias("place", "seed"))


def _runs(rows: DataFrame, lengths: list[int], *names: str) -> DataFrame:
    """names, place, seed: a hash for each run of as many tokens as one of `lengths` says."""
    hashes = F.transform(F.col("tokens"), lambda w: F.xxhash64(w))
    rows = rows.select(*names, F.size("tokens").alias("size"), hashes.alias("hashes"))

    def of_length(n: int) -> Column:
        places = F.when(F.col("size") >= n, F.sequence(F.lit(0), F.col("size") - n))
        return F.transform(places, lambda i: F.xxhash64(F.lit(-n), *[F.get("hashes", i + p) for p in range(n)]))

    both = rows.select(*names, F.explode(F.array(*map(of_length, lengths))).alias("seeds"))
    return both.select(*names, F.posexplode("seeds").alias("place", "seed"))


def _row(docs: DataFrame) -> Column:
    """Names rows by what they hold: rows of one name match the same."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, doc_id, item_id, shift, agree, starts of the alignments that hold a passage; doc_id is that of the row."""
    test = items.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= 1)
    test = written(test, "items")
    short = sorted(r.n for r in test.select(F.size("tokens").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # 12 at most
    keys = _seeds(test.where(F.size("tokens") >= WINDOW), "item_id")
    for n in short:
        keys = keys.unionByName(_runs(test.where(F.size("tokens") == n), [n], "item_id"))
    keys = written(keys.select("seed", "item_id", F.col("place").alias("item_place")).distinct(), "seeds")
    bounded = keys.count() <= BROADCAST_ROWS
    train = docs.select(_row(docs).alias("row"), tokens(F.col("text")).alias("tokens"))
    found = _seeds(train.where(F.size("tokens") >= WINDOW), "row")
    if short:
        found = found.unionByName(_runs(train, short, "row"))
    hits = found.join(F.broadcast(keys) if bounded else keys, "seed")
    hits = hits.select("row", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = written(hits, "hits")

    again = docs.select("doc_id", "text", _row(docs).alias("row"))
    named = hits.select("row").distinct()
    again = again.join(named, "row", "left_semi").dropDuplicates(["row"])
    again = again.select("row", "doc_id", tokens(F.col("text")).alias("doc_tokens"))
    both = hits.join(test.select("item_id", F.col("tokens").alias("item_tokens")), "item_id").join(again, "row")
    # the item laid on the document: agree[i] tells of the item's token i
    agree = F.transform(
        "item_tokens", lambda w, i: F.coalesce(w == F.get("doc_tokens", i + F.col("shift")), F.lit(False)).cast("int")
    )
    both = both.select("row", "doc_id", "item_id", "shift", agree.alias("agree"))
    window = F.least(F.lit(WINDOW), F.size("agree"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("agree") - window),
        lambda i: F.aggregate(F.slice("agree", i + 1, window), F.lit(0), lambda a, x: a + x) >= F.when(window < WINDOW, window).otherwise(WINDOW - SUBSTITUTIONS),
    )
    return both.withColumn("starts", starts).where(F.size("starts") > 0)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, n_matches: the longest overlap for each document and item.

    An overlap runs from the first token that agrees of the first such window to the last one of the last, in
    one alignment. Of several the one with most agreeing tokens is told, then the first in the document, then
    in the item.
    """
    both = _alignments(docs, items)
    last = F.array_max("starts") + F.least(F.lit(WINDOW), F.size("agree")) - 1
    inside = F.filter(F.sequence(F.array_min("starts"), last), lambda i: F.get("agree", i) == 1)
    both = both.select("doc_id", "item_id", "shift", inside.alias("inside"))
    each = both.select(
        "doc_id", "item_id",
        (F.array_min("inside") + F.col("shift")).alias("doc_start"), F.array_min("inside").alias("item_start"),
        (F.array_max("inside") - F.array_min("inside") + 1).alias("n_tokens"), F.size("inside").alias("n_matches"),
    )
    best = F.max_by(
        F.struct("doc_start", "item_start", "n_tokens", "n_matches"),
        F.struct("n_matches", -F.col("doc_start"), -F.col("item_start")),
    )
    told = each.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return told.select("doc_id", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("doc_start", "item_start", "n_tokens", "n_matches")])


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no passage of an item stands."""
    gone = _alignments(docs, items).select(F.col("row").alias("__gone")).distinct()
    return docs.join(gone, _row(docs) == gone["__gone"], "left_anti")


#: The same rule without masks; short items are looked for as texts. Of 13 tokens in line of which 11 agree, four in a row agree, so alignments come
#: from runs of four tokens; they are then compared in the same way.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents
), t AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) >= {WINDOW}
), tw AS (
  SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t WHERE len(w) >= {WINDOW}
), dg AS (
  SELECT doc_id, p, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x AS g
  FROM dw WINDOW x AS (PARTITION BY doc_id ORDER BY p)
), tg AS (
  SELECT item_id, p, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x AS g
  FROM tw WINDOW x AS (PARTITION BY item_id ORDER BY p)
), h AS (
  SELECT DISTINCT doc_id, item_id, dg.p - tg.p AS shift FROM dg JOIN tg USING (g)
), c AS (
  SELECT h.doc_id, h.item_id, h.shift, tw.p, CAST(coalesce(tw.word = dw.word, false) AS INT) AS ok
  FROM h JOIN tw ON tw.item_id = h.item_id LEFT JOIN dw ON dw.doc_id = h.doc_id AND dw.p = tw.p + h.shift
), s AS (
  SELECT *, sum(ok) OVER x AS n, count(*) OVER x AS k FROM c
  WINDOW x AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), r AS (
  SELECT doc_id, item_id, shift, min(p) AS lo, max(p) + {WINDOW - 1} AS hi FROM s
  WHERE k = {WINDOW} AND n >= {WINDOW - SUBSTITUTIONS} GROUP BY ALL
), e AS (
  SELECT r.doc_id, r.item_id, r.shift, min(c.p) AS lo, max(c.p) AS hi, count(*) AS n_matches
  FROM r JOIN c ON c.doc_id = r.doc_id AND c.item_id = r.item_id AND c.shift = r.shift
  WHERE c.ok = 1 AND c.p BETWEEN r.lo AND r.hi GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matches DESC, lo + shift, lo) AS k FROM e
)
SELECT doc_id, item_id, min(length(before) - length(replace(before, ' ', ''))) AS doc_start, 0::BIGINT AS item_start, min(n)::BIGINT AS n_tokens, min(n)::BIGINT AS n_matches
FROM (
  SELECT doc_id, item_id, len(t.w) AS n, left(' ' || array_to_string(d.w, ' ') || ' ', strpos(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(t.w, ' ') || ' ') - 1) AS before
  FROM t JOIN d ON len(t.w) < {WINDOW} AND t.w <> [''] AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(t.w, ' ') || ' ')
) GROUP BY doc_id, item_id
UNION ALL
SELECT doc_id, item_id, CAST(lo + shift - 1 AS BIGINT) AS doc_start, CAST(lo - 1 AS BIGINT) AS item_start,
       CAST(hi - lo + 1 AS BIGINT) AS n_tokens, CAST(n_matches AS BIGINT) AS n_matches
FROM b WHERE k = 1
"""
