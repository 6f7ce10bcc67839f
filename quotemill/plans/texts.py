"""Queries over request texts and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import tokens
from quotemill.operators import sheets
from quotemill.operators import text_requests as texts
from quotemill.sources import feeds
from quotemill.sources.feeds import REQUEST_TEXTS, SHEET_CELLS
from quotemill.sources.tables import CATALOG


def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of every request text, with its score as a part number."""
    each = feeds.request_texts(spark, sf).select("doc_id", F.posexplode(F.split("raw_text", r"\s+")).alias("at", "word"))
    each = each.withColumn("token", tokens.stripped(F.col("word")))
    return each.select("doc_id", "at", "token", F.round(tokens.token_score(F.col("token")), 9).alias("score"))


def parse_rfq_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every request text: what it is, and the part, quantity and score of items."""
    found = texts.parsed(feeds.request_texts(spark, sf)).drop("bare")
    return found.withColumn("token_score", F.round("token_score", 9))


def parse_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return texts.diagnostics(feeds.request_texts(spark, sf))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sheet_cells(spark, sf)


def sheet_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in each column of each sheet."""
    found = sheets.profile(_cells(spark, sf))
    return found.withColumns({c: F.round(c, 9) for c in ("part", "quantity", "currency")})


def sheet_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of parts and of quantities of each sheet, and where its data begin."""
    return sheets.layout(_cells(spark, sf))


def sheet_items(spark: SparkSession, sf: str) -> DataFrame:
    return sheets.items(_cells(spark, sf)).withColumn("token_score", F.round("token_score", 9))


def best_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet of each file that has the most items."""
    cells = _cells(spark, sf)
    position = F.regexp_extract("sheet", r"(\d+)$", 1).cast("int")
    counts = sheets.items(cells).groupBy("sheet").agg(F.count("*").alias("items"))
    each = cells.select("file", "sheet").distinct().join(counts, "sheet", "left")
    return sheets.best_sheet(each.select("file", "sheet", position.alias("position"), F.coalesce("items", F.lit(0)).alias("items")))


QUERIES = {f.__name__: f for f in (token_scores, parse_rfq_text, parse_diagnostics, sheet_profile, sheet_columns, sheet_items, best_sheets)}

_TEXTS = f"WITH {CATALOG}, {REQUEST_TEXTS}"
_SHEETS = f"WITH {CATALOG}, {SHEET_CELLS}, {sheets.layout_sql('sheet_cells')}"
SQL = {
    "token_scores": f"""{_TEXTS}, w AS (
  SELECT doc_id, unnest(string_split_regex(raw_text, '\\s+')) AS word, generate_subscripts(string_split_regex(raw_text, '\\s+'), 1) - 1 AS "at" FROM request_texts
), t AS (SELECT doc_id, "at", {tokens.stripped_sql("word")} AS token FROM w)
SELECT doc_id, CAST("at" AS INT) AS "at", token, round({tokens.token_score_sql("token")}, 9) AS score FROM t""",
    "parse_rfq_text": f"""{_TEXTS}, {texts.parsed_sql('request_texts')}
SELECT doc_id, CAST(line_no AS INT) AS line_no, kind, input_string, quantity, round(token_score, 9) AS token_score FROM parsed""",
    "parse_diagnostics": f"""{_TEXTS}, {texts.classified_sql('request_texts')}, r AS (SELECT doc_id, count(*) AS lines_read FROM split_lines GROUP BY doc_id)
SELECT doc_id, lines_read, count(*) FILTER (WHERE kind = 'quoted') AS quoted_lines, bool_or(kind = 'signature') AS signature_stripped
FROM r JOIN kinds USING (doc_id) GROUP BY doc_id, lines_read""",
    "sheet_profile": f"""{_SHEETS} SELECT sheet, col, filled, part_cells, round(part, 9) AS part, round(quantity, 9) AS quantity, round(currency, 9) AS currency FROM profile""",
    "sheet_columns": f"{_SHEETS} SELECT * FROM layout",
    "sheet_items": f"{_SHEETS} SELECT sheet, row, input_string, quantity, round(token_score, 9) AS token_score FROM sheet_items",
    "best_sheets": f"""{_SHEETS}, n AS (SELECT sheet, count(*) AS items FROM sheet_items GROUP BY sheet), e AS (
  SELECT DISTINCT file, c.sheet, CAST(regexp_extract(c.sheet, '(\\d+)$', 1) AS INT) AS position, coalesce(items, 0) AS items FROM sheet_cells c LEFT JOIN n ON n.sheet = c.sheet)
SELECT file, sheet, items FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY items DESC, position) = 1""",
}
