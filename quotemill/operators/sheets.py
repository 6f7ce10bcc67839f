"""Spreadsheets of parts: which column holds part numbers, which quantities, and their lines.

Cells are rows: sheet, row, col (from 0), text. Columns are chosen by what stands in them; headings decide ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.tokens import (
    ACCEPT, is_currency, is_currency_sql, is_part, is_quantity, is_quantity_sql, quantity, quantity_sql, stripped, stripped_sql, token_score,
    token_score_sql,
)
from quotemill.functions.units import column_letter

PART_SHARE, PART_CELLS, QUANTITY_SHARE, CURRENCY_SHARE, HEADER_ROWS = 0.35, 2, 0.5, 0.4, 3
#: Words of headings.
PART_HEADER = (
    r"(?i)\b(mpn|part\s*(number|no\.?|#)?|p/?n|manufacturer\s*part|mfr\s*part|component|device|item\s*(number|no\.?|#)|catalog)\b"
)
QUANTITY_HEADER = r"(?i)\b(qty|quantity|count|pieces|pcs|order\s*qty|eau|required|amount|units?|demand)\b"
PRICE_HEADER = r"(?i)\b(price|cost|unit\s*price|target|usd|eur|gbp|each|extended)\b"


def scored(cells: DataFrame) -> DataFrame:
    filled = cells.where(F.coalesce(F.col("text"), F.lit("")) != "")
    token = stripped(F.col("text"))
    return filled.withColumns({"token": token, "score": token_score(token)})


def profile(cells: DataFrame) -> DataFrame:
    """Filled cells and shares of parts, quantities and prices, by sheet and column."""
    return scored(cells).groupBy("sheet", "col").agg(
        F.count("*").alias("filled"),
        F.count_if(is_part(F.col("score"))).alias("part_cells"),
        F.avg(is_part(F.col("score")).cast("int")).alias("part"),
        F.avg(is_quantity(F.col("text")).cast("int")).alias("quantity"),
        F.avg(is_currency(F.col("text")).cast("int")).alias("currency"),
    )


def laid_out(cells: DataFrame) -> DataFrame:
    """The filled cells of each sheet that has a column of parts, with part_col, first_row and quantity_col of the
    sheet, and the header of the cell's column.

    The part column is chosen twice: from all rows, then from the rows of data alone. A sheet is one group: readers
    bound it at 5,000 rows and 60 columns.
    """
    sheet, column = Window.partitionBy("sheet"), Window.partitionBy("sheet", "col")
    rows = scored(cells).withColumns(
        {"p": is_part(F.col("score")), "q": is_quantity(F.col("text")), "c": is_currency(F.col("text"))}
    ).drop("score")
    data = F.col("row") >= F.col("first_row")
    share = lambda flag: F.count_if(data & F.col(flag)).over(column) / F.col("filled")
    header = F.max_by("text", F.when((F.col("row") < F.col("first_row")) & (F.col("row") >= F.col("first_row") - HEADER_ROWS), F.col("row"))).over(column)
    says = lambda pattern: F.coalesce(F.rlike("header", F.lit(pattern)), F.lit(False))

    def part_column(rows: DataFrame) -> DataFrame:
        """The largest share (to hundredths), then the most part cells; a heading, then the left one settles ties.
        Sheets without a column of enough parts take one with any."""
        rows = rows.withColumns({"part_cells": F.count_if(data & F.col("p")).over(column), "filled": F.nullif(F.count_if(data).over(column), F.lit(0))})
        rows = rows.withColumn("part", F.col("part_cells") / F.col("filled"))
        full = (F.col("part") >= PART_SHARE) & (F.col("part_cells") >= PART_CELLS)
        order = F.struct(full, F.bround("part", 2), F.col("part_cells"), says(PART_HEADER), -F.col("col"))
        return rows.withColumn("found", F.max_by("col", F.when(F.col("part_cells") >= 1, order)).over(sheet))

    def first_row(rows: DataFrame) -> DataFrame:
        first = F.min(F.when((F.col("col") == F.col("part_col")) & F.col("p"), F.col("row"))).over(sheet)
        return rows.withColumn("first_row", F.coalesce(first, F.lit(0)))

    rows = part_column(rows.withColumns({"first_row": F.lit(0), "header": F.lit(None).cast("string")}))
    rows = first_row(rows.withColumn("part_col", F.col("found")).where("part_col IS NOT NULL"))
    rows = part_column(rows.withColumn("header", header))
    rows = rows.withColumns({"quantity": share("q"), "currency": share("c"), "part_col": F.coalesce("found", "part_col")})
    rows = first_row(rows).withColumn("header", header)
    right = F.col("col") > F.col("part_col")
    order = F.struct(says(QUANTITY_HEADER), right, -F.abs(F.col("col") - F.col("part_col")), -F.col("col"))
    may = (F.col("col") != F.col("part_col")) & (F.col("quantity") >= QUANTITY_SHARE) & (F.col("currency") < CURRENCY_SHARE) & ~says(PRICE_HEADER)
    return rows.withColumn("quantity_col", F.max_by("col", F.when(may, order)).over(sheet))


def layout(cells: DataFrame) -> DataFrame:
    """sheet, part_col, first_row, quantity_col (null if none), their letters and headings."""
    own = lambda name: F.max(F.when(F.col("col") == F.col(name), F.col("header")))
    out = laid_out(cells).groupBy("sheet").agg(
        F.max("part_col").alias("part_col"), F.max("first_row").alias("first_row"), own("part_col").alias("part_header"),
        F.max("quantity_col").alias("quantity_col"), own("quantity_col").alias("quantity_header"),
    )
    return out.withColumns({"part_letter": column_letter(F.col("part_col")), "quantity_letter": column_letter(F.col("quantity_col"))})


def items(cells: DataFrame) -> DataFrame:
    """sheet, row (from 1), input_string, quantity, token_score of each line with a part."""
    n = F.max(F.when(F.col("col") == F.col("quantity_col"), quantity(F.col("text")))).over(Window.partitionBy("sheet", "row"))
    rows = laid_out(cells).withColumn("quantity", n).where("col = part_col AND row >= first_row AND p")
    return rows.select("sheet", (F.col("row") + 1).alias("row"), F.col("token").alias("input_string"), "quantity", token_score(F.col("token")).alias("token_score"))


def best_sheet(found: DataFrame) -> DataFrame:
    """The sheet of each file with the most items; the first of several. found: file, sheet, its position, items."""
    return found.groupBy("file").agg(F.max_by("sheet", F.struct("items", -F.col("position"))).alias("sheet"), F.max("items").alias("items"))


def layout_sql(cells: str) -> str:
    """CTEs over cells: profile, layout and sheet_items, as the functions of those names give them."""
    score = token_score_sql("token")

    def profiled(source: str) -> str:
        return f"""SELECT sheet, col, count(*) AS filled, count(*) FILTER (WHERE score >= {ACCEPT} - 1e-9) AS part_cells,
         avg(CAST(score >= {ACCEPT} - 1e-9 AS INT)) AS part, avg(CAST({is_quantity_sql("text")} AS INT)) AS quantity, avg(CAST({is_currency_sql("text")} AS INT)) AS currency
  FROM {source} GROUP BY sheet, col"""

    def part_column(profiles: str, header: str) -> str:
        return f"""SELECT sheet, p.col AS part_col FROM {profiles} p {header} WHERE part_cells >= 1
  QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY part >= {PART_SHARE} AND part_cells >= {PART_CELLS} DESC, round_even(part, 2) DESC, part_cells DESC,
    coalesce(regexp_matches({"header" if header else "NULL"}, '{PART_HEADER}'), false) DESC, p.col) = 1"""

    def first_row(columns: str) -> str:
        return f"""SELECT c.sheet, part_col, coalesce(min(row) FILTER (WHERE score >= {ACCEPT} - 1e-9), 0) AS first_row
  FROM {columns} c LEFT JOIN rated r ON r.sheet = c.sheet AND r.col = c.part_col GROUP BY ALL"""

    def headers(first: str) -> str:
        return f"""SELECT c.sheet, col, arg_max(text, row) AS header FROM {cells} c JOIN {first} f ON f.sheet = c.sheet
  WHERE text <> '' AND row < first_row AND row >= first_row - {HEADER_ROWS} GROUP BY ALL"""

    return f"""
rated AS (SELECT *, {score} AS score FROM (SELECT *, {stripped_sql("text")} AS token FROM {cells} WHERE text <> '')
), profile AS ({profiled("rated")}
), rough_column AS ({part_column("profile", "")}
), rough AS ({first_row("rough_column")}
), rough_heads AS ({headers("rough")}
), refined AS ({profiled("(SELECT r.* FROM rated r JOIN rough f ON f.sheet = r.sheet WHERE row >= first_row)")}
), again AS ({part_column("refined", "LEFT JOIN rough_heads USING (sheet, col)")}
), settled AS (SELECT r.sheet, coalesce(a.part_col, r.part_col) AS part_col FROM rough r LEFT JOIN again a ON a.sheet = r.sheet
), starts AS ({first_row("settled")}
), heads AS ({headers("starts")}
), counts AS (
  SELECT q.sheet, q.col AS quantity_col, header AS quantity_header FROM refined q JOIN starts s ON s.sheet = q.sheet LEFT JOIN heads h ON h.sheet = q.sheet AND h.col = q.col
  WHERE q.col <> part_col AND quantity >= {QUANTITY_SHARE} AND currency < {CURRENCY_SHARE} AND NOT coalesce(regexp_matches(header, '{PRICE_HEADER}'), false)
  QUALIFY row_number() OVER (PARTITION BY q.sheet ORDER BY coalesce(regexp_matches(header, '{QUANTITY_HEADER}'), false) DESC, q.col > part_col DESC, abs(q.col - part_col), q.col) = 1
), layout AS (
  SELECT s.sheet, part_col, first_row, h.header AS part_header, quantity_col, quantity_header, chr(65 + part_col) AS part_letter, chr(65 + quantity_col) AS quantity_letter
  FROM starts s LEFT JOIN heads h ON h.sheet = s.sheet AND h.col = s.part_col LEFT JOIN counts c ON c.sheet = s.sheet
), sheet_items AS (
  SELECT r.sheet, r.row + 1 AS row, token AS input_string, {quantity_sql("q.text")} AS quantity, score AS token_score
  FROM layout l JOIN rated r ON r.sheet = l.sheet AND r.col = l.part_col AND r.row >= l.first_row
  LEFT JOIN {cells} q ON q.sheet = l.sheet AND q.col = l.quantity_col AND q.row = r.row WHERE score >= {ACCEPT} - 1e-9
)"""
