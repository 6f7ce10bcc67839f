"""Files of requests, evaluation cases and predictions: text, mail, workbooks, JSON, CSV."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources.session import ship

MOST_ROWS, MOST_COLUMNS = 5000, 60
CELLS = "file string, sheet string, position int, row int, col int, text string"
CASES = "cases array<struct<id:int,input:string,expected_mpn:string,kind:string,note:string>>"
PREDICTIONS = "mpn string, week_index int, model string, actual double, predicted double, lifecycle string, category string, during_spike int"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """file, content and kind of each file: `spreadsheet` by its ending or its first bytes, else `text`."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    sheet = F.rlike("file", F.lit(r"(?i)\.xls[xm]$")) | (F.substring("content", 1, 2) == F.lit(b"PK"))
    return rows.withColumn("kind", F.when(sheet, "spreadsheet").otherwise("text"))


def texts(files: DataFrame) -> DataFrame:
    """doc_id (the file), raw_text of the text files: UTF-8, and Latin-1 where it is none."""
    own = files.where("kind = 'text'")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return own.select(F.col("file").alias("doc_id"), text.alias("raw_text"))


def _text(value: float | str) -> str:
    """A cell's number as it is written: whole ones without a point."""
    number = float(value)
    return str(int(number)) if number.is_integer() else repr(number)


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for ch in letters:
        column = 26 * column + ord(ch) - 64
    return int(digits) - 1, column - 1


def workbook(content: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """sheet, its position, row, col and text of the filled cells; merged cells hold what their first one does."""
    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        shared = []
        if "xl/sharedStrings.xml" in pack.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(pack.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(pack.read("xl/_rels/workbook.xml.rels"))}
        for position, sheet in enumerate(ElementTree.fromstring(pack.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = targets[sheet.get(f"{_REL}id")]
            root = ElementTree.fromstring(pack.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells: dict[tuple[int, int], str] = {}
            for cell in root.iter(f"{_MAIN}c"):
                kind, value, inline = cell.get("t"), cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                if kind == "inlineStr" and inline is not None:
                    text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = shared[int(value.text)]
                else:
                    text = value.text if kind in ("str", "b", "e", "d") else _text(value.text)
                at = _place(cell.get("r"))
                if at[0] < MOST_ROWS and at[1] < MOST_COLUMNS and text.strip():
                    cells[at] = text.strip()
            for merged in root.iter(f"{_MAIN}mergeCell"):
                (top, left), (bottom, right) = (_place(x) for x in merged.get("ref").split(":"))
                if (top, left) in cells:
                    for r in range(top, min(bottom, MOST_ROWS - 1) + 1):
                        for c in range(left, min(right, MOST_COLUMNS - 1) + 1):
                            cells.setdefault((r, c), cells[top, left])
            for (row, col), text in sorted(cells.items()):
                yield sheet.get("name"), position, row, col, text


def sheet_cells(files: DataFrame) -> DataFrame:
    """The cells of the workbooks, a file at a time in a task; a file that is no workbook has none."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"]):
                try:
                    rows = [(name, *cell) for cell in workbook(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["file", "sheet", "position", "row", "col", "text"])

    return files.where("kind = 'spreadsheet'").select("file", "content").mapInPandas(run, CELLS)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: a file of JSON with a list of them."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    return rows.select(F.inline("cases"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as `sinks.predictions` writes them."""
    return spark.read.schema(PREDICTIONS).option("header", True).csv(path)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """A distributor's records, pages of JSON with a list of parts each; the first record of a number stays.

    The pages are what a keyword's search returned, in files; nothing is fetched here.
    """
    part = (
        "ManufacturerPartNumber string, Manufacturer string, Category string, Description string, LifecycleStatus string, Availability string, FactoryStock string, "
        "ProductAttributes array<struct<AttributeName:string,AttributeValue:string>>, PriceBreaks array<struct<Quantity:int,Price:string>>"
    )
    names = part.replace(" string", ":string").replace(" array", ":array").replace(", ", ",")
    pages = spark.read.schema(f"Parts array<struct<{names}>>").option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    rows = pages.select("page", F.posexplode("Parts").alias("place", "p")).where("p.ManufacturerPartNumber IS NOT NULL")
    first = rows.groupBy(F.col("p.ManufacturerPartNumber").alias("mpn")).agg(F.min_by("p", F.struct("page", "place")).alias("p"))
    return first.select("p.*")


def counts(spark: SparkSession, names: list[str]) -> dict[str, int | None]:
    """Rows of each table of the catalog; None for those that aren't there."""
    return {name: spark.table(name).count() if spark.catalog.tableExists(name) else None for name in names}
