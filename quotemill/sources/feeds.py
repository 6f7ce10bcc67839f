"""Request texts, sheets and distributors' records over the catalog, as people and feeds write them.

Each has SQL of the same rows beside it, which the queries' SQL builds on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.sources.tables import catalog

LINES, ROWS, SHEETS = 10, 40, 3
_HEAD = "From: buyer@example.com\nSubject: RFQ 24H\nHello,\n\nPart Number   Qty\n"
_FEET = ["Regards,\n--\nBuyer ABC123-X x 3", "On Monday Bo wrote:\n> XYZ9876-A x 4\nThanks!", "Sent from my phone\nQWE4567 x 2"]


def request_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw_text: ten lines a text, each of another kind, between a head and a foot."""
    turn = F.col("part_id") % LINES
    mpn, n = F.col("mpn"), (F.col("part_id") % 997 + 1).cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = (
        F.when(turn == 0, c("- ", mpn, " x ", n)).when(turn == 1, c("2) ", mpn, ", qty: ", n)).when(turn == 2, c(mpn, "\t", n, "\t$1.25"))
        .when(turn == 3, c("need ", n, " of ", mpn, " by Friday")).when(turn == 4, c(n, " pcs ", mpn, " please, target $2.50"))
        .when(turn == 5, c("> old ", mpn, " x 5")).when(turn == 6, F.lit("Please quote what follows ASAP, within 24H."))
        .when(turn == 7, c(mpn, ";", n, ";ROHS")).when(turn == 8, c("Quantity: ", n, ",000 ", F.lower(mpn)))
        .otherwise(c(mpn, " at $", n, ".50 each, need ", n))
    )
    rows = catalog(spark, sf_dir).select(F.floor(F.col("part_id") / LINES).alias("doc_id"), "part_id", line.alias("line"))
    body = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "line"))).alias("lines"))
    foot = F.element_at(F.array(*map(F.lit, _FEET)), (F.col("doc_id") % len(_FEET) + 1).cast("int"))
    return body.select("doc_id", F.concat(F.lit(_HEAD), F.array_join("lines.line", "\n"), F.lit("\n"), foot).alias("raw_text"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


REQUEST_TEXTS = f"""
request_lines AS (
  SELECT part_id // {LINES} AS doc_id, part_id, CASE part_id % {LINES}
    WHEN 0 THEN '- ' || mpn || ' x ' || n WHEN 1 THEN '2) ' || mpn || ', qty: ' || n WHEN 2 THEN mpn || chr(9) || n || chr(9) || '$1.25'
    WHEN 3 THEN 'need ' || n || ' of ' || mpn || ' by Friday' WHEN 4 THEN n || ' pcs ' || mpn || ' please, target $2.50'
    WHEN 5 THEN '> old ' || mpn || ' x 5' WHEN 6 THEN 'Please quote what follows ASAP, within 24H.'
    WHEN 7 THEN mpn || ';' || n || ';ROHS' WHEN 8 THEN 'Quantity: ' || n || ',000 ' || lower(mpn)
    ELSE mpn || ' at $' || n || '.50 each, need ' || n END AS line
  FROM (SELECT *, CAST(part_id % 997 + 1 AS VARCHAR) AS n FROM catalog)
), request_texts AS (
  SELECT doc_id, {_text(_HEAD)} || string_agg(line, chr(10) ORDER BY part_id) || chr(10)
         || CASE doc_id % {len(_FEET)} WHEN 0 THEN {_text(_FEET[0])} WHEN 1 THEN {_text(_FEET[1])} ELSE {_text(_FEET[2])} END AS raw_text
  FROM request_lines GROUP BY doc_id
)"""


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, sheet, row, col, text: a table of parts below a title and headings, in an order that differs by sheet.

    The last sheet of a file is one of notes, without parts.
    """
    place, sheet = F.col("part_id") % ROWS, F.floor(F.col("part_id") / ROWS)
    rows = catalog(spark, sf_dir).select(
        F.floor(sheet / SHEETS).alias("file"), F.concat(F.lit("sheet"), sheet.cast("string")).alias("sheet"), (sheet % SHEETS).alias("kind"),
        (place + 4).cast("int").alias("row"), "mpn", "description", "part_id",
    )
    n, notes = (F.col("part_id") % 500 + 1).cast("string"), F.col("kind") == SHEETS - 1
    cell = lambda col, text: F.struct(col.cast("int").alias("col"), text.alias("text"))
    first = F.col("kind") == 0
    junk = F.when(F.col("part_id") % 11 == 0, "see note").otherwise(F.col("mpn"))
    cells = F.array(
        cell(F.when(first, 1).otherwise(3), F.when(notes, F.col("description")).otherwise(junk)),
        cell(F.when(first, 2).otherwise(1), F.when(notes, F.lit("text")).otherwise(n)),
        cell(F.when(first, 3).otherwise(0), F.concat(n, F.lit(".25"))), cell(F.when(first, 0).otherwise(2), F.col("description")),
    )
    body = rows.select("file", "sheet", "row", F.explode(cells).alias("c")).select("file", "sheet", "row", "c.col", "c.text")
    heads = F.array(
        *[F.struct(F.lit(r).alias("row"), col.cast("int").alias("col"), F.lit(t).alias("text")) for r, col, t in (
            (0, F.lit(0), "Bill of materials"), (3, F.when(first, 1).otherwise(3), "MPN"), (3, F.when(first, 2).otherwise(1), "Qty"),
            (3, F.when(first, 3).otherwise(0), "Unit price"), (3, F.when(first, 0).otherwise(2), "Description"),
        )]
    )
    head = rows.select("file", "sheet", "kind").distinct().select("file", "sheet", F.explode(heads).alias("c"))
    return body.unionByName(head.select("file", "sheet", "c.row", "c.col", "c.text"))


SHEET_CELLS = f"""
sheet_rows AS (
  SELECT part_id // {ROWS} // {SHEETS} AS file, 'sheet' || CAST(part_id // {ROWS} AS VARCHAR) AS sheet, part_id // {ROWS} % {SHEETS} AS kind,
         CAST(part_id % {ROWS} + 4 AS INT) AS row, mpn, description, part_id, CAST(part_id % 500 + 1 AS VARCHAR) AS n FROM catalog
), sheet_cells AS (
  SELECT file, sheet, row, CASE kind WHEN 0 THEN 1 ELSE 3 END AS col,
         CASE WHEN kind = {SHEETS - 1} THEN description WHEN part_id % 11 = 0 THEN 'see note' ELSE mpn END AS text FROM sheet_rows
  UNION ALL SELECT file, sheet, row, CASE kind WHEN 0 THEN 2 ELSE 1 END, CASE WHEN kind = {SHEETS - 1} THEN 'text' ELSE n END FROM sheet_rows
  UNION ALL SELECT file, sheet, row, CASE kind WHEN 0 THEN 3 ELSE 0 END, n || '.25' FROM sheet_rows
  UNION ALL SELECT file, sheet, row, CASE kind WHEN 0 THEN 0 ELSE 2 END, description FROM sheet_rows
  UNION ALL SELECT DISTINCT file, sheet, 0, 0, 'Bill of materials' FROM sheet_rows
  UNION ALL SELECT DISTINCT file, sheet, 3, CASE kind WHEN 0 THEN 1 ELSE 3 END, 'MPN' FROM sheet_rows
  UNION ALL SELECT DISTINCT file, sheet, 3, CASE kind WHEN 0 THEN 2 ELSE 1 END, 'Qty' FROM sheet_rows
  UNION ALL SELECT DISTINCT file, sheet, 3, CASE kind WHEN 0 THEN 3 ELSE 0 END, 'Unit price' FROM sheet_rows
  UNION ALL SELECT DISTINCT file, sheet, 3, CASE kind WHEN 0 THEN 0 ELSE 2 END, 'Description' FROM sheet_rows
)"""

#: A category text, a description and attributes of each kind of record; {n} is a number from the part.
RECORDS = [
    ("Thick Film Resistors - SMD", "Thick Film Resistors 0603 0.1% 25ppm {n}KOhm 0.25W 75V -55C - 155C", [("Resistance", "{n} kOhms"), ("Power Rating", "250 mW"), ("Tolerance", "-")]),
    ("Multilayer Ceramic Capacitors MLCC", "Ceramic Capacitors {n}V 0.033uF C0G 1210 5%", [("Capacitance", "{n} nF"), ("Voltage Rating DC", "630 V"), ("Capacitance", "9 pF")]),
    ("MOSFET", "N-Channel MOSFET, {n} A, 1200 V, 8.5 mOhm", [("Vds - Drain-Source Voltage", "TBD"), ("Id - Continuous Drain Current", "{n} A")]),
    ("LDO Voltage Regulators", "LDO Voltage Regulators {n} mA, 38 V low-dropout regulator, with 45uA quiescent current", [("Output Voltage", "3.3 V"), ("Operating Temperature", "-40 C to +125 C")]),
    ("8-bit Microcontrollers - MCU", "MCU {n}KB Flash, 4KB RAM, 20MHz, 12-bit ADC, 1.62-5.5V, 85C", [("Program Memory Size", "{n} kB"), ("Number of I/Os", "26"), ("Supply Voltage - Min", "1.8 V")]),
    ("Crystals", "Crystal Oscillator 3225 {n}MHz 50ppm -40C - 85C CMOS 1.2V", [("Frequency", "{n} MHz"), ("Load Capacitance", "18 pF")]),
    ("Resistor Networks & Arrays", "Resistor array 4.7 kOhm", [("Resistance", "4.7 kOhms")]),
    ("Zener Diodes", "Zener Diodes 500mW MIL-PRF-19500", [("Zener Voltage", "{n} V"), ("Pd - Power Dissipation", "500 mW"), ("Ir - Reverse Leakage Current", "5 uA")]),
    ("FPGA - Field Programmable Gate Array", "FPGA", [("Number of Logic Elements", "{n},000"), ("Number of I/Os", "{n}"), ("Package/Case", "FBGA-256 (14x14)")]),
    ("", "A record without a category", []),
]
LIFECYCLE_TEXTS = ["", "Not Recommended for New Designs", "End of Life", "Obsolete", "New Product"]
PRICE_TEXTS = ["$0.{n}", "1,{n} €", "$1,2{n}.50"]


def _filled(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("{n}"), F.col("n"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distributor's records: mpn, category and lifecycle as texts, description, attributes, stocks, price breaks."""
    rows = catalog(spark, sf_dir).select("part_id", "mpn", (F.col("part_id") % 83 + 10).cast("string").alias("n"))
    pair = lambda k, v: F.struct(F.lit(k).alias("AttributeName"), _filled(v).alias("AttributeValue"))
    empty = F.array().cast("array<struct<AttributeName:string,AttributeValue:string>>")
    pick = lambda values, by: F.element_at(F.array(*values), (F.col("part_id") % by + 1).cast("int"))
    attributes = F.lit(None)
    for i, (_, _, pairs) in enumerate(RECORDS):
        attributes = F.when(F.col("part_id") % len(RECORDS) == i, F.array(*[pair(*p) for p in pairs]) if pairs else empty).otherwise(attributes)
    return rows.select(
        "part_id", F.col("mpn").alias("ManufacturerPartNumber"), pick([F.lit(r[0]) for r in RECORDS], len(RECORDS)).alias("Category"),
        pick([_filled(r[1]) for r in RECORDS], len(RECORDS)).alias("Description"), attributes.alias("ProductAttributes"),
        pick([F.lit(x) for x in LIFECYCLE_TEXTS], len(LIFECYCLE_TEXTS)).alias("LifecycleStatus"),
        F.when(F.col("part_id") % 3 == 0, "None").otherwise(F.concat("n", F.lit(",000 In Stock"))).alias("Availability"), F.when(F.col("part_id") % 4 == 0, F.col("n")).alias("FactoryStock"),
        F.array(
            F.struct(F.lit(1).alias("Quantity"), F.lit("$99.00").alias("Price")),
            F.struct(F.lit(100).alias("Quantity"), pick([_filled(x) for x in PRICE_TEXTS], len(PRICE_TEXTS)).alias("Price")),
        ).alias("PriceBreaks"),
    )


def _picked(values: list[str], by: int) -> str:
    return f"replace([{', '.join(_text(v) for v in values)}][part_id % {by} + 1], '{{n}}', n)"


RECORD_ROWS = f"""
records AS (
  SELECT part_id, mpn, n, {_picked([r[0] for r in RECORDS], len(RECORDS))} AS category_text, {_picked([r[1] for r in RECORDS], len(RECORDS))} AS description,
         {_picked(LIFECYCLE_TEXTS, len(LIFECYCLE_TEXTS))} AS lifecycle_text, {_picked(PRICE_TEXTS, len(PRICE_TEXTS))} AS price_text,
         CASE WHEN part_id % 3 = 0 THEN 'None' ELSE n || ',000 In Stock' END AS availability, CASE WHEN part_id % 4 = 0 THEN n END AS factory
  FROM (SELECT part_id, mpn, CAST(part_id % 83 + 10 AS VARCHAR) AS n FROM catalog)
), record_attributes AS (
  SELECT part_id, place, name, replace(value, '{{n}}', n) AS value FROM records JOIN (VALUES {
    ", ".join(f"({i}, {k}, {_text(name)}, {_text(value)})" for i, (_, _, pairs) in enumerate(RECORDS) for k, (name, value) in enumerate(pairs))
  }) AS a(kind, place, name, value) ON kind = part_id % {len(RECORDS)}
)"""
