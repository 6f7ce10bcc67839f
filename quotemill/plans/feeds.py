"""Queries over distributors' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import units
from quotemill.operators import alternates, records
from quotemill.sources import feeds
from quotemill.sources.feeds import RECORD_ROWS, RECORDS
from quotemill.sources.tables import CATALOG


def si_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every attribute of every record: its normal name and, if it has one, its value in base units, or both ends."""
    rows = feeds.records(spark, sf).select("part_id", F.posexplode("ProductAttributes").alias("place", "a"))
    span, value = units.si_range(F.col("a.AttributeValue")), units.si_value(F.col("a.AttributeValue"))
    return rows.select("part_id", "place", units.attribute_name(F.col("a.AttributeName")).alias("name"), F.round(value, 15).alias("value"), span["low"].alias("low"), span["high"].alias("high"))


def category_map(spark: SparkSession, sf: str) -> DataFrame:
    """Category, lifecycle, stock and tier of every record."""
    return feeds.records(spark, sf).select(
        "part_id", units.category(F.col("Category")).alias("category"), units.lifecycle(F.col("LifecycleStatus")).alias("lifecycle"),
        units.stock(F.col("Availability"), F.col("FactoryStock")).alias("stock"), units.price_tier(units.unit_price(F.col("PriceBreaks"))).alias("tier"),
    )


def desc_specs(spark: SparkSession, sf: str) -> DataFrame:
    """What the description of every record tells, field by field."""
    return records.with_described(feeds.records(spark, sf)).select("part_id", F.explode("described").alias("field", "value"))


def record_specs(spark: SparkSession, sf: str) -> DataFrame:
    """The specs of every record that is a part, from attributes and descriptions."""
    return records.parts(feeds.records(spark, sf)).select("mpn", "category", "is_defense_grade", "package", F.explode("specs").alias("field", "value"))


def spec_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Spread and weight of each spec of the thirteen categories that records have."""
    return alternates.weights(alternates.spread(alternates.long_specs(records.parts(feeds.records(spark, sf))))).drop("parts")


QUERIES = {f.__name__: f for f in (si_values, category_map, desc_specs, record_specs, spec_weights)}

#: What the texts of RECORDS say, by kind of record: n is the number in them. First by description, then by attributes;
#: a name of an attribute counts within a longer one, so the size of a program's memory is that of `ram` too.
_DESCRIBED = {
    0: {"resistance_ohm": "n * 1000", "tolerance_pct": "0.1", "power_rating_w": "0.25", "tcr_ppm": "25", "voltage_rating_v": "75", "temp_range.min_c": "-55", "temp_range.max_c": "155"},
    1: {"capacitance_pf": "33000", "tolerance_pct": "5", "voltage_rating_v": "n"},
    2: {"vds_max_v": "1200", "id_continuous_a": "n", "rds_on_mohm": "8.5"},
    3: {"input_voltage_max_v": "38", "output_current_max_a": "n / 1000", "quiescent_current_ua": "45"},
    4: {"flash_kb": "n", "ram_kb": "4", "max_freq_mhz": "20", "adc_bits": "12", "operating_voltage.min_v": "1.62", "operating_voltage.max_v": "5.5", "temp_range.max_c": "85"},
    5: {"frequency_mhz": "n", "frequency_tolerance_ppm": "50", "temp_range.min_c": "-40", "temp_range.max_c": "85"},
}
_TOLD = {
    0: {"resistance_ohm": "n * 1000", "power_rating_w": "0.25"}, 1: {"capacitance_pf": "n * 1000", "voltage_rating_v": "630"}, 2: {"id_continuous_a": "n"},
    3: {"output_voltage_v": "3.3", "temp_range.min_c": "-40", "temp_range.max_c": "125"}, 4: {"flash_kb": "n", "ram_kb": "n", "gpio_count": "26", "operating_voltage.min_v": "1.8"},
    5: {"frequency_mhz": "n", "load_capacitance_pf": "18"}, 7: {"zener_voltage_v": "n", "power_dissipation_mw": "500", "reverse_leakage_ua": "5"},
    8: {"logic_elements": "n * 1000", "user_io_count": "n"},
}


def _expected(tables: list[dict[int, dict[str, str]]]) -> str:
    """part_id, mpn, kind, field, value, later tables going before earlier ones."""
    merged: dict[tuple[int, str], str] = {}
    for table in tables:
        merged |= {(kind, field): value for kind, fields in table.items() for field, value in fields.items()}
    return " UNION ALL ".join(
        f"SELECT part_id, mpn, part_id % {len(RECORDS)} AS kind, '{field}' AS field, CAST({value} AS DOUBLE) AS value FROM numbered WHERE part_id % {len(RECORDS)} = {kind}"
        for (kind, field), value in merged.items()
    )


_NAMES = ["Fixed Resistors", "Fixed Capacitors", "Power FETs", "Voltage Regulators", "Microcontrollers", "Crystal Oscillators", None, "Zener Diodes", "FPGAs", None]
_CATEGORY = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_NAMES) if name) + " END"
_NUMBERED = f"WITH {CATALOG}, {RECORD_ROWS}, numbered AS (SELECT part_id, mpn, CAST(n AS DOUBLE) AS n FROM records)"
_FACTORS = "CASE WHEN u IN ('ppm', 'V') OR length(u) < 2 THEN 1 ELSE CASE u[1] WHEN 'p' THEN 1e-12 WHEN 'n' THEN 1e-9 WHEN 'u' THEN 1e-6 WHEN 'm' THEN 1e-3 WHEN 'k' THEN 1e3 WHEN 'M' THEN 1e6 ELSE 1 END END"
SQL = {
    "si_values": f"""WITH {CATALOG}, {RECORD_ROWS}, v AS (
  SELECT part_id, place, name, value AS text, TRY_CAST(replace(regexp_extract(value, '[-+]?\\d[\\d,]*(?:\\.\\d+)?'), ',', '') AS DOUBLE) AS number,
         regexp_extract(value, '[-+]?\\d[\\d,]*(?:\\.\\d+)?\\s*([^\\s/]*)', 1) AS u, string_split(value, ' to ') AS ends FROM record_attributes)
SELECT part_id, place, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name, round(number * {_FACTORS}, 15) AS value,
       CASE WHEN len(ends) = 2 THEN TRY_CAST(regexp_extract(ends[1], '[-+]?\\d+') AS DOUBLE) END AS low,
       TRY_CAST(CASE WHEN len(ends) = 2 THEN regexp_extract(ends[2], '[-+]?\\d+') ELSE regexp_extract(text, '[A-Za-z%°]\\s*-\\s*([\\d.]+)', 1) END AS DOUBLE) AS high FROM v""",
    "category_map": f"""WITH {CATALOG}, {RECORD_ROWS}, r AS (
  SELECT *, part_id % {len(RECORDS)} AS kind, regexp_replace(price_text, '[^\\d.,]', '', 'g') AS bare FROM records
), p AS (
  SELECT *, CAST(CASE WHEN contains(bare, ',') AND NOT contains(bare, '.') THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END AS DOUBLE) AS price FROM r)
SELECT part_id, {_CATEGORY} AS category, CASE lifecycle_text WHEN 'Not Recommended for New Designs' THEN 'NRND' WHEN 'End of Life' THEN 'EOL' WHEN 'Obsolete' THEN 'Obsolete' ELSE 'Active' END AS lifecycle,
       CASE WHEN availability = 'None' THEN 0 ELSE CAST(n AS BIGINT) * 1000 END + coalesce(CAST(factory AS BIGINT), 0) AS stock,
       CASE WHEN price < 0.07 THEN 'jellybean' WHEN price < 0.67 THEN 'low' WHEN price < 4.2 THEN 'mid' WHEN price < 42 THEN 'high' ELSE 'premium' END AS tier FROM p""",
    "desc_specs": f"{_NUMBERED} SELECT part_id, field, value FROM ({_expected([_DESCRIBED])})",
    "record_specs": f"""{_NUMBERED} SELECT mpn, {_CATEGORY} AS category, kind = 7 AS is_defense_grade, CASE kind WHEN 8 THEN 'FBGA-256' ELSE '' END AS package, field, value
FROM ({_expected([_DESCRIBED, _TOLD])})""",
    "spec_weights": f"""{_NUMBERED}, s AS (SELECT {_CATEGORY} AS category, field, value FROM ({_expected([_DESCRIBED, _TOLD])})), v AS (
  SELECT category, field, list(value ORDER BY value) AS v FROM s GROUP BY ALL HAVING count(*) >= 2
), w AS (SELECT *, v[3 * len(v) // 4 + 1] - v[len(v) // 4 + 1] AS width FROM v)
SELECT category, field, CASE WHEN width > 0 THEN width ELSE coalesce(nullif(abs(v[-1] - v[1]), 0), nullif(abs(v[1]), 0), 1.0) END AS spread,
       CAST(CASE WHEN field IN ('temp_range.min_c', 'temp_range.max_c', 'tcr_ppm') THEN 0.3 ELSE CASE category || '/' || field {
           " ".join(f"WHEN '{c}/{f}' THEN {w}" for c, fields in alternates.HEADLINE.items() for f, w in fields.items())
       } ELSE 1.0 END END AS DOUBLE) AS weight FROM w""",
}
