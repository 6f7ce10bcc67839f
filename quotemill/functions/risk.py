"""Itemised risk of a line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the rules, and the bands' upper ends, hours and test methods.
POINTS = {"lifecycle": 30, "no_authorized_stock": 20, "market_volatile": 15, "market_elevated": 8, "defense_grade": 15, "aged_part": 10, "low_confidence": 10}
AGE_YEARS, SURE = 15, 0.8
TARGET_HOURS, NEAR_TARGET = 48, 0.7
METHODS = [
    "External visual inspection (EVI)", "Marking permanency test", "XRF elemental analysis", "Dimensional analysis",
    "Solderability test", "Radiological (X-ray) inspection", "Decapsulation / internal physical analysis",
    "Electrical parameter testing",
]
BANDS = [("standard", "Standard", 25, 4, 2), ("enhanced", "Enhanced", 55, 12, 5), ("full", "Full AS6171", 100, 36, 8)]


def is_dead(lifecycle: Column) -> Column:
    return lifecycle.isin("Obsolete", "EOL")


def age_years(introduced: Column, today: Column) -> Column:
    """Years since a date in the first ten signs; null where there is none."""
    return F.datediff(today, F.left(introduced, F.lit(10)).try_cast("date")) / 365.25


def reasons(lifecycle, stock, flag, defense, category, introduced, confidence, today) -> Column:
    """array<struct<code, label, points, detail>> of the rules that fire. All arguments are columns."""
    age = age_years(introduced, today)

    def rule(test: Column, code: str, label: Column, detail: Column) -> Column:
        row = F.struct(F.lit(code).alias("code"), label.alias("label"), F.lit(POINTS[code]).alias("points"), detail.alias("detail"))
        return F.when(test, row)

    return F.array_compact(
        F.array(
            rule(is_dead(lifecycle), "lifecycle", lifecycle, F.lit("No longer made; supply is what the channel holds.")),
            rule(stock <= 0, "no_authorized_stock", F.lit("No authorized stock"), F.lit("Every offer is broker stock.")),
            rule(flag == "VOLATILE", "market_volatile", F.lit("Volatile market"), F.lit("Quotes lie far apart.")),
            rule(flag == "ELEVATED", "market_elevated", F.lit("Elevated market"), F.lit("Quotes are wider than is usual for the part.")),
            rule(F.coalesce(defense, F.lit(False)) | F.coalesce(F.contains(category, F.lit("MIL-Spec")), F.lit(False)), "defense_grade",
                 F.lit("Defense / aerospace grade"), F.lit("An escape would be costly.")),
            rule(age > AGE_YEARS, "aged_part", F.concat(F.lit("Introduced "), F.bround(age).cast("int").cast("string"), F.lit(" years ago")),
                 F.lit("More years in the grey market.")),
            rule(confidence < SURE, "low_confidence", F.lit("Uncertain part match"), F.lit("Confirm the part number first.")),
        )
    )


def score(found: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(found, F.lit(0), lambda a, r: a + r["points"]))


def band(points: Column) -> Column:
    """struct of band, title, hours, methods and whether the hours near or exceed the target."""
    out = None
    for name, title, top, hours, n in reversed(BANDS):
        row = F.struct(
            F.lit(name).alias("band"), F.lit(title).alias("title"), F.lit(hours).alias("hours"),
            F.array(*map(F.lit, METHODS[:n])).alias("methods"),
            F.lit(hours >= TARGET_HOURS * NEAR_TARGET).alias("approaching_target"),
            F.lit(hours > TARGET_HOURS).alias("exceeds_target"),
        )
        out = row if out is None else F.when(points <= top, row).otherwise(out)
    return out


def assessed(df, today: Column):
    """df with risk_reasons, risk_score and test; null where no part was matched. df has matched_mpn and the
    columns lifecycle_status, authorized_stock, volatility_flag, is_defense_grade, category, date_introduced,
    confidence."""
    known = F.col("matched_mpn").isNotNull()
    found = reasons(*[F.col(c) for c in ("lifecycle_status", "authorized_stock", "volatility_flag", "is_defense_grade", "category", "date_introduced", "confidence")], today)
    df = df.withColumn("risk_reasons", F.when(known, found))
    df = df.withColumn("risk_score", F.when(known, score(F.col("risk_reasons"))))
    return df.withColumn("test", F.when(known, band(F.col("risk_score"))))
