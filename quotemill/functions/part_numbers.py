"""Normalising part numbers, as column expressions.

Every rule is a chain of built-in functions, so a request of any size stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill.functions.units import let

#: How a part is delivered, in the order in which endings are tried.
PACKAGING_SUFFIXES = [
    "T&R", "TAPEANDREEL", "TAPE&REEL",
    "-TAPEREEL", "/TAPEREEL", "-TAPE", "/TAPE",
    "-REEL", "/REEL", "-RL", "/RL",
    "-TR13", "/TR13", "TR13",
    "-TR7", "/TR7", "TR7",
    "-TRPBF", "-TR", "/TR", "_TR",
    "-CT", "/CT", "-DKR", "/DKR",
    "-E4", "/E4", "-E3", "/E3",
    "-ND", "/ND", "-BULK", "/BULK", "-TUBE", "/TUBE", "-TRAY", "/TRAY",
    "-CUT", "-CUTTAPE",
]
#: Patterns of quantities at the end, of a distributor's stub, of separators and of grades.
QUANTITY_ENDS = (
    r"(?:^|[\s,;])(?:QTY|QUANTITY|PCS?|PIECES|EA|EACH|X)\s*[:=]?\s*\d+\s*$"
    r"|(?:^|[\s,;])\d+\s*(?:PCS?|PIECES|EA|EACH)\s*$"
    r"|\s*[(\[]\s*\d+\s*[)\]]\s*$"
    r"|\s+X\d+\s*$"
)
DISTRIBUTOR_STUB = r"^\d{2,4}-([A-Z0-9]{3,})"
SEPARATORS = r"[\s\-_./\\,#]+"
GRADED = r"^([A-Z0-9]{6,}?)([TQUHIYZ]\d|[EICM]\d|-?\d{1,2}[EICM])$"
VARIANTS, CONFUSABLE_MOST = 8, 6


def _until_still(text: Column, step: Callable[[Column], Column], rounds: Column) -> Column:
    """step over and over; `rounds` is as many as can change anything."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), rounds)), text, lambda acc, _: step(acc))


def collapsed(text: Column) -> Column:
    return F.upper(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def _without_quantity(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "(?i)" + QUANTITY_ENDS, ""), F.lit(" ,;"))


def without_quantity(text: Column) -> Column:
    """Each quantity takes two signs at least. A text that has none after the first step stays as it is then."""
    more = lambda x: F.when(F.rlike(x, F.lit("(?i)" + QUANTITY_ENDS)), _until_still(x, _without_quantity, (F.length(x) / 2).cast("int"))).otherwise(x)
    return let(_without_quantity(text), more)


def _without_suffix(text: Column) -> Column:
    out = text
    for suffix in reversed(PACKAGING_SUFFIXES):  # the first in the list is asked first
        fits = F.endswith(text, F.lit(suffix)) & (F.length(text) > len(suffix) + 3)
        out = F.when(fits, F.left(text, F.length(text) - len(suffix))).otherwise(out)
    return out


def without_packaging(text: Column) -> Column:
    """The shortest ending has three signs. One look tells whether there is an ending at all."""
    some = F.rlike(text, F.lit("(?:" + "|".join(map(re.escape, PACKAGING_SUFFIXES)) + r")\z"))
    return F.when(some, _until_still(text, _without_suffix, (F.length(text) / 3).cast("int"))).otherwise(text)


def without_stub(text: Column) -> Column:
    return F.regexp_replace(text, DISTRIBUTOR_STUB, "$1")


def key_of(text: Column) -> Column:
    return F.regexp_replace(text, SEPARATORS, "")


def grade_of(key: Column) -> Column:
    """The grade at the end of a key of eight signs or more, else empty."""
    return F.when(F.length(key) >= 8, F.regexp_extract(key, GRADED, 2)).otherwise("")


def base_of(key: Column) -> Column:
    return F.left(key, F.length(key) - F.length(grade_of(key)))


def variants_of(key: Column, most: int = VARIANTS) -> Column:
    """Other readings of O and 0, I and 1 in keys with one to six of them: all, in order, the first `most`."""
    n = F.length(key) - F.length(F.translate(key, "O0I1", ""))
    places = F.filter(F.sequence(F.lit(1), F.length(key)), lambda i: F.instr(F.lit("O0I1"), F.substring(key, i, F.lit(1))) > 0)

    def widen(acc: Column, i: Column) -> Column:
        other = F.transform(acc, lambda x: F.concat(F.left(x, i - 1), F.translate(F.substring(x, i, F.lit(1)), "O0I1", "0O1I"), F.substring(x, i + 1, F.length(x))))
        return F.concat(acc, other)

    every = F.aggregate(places, F.array(key), widen)
    others = F.slice(F.array_sort(F.filter(every, lambda x: x != key)), 1, most)
    none = F.array().cast("array<string>")
    return F.when(n.between(1, CONFUSABLE_MOST), others).otherwise(none)


RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("uppercase_and_collapse", collapsed),
    ("strip_quantity_artefacts", without_quantity),
    ("strip_packaging_suffix", without_packaging),
    ("strip_distributor_prefix", without_stub),
]


def normalized(df, column: str = "input_string"):
    """df with display, key, base_key, grade, variants and the names of the rules that changed something.

    Each step stands in many places of the next one. Who filters by what comes out should checkpoint it before: a filter
    that is pushed below the steps holds all of them, over and over.
    """
    at = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumn("__step0", at)
    for i, (_, rule) in enumerate(RULES):
        df = df.withColumn(f"__step{i + 1}", rule(F.col(f"__step{i}")))
    display = F.col(f"__step{len(RULES)}")
    df = df.withColumn("display", display).withColumn("key", key_of(display))
    df = df.withColumn("grade", grade_of(F.col("key"))).withColumn("base_key", base_of(F.col("key")))
    df = df.withColumn("variants", variants_of(F.col("key")))
    fired = [F.when(F.col(f"__step{i}") != F.col(f"__step{i + 1}"), F.lit(name)) for i, (name, _) in enumerate(RULES)]
    fired.append(F.when(F.col("key") != F.col("display"), F.lit("normalize_separators")))
    fired.append(F.when(F.col("grade") != "", F.lit("split_grade_suffix")))
    fired.append(F.when(F.size("variants") > 0, F.lit("confusable_variants")))
    df = df.withColumn("applied", F.array_compact(F.array(*fired)))
    return df.drop(*[f"__step{i}" for i in range(len(RULES) + 1)])


def _sql_loop(column: str, step: str, rounds: int) -> str:
    out = column
    for _ in range(rounds):
        out = step.format(x=out)
    return out


def normalized_sql(source: str) -> str:
    """CTE `normalized` over a relation with input_id and input_string. Endings are taken by two unrolled rounds
    of alternatives tried in list order, which is enough for the endings that requests carry."""
    cases = " ".join(
        f"WHEN ends_with({{x}}, '{s}') AND length({{x}}) > {len(s) + 3} THEN left({{x}}, length({{x}}) - {len(s)})" for s in PACKAGING_SUFFIXES
    )
    ctes, last = [f"n0 AS (SELECT input_id, upper(trim(regexp_replace(input_string, '\\s+', ' ', 'g'))) AS t FROM {source})"], 0
    for _ in range(2):
        last += 1
        ctes.append(f"n{last} AS (SELECT input_id, trim(regexp_replace(t, '{QUANTITY_ENDS}', '', 'i'), ' ,;') AS t FROM n{last - 1})")
    for _ in range(4):
        last += 1
        ctes.append(f"n{last} AS (SELECT input_id, CASE {cases.format(x='t')} ELSE t END AS t FROM n{last - 1})")
    ctes.append(f"stub AS (SELECT input_id, regexp_replace(t, '{DISTRIBUTOR_STUB}', '\\1') AS display FROM n{last})")
    ctes.append(f"keyed AS (SELECT input_id, display, regexp_replace(display, '{SEPARATORS}', '', 'g') AS key FROM stub)")
    ctes.append(
        f"normalized AS (SELECT *, left(key, length(key) - length(grade)) AS base_key FROM (SELECT *, "
        f"CASE WHEN length(key) >= 8 THEN regexp_extract(key, '{GRADED}', 2) ELSE '' END AS grade FROM keyed))"
    )
    return ",\n".join(ctes)
