"""Does a token look like a part number, a quantity or a price: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPT = 0.5
SHORTEST, LONGEST, IDEAL = 4, 32, (5, 25)
#: What is never a part number, and what stands around one.
NEVER = {
    "email": r"[^\s@]+@[^\s@]+\.[^\s@]+",
    "url": r"(?i)^(?:https?://|www\.)",
    "money": r"^[$€£]\s*[\d.,]+$",
    "date": r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}$",
    "time": r"^\d{1,2}:\d{2}",
    "number": r"^[\d.,]+$",
    "phone": r"^\+?\d[\d\s().-]{7,}$",
    "unit": r"(?i)^\d+[\d,.]*\s*(?:pcs?|pieces?|ea|units?|k|m|reels?|tubes?|trays?)$",
}
PROSE = ["COVID19", "Q1", "Q2", "Q3", "Q4", "24H", "48H", "72H", "1ST", "2ND", "3RD", "RFQ", "PO", "ASAP", "EAU", "MOQ", "NCNR", "ROHS", "REACH", "AS6171"]
WRAPPERS = "\"'()[]{}<>"
STOPS = ".,;:!?"


def stripped(token: Column) -> Column:
    """Without blanks, brackets and quotes around it, then without stops of a sentence."""
    inner = F.btrim(F.btrim(token, F.lit(" \t\r\n\f\x0b")), F.lit(WRAPPERS))
    return F.btrim(inner, F.lit(STOPS))


def token_score(token: Column) -> Column:
    """0 to 1; token is stripped already. What is added: the case, letter and digit in turn, length, marks."""
    n = F.length(token)
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    digits = n - F.length(F.regexp_replace(token, r"\d", ""))
    never = (n < SHORTEST) | (n > LONGEST) | F.upper(token).isin(PROSE) | (F.length(letters) == 0) | (digits == 0)
    for pattern in NEVER.values():
        never = never | F.rlike(token, F.lit(pattern))
    runs = F.regexp_count(token, F.lit(r"(?:[A-Za-z]+\d|\d+[A-Za-z])"))
    ratio = digits / n
    score = (
        F.lit(0.45)
        + F.when(n.between(*IDEAL), 0.15).otherwise(-0.10)
        + F.when(letters == F.upper(letters), 0.12).when(letters == F.lower(letters), 0.02).otherwise(0.0)
        + F.when(F.rlike(token, F.lit(r"[A-Za-z]\d")), 0.15).otherwise(0.0)
        + F.least(runs, F.lit(3)) * 0.05
        + F.when(F.rlike(token, F.lit(r"[-_/.+#,]")), 0.05).otherwise(0.0)
        + F.when(ratio.between(0.15, 0.75), 0.10).otherwise(-0.05)
        + F.when(F.rlike(token, F.lit(r"[^\p{L}\d_\-/.+#,]")), -0.25).otherwise(0.0)
    )
    return F.when(F.coalesce(never, F.lit(True)), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def is_part(score: Column) -> Column:
    return F.round(score, 9) >= ACCEPT


def is_quantity(text: Column) -> Column:
    return F.rlike(F.regexp_replace(F.btrim(text), "[, ]", ""), F.lit(r"^\d{1,9}$"))


def quantity(text: Column) -> Column:
    """The number above 0 that is left without commas and blanks, else null."""
    bare = F.regexp_replace(text, r"[,\s]", "")
    number = F.when(F.rlike(bare, F.lit(r"^\d+$")), bare.try_cast("long"))
    return F.when(number > 0, number)


def is_currency(text: Column) -> Column:
    t = F.btrim(text)
    return F.rlike(t, F.lit(NEVER["money"])) | F.rlike(t, F.lit(r"^\d+\.\d{1,6}$"))


def token_score_sql(x: str) -> str:
    never = " OR ".join(f"regexp_matches({x}, '{p}')" for p in NEVER.values())
    letters = f"regexp_replace({x}, '[^\\p{{L}}]', '', 'g')"
    digits = f"(length({x}) - length(regexp_replace({x}, '\\d', '', 'g')))"
    prose = ", ".join(f"'{w}'" for w in PROSE)
    return f"""CASE WHEN {x} IS NULL OR length({x}) < {SHORTEST} OR length({x}) > {LONGEST} OR upper({x}) IN ({prose})
      OR length({letters}) = 0 OR {digits} = 0 OR {never} THEN 0.0 ELSE greatest(0.0, least(1.0, 0.45::DOUBLE
      + CASE WHEN length({x}) BETWEEN {IDEAL[0]} AND {IDEAL[1]} THEN 0.15::DOUBLE ELSE -0.10::DOUBLE END
      + CASE WHEN {letters} = upper({letters}) THEN 0.12::DOUBLE WHEN {letters} = lower({letters}) THEN 0.02::DOUBLE ELSE 0 END
      + CASE WHEN regexp_matches({x}, '[A-Za-z]\\d') THEN 0.15::DOUBLE ELSE 0 END
      + least(len(regexp_extract_all({x}, '(?:[A-Za-z]+\\d|\\d+[A-Za-z])')), 3) * 0.05::DOUBLE
      + CASE WHEN regexp_matches({x}, '[-_/.+#,]') THEN 0.05::DOUBLE ELSE 0 END
      + CASE WHEN {digits} / length({x})::DOUBLE BETWEEN 0.15 AND 0.75 THEN 0.10::DOUBLE ELSE -0.05::DOUBLE END
      + CASE WHEN regexp_matches({x}, '[^\\p{{L}}\\d_\\-/.+#,]') THEN -0.25::DOUBLE ELSE 0 END)) END"""


def stripped_sql(x: str) -> str:
    wrappers = WRAPPERS.replace("'", "''")
    return f"trim(trim(trim({x}, ' ' || chr(9)), '{wrappers}'), '{STOPS}')"


def quantity_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '[,\\s]', '', 'g')"
    return f"CASE WHEN regexp_matches({bare}, '^\\d+$') THEN nullif(TRY_CAST({bare} AS BIGINT), 0) END"


def is_quantity_sql(x: str) -> str:
    return f"regexp_matches(regexp_replace(trim({x}), '[, ]', '', 'g'), '^\\d{{1,9}}$')"


def is_currency_sql(x: str) -> str:
    return f"(regexp_matches(trim({x}), '{NEVER['money']}') OR regexp_matches(trim({x}), '^\\d+\\.\\d{{1,6}}$'))"
