"""Free text of requests to lines of part and quantity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.tokens import (
    ACCEPT, is_part, is_quantity, is_quantity_sql, quantity, quantity_sql, stripped, stripped_sql, token_score, token_score_sql,
)

MOST_ITEMS = 500
#: Lines that are no request.
SKIPPED = {
    "header": r"(?i)^\s*(?:from|to|cc|bcc|sent|subject|date|reply-to|importance|attachments?)\s*:",
    "greeting": r"(?i)^\s*(?:hi|hello|hey|dear|good\s+(?:morning|afternoon|evening))\b[\s,!.]*$",
    "sign_off": r"(?i)^\s*(?:regards|kind regards|best regards|best|thanks|thank you|cheers|sincerely|br|rgds)\b[\s,!.]*$",
    "rule": r"^\s*[-=_*~#]{3,}\s*$",
    "table_header": r"(?i)^\s*(?:part\s*(?:number|no\.?|#)?|mpn|p/?n|item|component|description)\b.{0,60}\b(?:qty|quantity|amount|price|each|uom)\b",
}
#: Quoted lines and what introduces them (two patterns in one, as either makes a line quoted), what begins a signature, list marks, what parts fields.
QUOTED = r"(?i)^\s*>|^\s*on .+ (?:wrote|schrieb):|^\s*-+\s*original message\s*-+|^\s*from:.*sent:"
SIGNATURE = r"(?i)^\s*(?:--\s*$|__+\s*$|sent from my )"
LIST_MARK = r"^\s*(?:[-*•·–]|\(?\d{1,3}[.)])\s+"
DELIMITERS = [r"\t+", r"\s*;\s*", r",\s+", r"\s{2,}"]
#: Phrases of quantity, first ones first: what stands before the number, the number, what ends it. In three
#: parts, as the guard against prices stands around the number.
PHRASES = [
    (r"\bx\s*", r"\d[\d,\s]*", r"\b"),
    (r"\bqty\.?\s*[:=]?\s*", r"\d[\d,\s]*", r"\b"),
    (r"\bquantity\s*[:=]?\s*", r"\d[\d,\s]*", r"\b"),
    (r"\b", r"\d[\d,]*", r"\s*(?:pcs?|pieces?|ea\b|units?)"),
    (r"\bneed\s+", r"\d[\d,]*", r"\b"),
]
#: A number is a whole one, and not the digits of a price: no currency before it, no cents after it.
_NO_PRICE, _NO_CENTS = r"(?<!\d[\d,]{0,20})(?<![$€£@]\s{0,9})", r"(?!\.\d)"


def lines(texts: DataFrame) -> DataFrame:
    """texts (doc_id, raw_text) by line: doc_id, line_no from 1, line. Line ends of any kind; none at the end."""
    text = F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?:\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029])$", "")
    parts = F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", -1)
    return texts.select("doc_id", F.posexplode(parts).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def phrase_quantity(text: Column) -> Column:
    """struct of the number in the first phrase that fits, and the text without that phrase."""
    out = F.struct(F.lit(None).cast("long").alias("quantity"), text.alias("rest"))
    for before, number, end in reversed(PHRASES):
        # the number is not tried again with fewer digits
        pattern = F.lit(f"(?i){before}{_NO_PRICE}(?>({number}){end}){_NO_CENTS}")
        found = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), quantity)
        place = F.array_position(F.transform(found, lambda n: n.isNotNull()), True).cast("int")
        whole = F.get(F.regexp_extract_all(text, pattern, F.lit(0)), place - 1)
        at = F.instr(text, whole)
        rest = F.concat(F.left(text, at - 1), F.lit(" "), F.substring(text, at + F.length(whole), F.length(text)))
        out = F.when(place > 0, F.struct(F.get(found, place - 1).alias("quantity"), rest.alias("rest"))).otherwise(out)
    return out


def best(parts: Column) -> Column:
    """The first of the highest score: struct of score, token and place from 1."""

    def rated(x: Column, i: Column) -> Column:
        token = stripped(x)
        score = token_score(token)
        return F.struct(F.round(score, 9).alias("rank"), (-i).alias("at"), score.alias("score"), token.alias("token"))

    top = F.array_max(F.transform(parts, rated))
    return F.struct(top["score"].alias("score"), top["token"].alias("token"), (1 - top["at"]).alias("place"))


def fields_of(body: Column) -> Column:
    """The parts of a delimited line, by the first delimiter that gives more than one; else the line."""
    out = F.array(F.btrim(body))
    for d in reversed(DELIMITERS):
        parts = F.filter(F.transform(F.split(body, d, -1), lambda x: F.btrim(x)), lambda x: x != "")
        out = F.when(F.size(parts) > 1, parts).otherwise(out)
    return out


def classified(texts: DataFrame) -> DataFrame:
    """Each line that isn't blank, with what it is: signature, quoted, one of SKIPPED, or body."""
    rows = lines(texts).withColumn("bare", F.btrim("line", F.lit(" \t\r\n\f\x0b"))).where("bare <> ''")
    by_line = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.max(F.rlike("bare", F.lit(SIGNATURE))).over(by_line)
    kind = F.when(signed, "signature").when(F.rlike("line", F.lit(QUOTED)), "quoted")
    for name, pattern in SKIPPED.items():
        kind = kind.when(F.rlike("bare", F.lit(pattern)), name)
    return rows.withColumn("kind", kind.otherwise("body"))


def parsed(texts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """doc_id, line_no, kind, input_string, quantity, token_score of each line; kind `item` where a part was
    found, `prose` where none was. An item beyond `most` of its document is `over`."""
    rows = classified(texts)
    body = F.btrim(F.regexp_replace("line", LIST_MARK, ""))
    rows = rows.withColumn("body", F.when(F.col("kind") == "body", body)).withColumn("fields", fields_of(F.col("body")))
    rows = rows.withColumn("phrase", phrase_quantity(F.col("body")))
    rows = rows.withColumn("field", best(F.col("fields")))
    delimited = (F.size("fields") > 1) & is_part(F.col("field.score"))
    later = F.slice("fields", F.col("field.place") + 1, F.size("fields"))
    numbers = F.array_compact(F.transform(later, lambda f: F.when(is_quantity(f), quantity(f)).otherwise(phrase_quantity(f)["quantity"])))
    rows = rows.withColumn("listed", F.when(delimited, F.coalesce(F.get(numbers, F.lit(0)), F.col("phrase.quantity"))))
    rows = rows.withColumn("free", best(F.split("phrase.rest", r"\s+")))
    rows = rows.withColumn("whole", best(F.split("body", r"\s+")))
    found = (
        F.when(delimited, F.struct(F.col("field.token").alias("token"), F.col("field.score").alias("score"), F.col("listed").alias("quantity")))
        .when(is_part(F.col("free.score")), F.struct(F.col("free.token").alias("token"), F.col("free.score").alias("score"), F.col("phrase.quantity").alias("quantity")))
        .when(is_part(F.col("whole.score")), F.struct(F.col("whole.token").alias("token"), F.col("whole.score").alias("score"), F.col("phrase.quantity").alias("quantity")))
    )
    rows = rows.withColumn("found", found)
    is_item = (F.col("kind") == "body") & F.col("found").isNotNull()
    so_far = F.sum(is_item.cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))
    kind = F.when(is_item, F.when(so_far <= most, "item").otherwise("over")).when(F.col("kind") == "body", "prose").otherwise(F.col("kind"))
    return rows.select(
        "doc_id", "line_no", kind.alias("kind"), F.when(is_item, F.col("found.token")).alias("input_string"),
        F.when(is_item, F.col("found.quantity")).alias("quantity"), F.when(is_item, F.col("found.score")).alias("token_score"),
        "bare",
    )


def diagnostics(texts: DataFrame) -> DataFrame:
    """Lines read, quoted ones, and whether a signature was cut, by document."""
    read = lines(texts).groupBy("doc_id").agg(F.count("*").alias("lines_read"))
    kinds = classified(texts).groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "quoted").alias("quoted_lines"), F.bool_or(F.col("kind") == "signature").alias("signature_stripped")
    )
    out = read.join(kinds, "doc_id", "left")
    return out.select("doc_id", "lines_read", F.coalesce("quoted_lines", F.lit(0)).alias("quoted_lines"), F.coalesce("signature_stripped", F.lit(False)).alias("signature_stripped"))


def classified_sql(source: str) -> str:
    """CTEs from a relation of doc_id and raw_text to `kinds`: doc_id, line_no, line, bare, kind. Line ends are feeds."""
    kinds = " ".join(f"WHEN regexp_matches(bare, '{p}') THEN '{name}'" for name, p in SKIPPED.items())
    return f"""
split_lines AS (
  SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM {source}
), bare_lines AS (
  SELECT *, trim(line, ' ' || chr(9)) AS bare FROM split_lines WHERE trim(line, ' ' || chr(9)) <> ''
), signed_lines AS (
  SELECT *, max(CAST(regexp_matches(bare, '{SIGNATURE}') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS signed FROM bare_lines
), kinds AS (
  SELECT doc_id, line_no, line, bare, CASE WHEN signed = 1 THEN 'signature' WHEN regexp_matches(line, '{QUOTED}') THEN 'quoted' {kinds} ELSE 'body' END AS kind
  FROM signed_lines
)"""


def _phrase_sql(x: str, i: int, wanted: str) -> str:
    """The number of the i-th phrase in x, or the whole phrase; null if it is a price or there is none."""
    before, number, end = PHRASES[i]
    parts = f"regexp_extract({x}, '(?i)([$€£@]\\s*)?{before}({number}){end}(\\.\\d)?', ['price', 'n', 'cents'])"
    value = quantity_sql(f"{parts}.n") if wanted == "n" else f"regexp_extract({x}, '(?i){before}({number}){end}', 0)"
    return f"CASE WHEN {parts}.price = '' AND {parts}.cents = '' THEN {value} END"


def phrase_quantity_sql(x: str) -> str:
    return "coalesce(" + ", ".join(_phrase_sql(x, i, "n") for i in range(len(PHRASES))) + ")"


def phrase_sql(x: str) -> str:
    """The phrase that gives the number."""
    whens = " ".join(f"WHEN {_phrase_sql(x, i, 'n')} IS NOT NULL THEN {_phrase_sql(x, i, 'whole')}" for i in range(len(PHRASES)))
    return f"CASE {whens} END"


def parsed_sql(source: str) -> str:
    """CTEs to `parsed`: the rows of parsed(), but for the cap on items."""
    split = " ".join(
        f"WHEN len({f}) > 1 THEN {f}" for f in (f"list_filter(list_transform(regexp_split_to_array(body, '{d}'), lambda x: trim(x)), lambda x: x <> '')" for d in DELIMITERS)
    )
    score = token_score_sql("token")
    return f"""{classified_sql(source)}, bodies AS (
  SELECT *, CASE WHEN kind = 'body' THEN trim(regexp_replace(line, '{LIST_MARK}', '')) END AS body FROM kinds
), phrased AS (
  SELECT *, {phrase_quantity_sql("body")} AS phrase_n, {phrase_sql("body")} AS phrase, CASE {split} ELSE [body] END AS fields FROM bodies WHERE kind = 'body'
), rests AS (
  SELECT *, CASE WHEN phrase IS NULL THEN body ELSE left(body, strpos(body, phrase) - 1) || ' ' || substr(body, strpos(body, phrase) + length(phrase)) END AS rest FROM phrased
), words AS (
  SELECT doc_id, line_no, 1 AS way, unnest(fields) AS word, generate_subscripts(fields, 1) AS place FROM rests WHERE len(fields) > 1
  UNION ALL SELECT doc_id, line_no, 2, unnest(string_split_regex(rest, '\\s+')), generate_subscripts(string_split_regex(rest, '\\s+'), 1) FROM rests
  UNION ALL SELECT doc_id, line_no, 3, unnest(string_split_regex(body, '\\s+')), generate_subscripts(string_split_regex(body, '\\s+'), 1) FROM rests
), rated AS (
  SELECT *, {score} AS score FROM (SELECT *, {stripped_sql("word")} AS token FROM words)
), firsts AS (
  SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY doc_id, line_no, way ORDER BY round(score, 9) DESC, place) = 1
), chosen AS (
  SELECT * FROM firsts WHERE round(score, 9) >= {ACCEPT} QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY way) = 1
), later AS (
  SELECT r.doc_id, r.line_no, r.place, CASE WHEN {is_quantity_sql("r.word")} THEN {quantity_sql("r.word")} ELSE {phrase_quantity_sql("r.word")} END AS n
  FROM rated r JOIN chosen c ON c.doc_id = r.doc_id AND c.line_no = r.line_no AND c.way = 1 AND r.way = 1 AND r.place > c.place
), listed AS (SELECT doc_id, line_no, arg_min(n, place) AS n FROM later WHERE n IS NOT NULL GROUP BY ALL), parsed AS (
  SELECT k.doc_id, k.line_no, CASE WHEN c.token IS NOT NULL THEN 'item' WHEN k.kind = 'body' THEN 'prose' ELSE k.kind END AS kind,
         c.token AS input_string, CASE WHEN c.way = 1 THEN coalesce(l.n, p.phrase_n) WHEN c.way > 1 THEN p.phrase_n END AS quantity, c.score AS token_score
  FROM kinds k LEFT JOIN chosen c USING (doc_id, line_no) LEFT JOIN phrased p USING (doc_id, line_no) LEFT JOIN listed l USING (doc_id, line_no)
)"""
