"""Queries over the catalog and requests: matching, alternates, risk, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import part_numbers, risk, units
from quotemill.operators import alternates as spec
from quotemill.operators import matching, requests, sampling, verify
from quotemill.plans.market import BAND, FLAG, WEEKLY, rounded
from quotemill.sources import tables
from quotemill.sources.session import spread
from quotemill.sources.tables import CATALOG, QUOTES, REQUESTS

TODAY = "2026-08-12"


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.read(tables.requests(spark, sf))


def normalize_inputs(spark, sf):
    out = _inputs(spark, sf)
    return out.select("input_id", "display", "key", "grade", "base_key")


def input_variants(spark, sf):
    """Other readings of the keys with one to six places to misread, up to eight, in order."""
    return _inputs(spark, sf).select("input_id", F.posexplode("variants").alias("at", "variant"))


def rules_applied(spark, sf):
    return _inputs(spark, sf).select(F.explode("applied").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def _tier(tier):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = tier(_inputs(spark, sf), matching.keyed(spread(tables.catalog(spark, sf))))
        return matching.ranked(found)

    return run


match_exact, match_variant, match_prefix, match_base = map(_tier, (matching.exact, matching.variant, matching.prefix, matching.base_part))


def match_tiers(spark, sf):
    """Candidates of the four tiers of equalities, each for what the ones before left."""
    found, _ = matching.cascade(tables.requests(spark, sf), tables.catalog(spark, sf), with_fuzzy=False)
    return found


def match_cascade(spark, sf):
    return rounded(matching.cascade(tables.requests(spark, sf), tables.catalog(spark, sf))[0], "confidence")


def match_near_miss(spark, sf):
    return rounded(matching.cascade(tables.requests(spark, sf), tables.catalog(spark, sf))[1], "confidence")


def matcher_accuracy(spark, sf):
    r = tables.requests(spark, sf)
    found, _ = matching.cascade(r, tables.catalog(spark, sf), with_fuzzy=False)
    return rounded(matching.accuracy(r, found), "top1", "top3", "false_positive")


def matcher_accuracy_all_tiers(spark, sf):
    """As matcher_accuracy, which has SQL and so no fuzzy tier, with all five tiers."""
    r = tables.requests(spark, sf)
    found, _ = matching.cascade(r, tables.catalog(spark, sf))
    return rounded(matching.accuracy(r, found), "top1", "top3", "false_positive")


def spec_spread(spark, sf):
    return spec.weights(spec.spread(spec.long_specs(tables.catalog(spark, sf)))).drop("parts")


def alternates(spark, sf):
    """Stand-ins for every part that is no longer made."""
    c = tables.catalog(spark, sf)
    return rounded(spec.alternates(c, c.where(risk.is_dead(F.col("lifecycle_status")))), "similarity")


def spec_intersection(spark, sf):
    return spec.shared_fields(tables.catalog(spark, sf))


def _risk_rows(spark, sf):
    """Every catalog part with the heat of its maker's series and a confidence."""
    from quotemill.operators import pricing

    heat = pricing.heat_latest(pricing.weekly(tables.quotes(spark, sf))).select(F.col("part_mpn").alias("manufacturer"), "volatility_flag")
    c = tables.catalog(spark, sf).join(heat, "manufacturer", "left")
    turn = F.col("part_id") % 7
    confidence = F.when(turn == 0, 0.79).when(turn == 1, 0.8).otherwise(1.0)
    rows = c.withColumns({"confidence": confidence, "matched_mpn": F.when(F.col("part_id") % 13 != 0, F.col("mpn"))})
    return risk.assessed(rows, F.lit(TODAY).cast("date"))


def risk_scores(spark, sf):
    out = _risk_rows(spark, sf)
    return out.select(
        "mpn", "risk_score", F.col("test.title").alias("recommendation"), F.col("test.hours").alias("hours"),
        F.col("test.approaching_target").alias("approaching_target"), F.array_join("test.methods", "|").alias("methods"),
    )


def risk_reasons(spark, sf):
    out = _risk_rows(spark, sf)
    return out.select("mpn", F.explode("risk_reasons").alias("r")).select("mpn", "r.code", "r.points", "r.label")


def band_methods_diff(spark, sf):
    """The methods that the band of catalog parts adds to the one below, and for how many parts."""
    rows = [(title, risk.METHODS[:n], risk.METHODS[: (risk.BANDS[i - 1][4] if i else 0)]) for i, (_, title, _, _, n) in enumerate(risk.BANDS)]
    bands = spark.createDataFrame(rows, "band string, methods array<string>, below array<string>")
    parts = _risk_rows(spark, sf).where("risk_score IS NOT NULL").groupBy(F.col("test.title").alias("band")).agg(F.count("*").alias("parts"))
    return bands.select("band", F.explode(F.array_except("methods", "below")).alias("method")).join(parts, "band")


def verify_catalog(spark, sf):
    return verify.catalog_counts(tables.catalog(spark, sf))


def catalog_summary(spark, sf):
    return rounded(verify.catalog_summary(tables.catalog(spark, sf)), "share")


def _rfqs(spark, sf):
    o = tables.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("rfq_id"), F.concat(F.lit("Request "), F.col("o_orderkey").cast("string"), F.lit(": "), F.repeat(F.concat(F.col("o_orderpriority"), F.lit(" ")), F.lit(20))).alias("raw_input"),
        F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "email").otherwise("spreadsheet").alias("source_type"),
        F.col("o_orderdate").cast("date").alias("created_at"),
    )


def _lines(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("rfq_id"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("matched_mpn"), (F.col("l_discount") * 10).alias("confidence"),
        F.when(F.col("l_tax") > 0.06, "VOLATILE").when(F.col("l_tax") > 0.04, "ELEVATED").otherwise("STABLE").alias("volatility_flag"),
        (F.col("l_quantity") * 2).cast("int").alias("risk_score"), F.col("l_extendedprice").alias("price_p50"), "l_suppkey",
    )


def rfq_list(spark, sf):
    return requests.listed(_rfqs(spark, sf), _lines(spark, sf), 20, 40)


def rfq_detail(spark, sf):
    return requests.detail(_lines(spark, sf), 7).select("line_no", "quantity", "matched_mpn")


def rfq_total(spark, sf):
    return _rfqs(spark, sf).agg(F.count("*").alias("total"))


def line_cap(spark, sf):
    """The first three lines of each request."""
    return requests.capped(_lines(spark, sf), 3).groupBy("rfq_id").agg(F.count("*").alias("lines"), F.max("line_no").alias("last_line"))


def panel_counts(spark, sf):
    return requests.panel(_lines(spark, sf))


def line_item_sink(spark, sf):
    """Lines as stored: prices of nothing are null, reasons are JSON."""
    reasons = F.array(F.struct(F.col("volatility_flag").alias("code"), F.col("risk_score").alias("points")))
    lines = _lines(spark, sf).withColumns({"risk_reasons": reasons, "price_p50": F.when(F.col("line_no") == 1, 0.0).otherwise(F.col("price_p50"))})
    return requests.stored(lines).select("rfq_id", "line_no", "l_suppkey", "price_p50", "risk_reasons")


def union_dedupe(spark, sf):
    """Two feeds of the catalog, one after the other; the first row of a number stays."""
    c = tables.catalog(spark, sf).select("mpn", "category")
    both = c.withColumn("feed", F.lit(1)).unionByName(c.withColumn("feed", F.lit(2)).withColumn("category", F.lower("category")))
    return sampling.first_by_key(both, "mpn", "feed").groupBy("feed", "category").agg(F.count("*").alias("parts"))


def integrity_checks(spark, sf):
    """Requests whose part is in the catalog, isn't, and that name none."""
    r, c = tables.requests(spark, sf), tables.catalog(spark, sf).select(F.col("mpn").alias("expected_mpn"))
    known = r.where("expected_mpn IS NOT NULL")
    counts = [
        (known.join(c, "expected_mpn", "left_semi"), "found"), (known.join(c, "expected_mpn", "left_anti"), "missing"),
        (r.where("expected_mpn IS NULL"), "none"),
    ]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for df, name in counts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def stratified_sample(spark, sf):
    """Two hundred parts, half of them dead."""
    return sampling.stratified(tables.catalog(spark, sf), 200).select("mpn", "lifecycle_status")


def part_details(spark, sf):
    """The part that each printed number names: the one printed so, else the best of its key. Every request's text is asked."""
    asked = tables.requests(spark, sf).select("input_id", "input_string")
    return requests.details(asked, tables.catalog(spark, sf)).select("input_id", "mpn", "manufacturer", "lifecycle_status")


def price_labels(spark, sf):
    """Prices of catalog parts, scaled to all sizes, as they are shown."""
    price = F.col("p_retailprice") / F.element_at(F.array(F.lit(1.0), F.lit(1000.0), F.lit(100000.0)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return tables.table(spark, sf, "part").select("p_partkey", F.regexp_replace(units.price_label(price), ",", "").try_cast("double").alias("shown"))


def price_tier(spark, sf):
    price = F.col("p_retailprice") / F.element_at(F.array(*map(F.lit, (1.0, 50.0, 500.0, 5000.0, 50000.0))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return tables.table(spark, sf, "part").select(units.price_tier(price).alias("tier")).groupBy("tier").agg(F.count("*").alias("parts"))


def sheet_letters(spark, sf):
    return tables.table(spark, sf, "part").select("p_partkey", units.column_letter(F.col("p_partkey").cast("int")).alias("letters"))


def _analysis(spark: SparkSession, sf: str, with_fuzzy: bool) -> DataFrame:
    out = requests.analyzed(tables.requests(spark, sf), tables.catalog(spark, sf), tables.quotes(spark, sf), F.lit(TODAY).cast("date"), with_fuzzy)
    return out.select(
        "input_id", "input_string", "matched_mpn", "match_method", "confidence", "candidates", "manufacturer", "category",
        F.round("price_p50", 9).alias("price_p50"), F.round("forecast_price", 9).alias("forecast_price"), "volatility_flag",
        "risk_score", F.col("test.title").alias("test_recommendation"), F.size("risk_reasons").alias("n_reasons"),
    )


def analyze(spark: SparkSession, sf: str) -> DataFrame:
    """Match by the four tiers of equalities, which SQL can say, price, heat and risk of every request."""
    return _analysis(spark, sf, with_fuzzy=False)


def analyze_all_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Match by all five tiers, price, heat and risk of every request."""
    return _analysis(spark, sf, with_fuzzy=True)


def _listed(name: str, *fields: str) -> Column:
    """A list of a few as one text; shares as whole millionths."""
    shown = lambda r: F.concat_ws(":", *[F.round(r[f] * 1e6).cast("long").cast("string") if f in ("confidence", "similarity") else r[f].cast("string") for f in fields])
    return F.array_join(F.transform(name, shown), "|").alias(name)


def _whole(spark: SparkSession, sf: str, with_fuzzy: bool, model: str = "naive") -> DataFrame:
    out = requests.analyzed_whole(tables.requests(spark, sf), tables.catalog(spark, sf), tables.quotes(spark, sf), F.lit(TODAY).cast("date"), tables.brands(spark, sf), model, with_fuzzy)
    return out.select(
        "input_id", "normalized_key", F.size("rules_applied").alias("n_rules"), "matched_mpn", "description", "match_method",
        _listed("candidates", "mpn", "confidence", "method"), _listed("near_misses", "mpn", "confidence"), _listed("alternates", "mpn", "manufacturer", "similarity"),
        F.round("price_p50", 9).alias("price_p50"), F.round("forecast_price", 9).alias("forecast_price"), "forecast_model", "volatility_flag", "risk_score",
    )


def analyze_whole(spark, sf):
    """Every request with all that is told of it, by the tiers that SQL can say, which have no near misses."""
    return _whole(spark, sf, with_fuzzy=False)


def analyze_whole_all_tiers(spark, sf):
    """Every request with all that is told of it, by all tiers, near misses for those of no match."""
    return _whole(spark, sf, with_fuzzy=True)


def analyze_by_arima(spark, sf):
    """Every request, priced by an autoregressive forecast of its part's series."""
    return _whole(spark, sf, with_fuzzy=False, model="arima").select("input_id", "matched_mpn", "forecast_price", "forecast_model")


def part_details_whole(spark, sf):
    """Every request's part with its series' band, forecast and last year, and its stand-ins."""
    asked = tables.requests(spark, sf).select("input_id", "input_string")
    out = requests.details_whole(asked, tables.catalog(spark, sf), tables.quotes(spark, sf), tables.brands(spark, sf))
    week = lambda h: F.concat_ws(":", h["week_start"].cast("string"), F.round(h["p50"] * 1e4).cast("long").cast("string"), h["quotes"].cast("string"))
    return out.select(
        "input_id", "mpn", "manufacturer", F.round("price_p25", 9).alias("price_p25"), F.round("forecast_price", 9).alias("forecast_price"), "volatility_flag",
        F.array_join(F.transform("history", week), "|").alias("history"), _listed("alternates", "mpn", "manufacturer", "similarity"),
    )


def _overridden(spark: SparkSession, sf: str, analysis: DataFrame) -> DataFrame:
    lines = analysis.select("input_id", "matched_mpn", "match_method", "confidence")
    chosen = tables.catalog(spark, sf).where("authorized_stock > 0").agg(F.min("mpn").alias("chosen_matched_mpn"))
    picks = lines.where("matched_mpn IS NULL").select("input_id").crossJoin(F.broadcast(chosen))
    return requests.overridden(lines, picks)


def apply_overrides(spark, sf):
    """Requests that no equality matches, for which a person chose the stocked part of least number."""
    return _overridden(spark, sf, analyze(spark, sf))


def apply_overrides_all_tiers(spark, sf):
    """Requests that none of the five tiers matches, for which a person chose the stocked part of least number."""
    return _overridden(spark, sf, analyze_all_tiers(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_inputs, input_variants, rules_applied, match_tiers, match_cascade, match_near_miss, matcher_accuracy, spec_spread,
        alternates, spec_intersection, risk_scores, risk_reasons, band_methods_diff, verify_catalog, catalog_summary, rfq_list,
        rfq_detail, rfq_total, line_cap, panel_counts, line_item_sink, union_dedupe, integrity_checks, stratified_sample,
        price_labels, price_tier, sheet_letters, part_details, analyze, apply_overrides, matcher_accuracy_all_tiers, analyze_all_tiers,
        apply_overrides_all_tiers, analyze_whole, analyze_whole_all_tiers, analyze_by_arima, part_details_whole,
    )
} | {"match_exact": match_exact, "match_variant": match_variant, "match_prefix": match_prefix, "match_base": match_base}

_NORMAL = f"WITH {CATALOG}, {REQUESTS}, {part_numbers.normalized_sql('requests')}"
_PARTS = f"""
parts AS (
  SELECT *, CASE WHEN length(part_key) >= 8 THEN left(part_key, length(part_key) - length(regexp_extract(part_key, '{part_numbers.GRADED}', 2)))
            ELSE part_key END AS part_base
  FROM (SELECT *, regexp_replace(upper(mpn), '{part_numbers.SEPARATORS}', '', 'g') AS part_key FROM catalog)
), inputs AS (SELECT n.*, r.input_string FROM normalized n JOIN requests r USING (input_id))"""
_READINGS = """
pos AS (
  SELECT input_id, key, list_filter(range(1, length(key) + 1), lambda i: substr(key, i, 1) IN ('O', '0', 'I', '1')) AS p FROM inputs
), masks AS (
  SELECT input_id, key, p, unnest(range(1, 1 << len(p))) AS m FROM pos WHERE len(p) BETWEEN 1 AND 6
), readings AS (
  SELECT input_id, reading, row_number() OVER (PARTITION BY input_id ORDER BY reading) - 1 AS "at" FROM (
    SELECT input_id, array_to_string(list_transform(range(1, length(key) + 1), lambda i:
      CASE WHEN list_contains(p, i) AND (m >> (list_position(p, i) - 1)) & 1 = 1
        THEN CASE substr(key, i, 1) WHEN 'O' THEN '0' WHEN '0' THEN 'O' WHEN 'I' THEN '1' ELSE 'I' END
        ELSE substr(key, i, 1) END), '') AS reading FROM masks) QUALIFY "at" < 8
)"""
_RANK = """row_number() OVER (PARTITION BY input_id ORDER BY upper(mpn) <> upper(trim(input_string)),
  lifecycle_status IN ('Obsolete', 'EOL'), authorized_stock = 0, mpn)"""
_EXACT = "exact AS (SELECT input_id, input_string, p.*, 1.0 AS confidence, 'exact' AS method FROM inputs i JOIN parts p ON i.key = p.part_key)"
_VARIANT = """variant AS (
  SELECT i.input_id, i.input_string, p.*, 0.95 AS confidence, 'confusable_variant' AS method
  FROM readings r JOIN parts p ON r.reading = p.part_key JOIN inputs i ON i.input_id = r.input_id
  QUALIFY r."at" = min(r."at") OVER (PARTITION BY i.input_id))"""
_PREFIX = """prefix AS (
  SELECT input_id, input_string, p.*, 0.85 AS confidence, 'prefix' AS method FROM inputs i JOIN parts p ON starts_with(p.part_key, i.key)
  WHERE length(i.key) >= 6 QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY part_key, mpn) <= 10)"""
_BASE = """graded AS (
  SELECT input_id, input_string, p.*, 0.85 AS confidence, 'base_part' AS method FROM inputs i JOIN parts p ON i.key = p.part_base
  WHERE p.part_base <> p.part_key
), base AS (
  SELECT * FROM graded UNION ALL
  SELECT input_id, input_string, p.*, 0.85, 'base_part' FROM inputs i JOIN parts p ON i.base_key = p.part_key
  WHERE i.base_key <> i.key AND input_id NOT IN (SELECT input_id FROM graded))"""


def _ranked(source: str) -> str:
    return f"""SELECT input_id, CAST(rank AS INT) AS rank, mpn, CAST(confidence AS DOUBLE) AS confidence, method
FROM (SELECT *, {_RANK} AS rank FROM {source}) WHERE rank <= 10"""


_TIERS = f"""{_NORMAL}, {_PARTS}, {_READINGS}, {_EXACT}, {_VARIANT}, {_PREFIX}, {_BASE}, left1 AS (
  SELECT * FROM variant WHERE input_id NOT IN (SELECT input_id FROM exact)
), left2 AS (
  SELECT * FROM prefix WHERE input_id NOT IN (SELECT input_id FROM exact UNION ALL SELECT input_id FROM left1)
), left3 AS (
  SELECT * FROM base WHERE input_id NOT IN (SELECT input_id FROM exact UNION ALL SELECT input_id FROM left1 UNION ALL SELECT input_id FROM left2)
), hits AS (SELECT * FROM exact UNION ALL SELECT * FROM left1 UNION ALL SELECT * FROM left2 UNION ALL SELECT * FROM left3),
tiers AS ({_ranked("hits")})"""
_LATEST = f"""latest AS (
  SELECT part_mpn, arg_max(p50, week_start) AS forecast_price, avg(dispersion) FILTER (WHERE k <= 8) AS now,
         quantile_cont(dispersion, 0.5) FILTER (WHERE k <= 52) AS base
  FROM (SELECT *, row_number() OVER (PARTITION BY part_mpn ORDER BY week_start DESC) AS k FROM weekly) GROUP BY part_mpn
), flagged AS (
  SELECT *, {FLAG} AS volatility_flag FROM (SELECT *, CASE WHEN base >= 1e-4 THEN now / base ELSE 1.0 END AS heat_index FROM latest)
)"""
_RISKS = f"""
risks AS (
  SELECT *, [CASE WHEN lifecycle_status IN ('Obsolete', 'EOL') THEN {{'code': 'lifecycle', 'points': 30, 'label': lifecycle_status}} END,
    CASE WHEN authorized_stock <= 0 THEN {{'code': 'no_authorized_stock', 'points': 20, 'label': 'No authorized stock'}} END,
    CASE WHEN volatility_flag = 'VOLATILE' THEN {{'code': 'market_volatile', 'points': 15, 'label': 'Volatile market'}} END,
    CASE WHEN volatility_flag = 'ELEVATED' THEN {{'code': 'market_elevated', 'points': 8, 'label': 'Elevated market'}} END,
    CASE WHEN is_defense_grade OR contains(category, 'MIL-Spec') THEN {{'code': 'defense_grade', 'points': 15, 'label': 'Defense / aerospace grade'}} END,
    CASE WHEN age > 15 THEN {{'code': 'aged_part', 'points': 10, 'label': 'Introduced ' || CAST(CAST(round_even(age, 0) AS INT) AS VARCHAR) || ' years ago'}} END,
    CASE WHEN confidence < 0.8 THEN {{'code': 'low_confidence', 'points': 10, 'label': 'Uncertain part match'}} END] AS all_reasons
  FROM (SELECT *, date_diff('day', TRY_CAST(left(date_introduced, 10) AS DATE), DATE '{TODAY}') / 365.25 AS age FROM lines)
), scored AS (
  SELECT *, list_filter(all_reasons, lambda r: r IS NOT NULL) AS reasons FROM risks
), summed AS (
  SELECT *, CASE WHEN matched_mpn IS NOT NULL THEN CAST(least(100, coalesce(list_sum(list_transform(reasons, lambda r: r.points)), 0)) AS INT) END AS risk_score FROM scored
)"""
_TITLE = "CASE WHEN risk_score <= 25 THEN 'Standard' WHEN risk_score <= 55 THEN 'Enhanced' WHEN risk_score IS NOT NULL THEN 'Full AS6171' END"
_CATALOG_LINES = f"""WITH {CATALOG}, {QUOTES}, {WEEKLY}, {_LATEST}, lines AS (
  SELECT c.*, volatility_flag, CASE part_id % 7 WHEN 0 THEN 0.79 WHEN 1 THEN 0.8 ELSE 1.0 END AS confidence,
         CASE WHEN part_id % 13 <> 0 THEN mpn END AS matched_mpn
  FROM catalog c LEFT JOIN flagged f ON f.part_mpn = c.manufacturer
), {_RISKS}"""
_ANALYZE = f"""{_TIERS}, {QUOTES}, {WEEKLY}, {BAND}, {_LATEST}, counts AS (SELECT input_id, count(*) AS n FROM tiers GROUP BY 1), lines AS (
  SELECT r.input_id, r.input_string, t.mpn AS matched_mpn, coalesce(t.method, 'no_match') AS match_method, coalesce(t.confidence, 0) AS confidence,
         coalesce(k.n, 0) AS candidates, c.manufacturer, c.category, c.lifecycle_status, c.authorized_stock, c.is_defense_grade, c.date_introduced,
         b.p50 AS price_p50, f.forecast_price, f.volatility_flag
  FROM requests r LEFT JOIN tiers t ON t.input_id = r.input_id AND t.rank = 1 LEFT JOIN counts k ON k.input_id = r.input_id
  LEFT JOIN catalog c ON c.mpn = t.mpn LEFT JOIN band b ON b.part_mpn = c.manufacturer LEFT JOIN flagged f ON f.part_mpn = c.manufacturer
), {_RISKS}, analyzed AS (
  SELECT input_id, input_string, matched_mpn, match_method, confidence, candidates, manufacturer, category, round(price_p50, 9) AS price_p50,
         round(forecast_price, 9) AS forecast_price, volatility_flag, risk_score, {_TITLE} AS test_recommendation,
         CASE WHEN matched_mpn IS NOT NULL THEN CAST(len(reasons) AS INT) END AS n_reasons FROM summed)"""
_SPECS = """specs AS (
  SELECT category, mpn, 'size' AS field, spec_size AS value FROM catalog UNION ALL
  SELECT category, mpn, 'price', spec_price FROM catalog UNION ALL
  SELECT category, mpn, 'weight', spec_weight FROM catalog WHERE spec_weight IS NOT NULL
), spread AS (
  SELECT category, field, CASE WHEN hi - lo > 0 THEN hi - lo ELSE coalesce(nullif(abs(v[-1] - v[1]), 0), nullif(abs(v[1]), 0), 1.0) END AS spread, 1.0 AS weight
  FROM (SELECT category, field, v, v[len(v) // 4 + 1] AS lo, v[3 * len(v) // 4 + 1] AS hi
        FROM (SELECT category, field, list(value ORDER BY value) AS v FROM specs GROUP BY ALL HAVING count(*) >= 2)))"""
#: Stand-ins of every part that `wanted` names.
_ALTERNATES = """far AS (
  SELECT a.mpn, b.mpn AS alternate, sum(least(abs(a.value - b.value) / coalesce(s.spread, 1.0), 4.0)) / count(*) AS distance
  FROM specs a JOIN specs b ON a.category = b.category AND a.field = b.field AND a.mpn <> b.mpn
  LEFT JOIN spread s ON s.category = a.category AND s.field = a.field WHERE a.mpn IN (SELECT mpn FROM wanted) GROUP BY ALL
), totals AS (
  SELECT f.mpn, alternate, c.manufacturer, c.lifecycle_status, c.authorized_stock, distance + CASE WHEN c.lifecycle_status IN ('Obsolete', 'EOL') THEN 0.6::DOUBLE ELSE 0 END
         + CASE WHEN c.authorized_stock = 0 THEN 0.2::DOUBLE ELSE 0 END AS total
  FROM far f JOIN catalog c ON c.mpn = f.alternate JOIN catalog o ON o.mpn = f.mpn WHERE c.manufacturer <> o.manufacturer
), placed AS (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY round(total, 9), alternate) AS rank FROM totals)"""
_LISTED = """listed AS (
  SELECT mpn, string_agg(alternate || ':' || manufacturer || ':' || CAST(CAST(round(1e6 / (1 + total)) AS BIGINT) AS VARCHAR), '|' ORDER BY rank) AS alternates
  FROM placed WHERE rank <= 5 GROUP BY mpn)"""
_RFQS = """rfqs AS (
  SELECT o_orderkey AS rfq_id, 'Request ' || CAST(o_orderkey AS VARCHAR) || ': ' || repeat(o_orderpriority || ' ', 20) AS raw_input,
         CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'email' ELSE 'spreadsheet' END AS source_type, CAST(o_orderdate AS DATE) AS created_at
  FROM orders)"""
_LABEL = "CAST(CASE WHEN p >= 1 THEN printf('%.2f', p) WHEN p >= 0.01 THEN printf('%.3f', p) ELSE printf('%.4f', p) END AS DOUBLE)"
SQL = {
    "normalize_inputs": f"{_NORMAL} SELECT input_id, display, key, grade, base_key FROM normalized",
    "input_variants": f"{_NORMAL}, {_PARTS}, {_READINGS} SELECT input_id, CAST(\"at\" AS INT) AS \"at\", reading AS variant FROM readings",
    "match_exact": f"{_NORMAL}, {_PARTS}, {_EXACT} {_ranked('exact')}",
    "match_variant": f"{_NORMAL}, {_PARTS}, {_READINGS}, {_VARIANT} {_ranked('variant')}",
    "match_prefix": f"{_NORMAL}, {_PARTS}, {_PREFIX} {_ranked('prefix')}",
    "match_base": f"{_NORMAL}, {_PARTS}, {_BASE} {_ranked('base')}",
    "match_tiers": f"{_TIERS} SELECT * FROM tiers",
    "matcher_accuracy": f"""{_TIERS}, h AS (
  SELECT r.input_id, min(t.rank) FILTER (WHERE t.mpn = r.expected_mpn) AS hit, count(t.mpn) AS found
  FROM requests r LEFT JOIN tiers t USING (input_id) GROUP BY 1)
SELECT kind, count(*) AS n, round(avg(CASE WHEN expected_mpn IS NOT NULL THEN CAST(coalesce(hit, 99) <= 1 AS INT) END), 9) AS top1,
       round(avg(CASE WHEN expected_mpn IS NOT NULL THEN CAST(coalesce(hit, 99) <= 3 AS INT) END), 9) AS top3,
       round(avg(CASE WHEN expected_mpn IS NULL THEN CAST(found > 0 AS INT) END), 9) AS false_positive
FROM requests JOIN h USING (input_id) GROUP BY kind""",
    "spec_spread": f"WITH {CATALOG}, {_SPECS} SELECT category, field, spread, CAST(weight AS DOUBLE) AS weight FROM spread",
    "alternates": f"""WITH {CATALOG}, {_SPECS}, far AS (
  SELECT a.mpn, b.mpn AS alternate, sum(least(abs(a.value - b.value) / coalesce(s.spread, 1.0), 4.0)) / count(*) AS distance
  FROM specs a JOIN specs b ON a.category = b.category AND a.field = b.field AND a.mpn <> b.mpn
  LEFT JOIN spread s ON s.category = a.category AND s.field = a.field
  WHERE a.mpn IN (SELECT mpn FROM catalog WHERE lifecycle_status IN ('Obsolete', 'EOL')) GROUP BY ALL
), t AS (
  SELECT f.mpn, alternate, c.lifecycle_status, c.authorized_stock, distance + CASE WHEN c.lifecycle_status IN ('Obsolete', 'EOL') THEN 0.6::DOUBLE ELSE 0 END
         + CASE WHEN c.authorized_stock = 0 THEN 0.2::DOUBLE ELSE 0 END AS total
  FROM far f JOIN catalog c ON c.mpn = f.alternate JOIN catalog o ON o.mpn = f.mpn WHERE c.manufacturer <> o.manufacturer
), k AS (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY round(total, 9), alternate) AS rank FROM t)
SELECT mpn, CAST(rank AS INT) AS rank, alternate, lifecycle_status, authorized_stock, round(1 / (1 + total), 9) AS similarity FROM k WHERE rank <= 5""",
    "analyze_whole": f"""{_ANALYZE}, {_SPECS}, wanted AS (SELECT mpn FROM tiers WHERE rank = 1), {_ALTERNATES}, {_LISTED}, three AS (
  SELECT input_id, string_agg(mpn || ':' || CAST(CAST(round(confidence * 1e6) AS BIGINT) AS VARCHAR) || ':' || method, '|' ORDER BY rank) AS candidates
  FROM tiers WHERE rank <= 3 GROUP BY input_id), fired AS (
  SELECT input_id, (CASE WHEN s0 <> s1 THEN 1 ELSE 0 END) + (CASE WHEN s1 <> s2 THEN 1 ELSE 0 END) + (CASE WHEN s2 <> s3 THEN 1 ELSE 0 END) + (CASE WHEN s3 <> s4 THEN 1 ELSE 0 END)
    + (CASE WHEN s4 <> key THEN 1 ELSE 0 END) + (CASE WHEN grade <> '' THEN 1 ELSE 0 END) + (CASE WHEN input_id IN (SELECT input_id FROM readings) THEN 1 ELSE 0 END) AS n_rules
  FROM (SELECT input_id, input_string AS s0, n0.t AS s1, n2.t AS s2, n6.t AS s3, stub.display AS s4, key, grade
        FROM requests JOIN n0 USING (input_id) JOIN n2 USING (input_id) JOIN n6 USING (input_id) JOIN stub USING (input_id) JOIN normalized USING (input_id)))
SELECT a.input_id, n.key AS normalized_key, CAST(n_rules AS INT) AS n_rules, matched_mpn, c.description, match_method, coalesce(t.candidates, '') AS candidates, '' AS near_misses,
       coalesce(l.alternates, '') AS alternates, price_p50, forecast_price, CASE WHEN forecast_price IS NOT NULL THEN 'naive' END AS forecast_model, volatility_flag, risk_score
FROM analyzed a JOIN normalized n USING (input_id) JOIN fired USING (input_id) LEFT JOIN three t USING (input_id) LEFT JOIN listed l ON l.mpn = a.matched_mpn LEFT JOIN catalog c ON c.mpn = a.matched_mpn""",
    "part_details_whole": f"""WITH {CATALOG}, {REQUESTS}, {QUOTES}, {WEEKLY}, {BAND}, {_LATEST}, {_SPECS}, parts AS (
  SELECT *, regexp_replace(upper(mpn), '{part_numbers.SEPARATORS}', '', 'g') AS part_key FROM catalog
), chosen AS (
  SELECT r.input_id, p.*, row_number() OVER (PARTITION BY r.input_id ORDER BY upper(mpn) <> upper(input_string), lifecycle_status IN ('Obsolete', 'EOL'), authorized_stock = 0, mpn) AS k
  FROM requests r JOIN parts p ON p.part_key = regexp_replace(upper(input_string), '{part_numbers.SEPARATORS}', '', 'g') QUALIFY k = 1
), wanted AS (SELECT mpn FROM chosen), {_ALTERNATES}, {_LISTED}, told AS (
  SELECT part_mpn, string_agg(CAST(CAST(week_start AS DATE) AS VARCHAR) || ':' || CAST(CAST(round(p50 * 1e4) AS BIGINT) AS VARCHAR) || ':' || CAST(quotes AS VARCHAR), '|' ORDER BY week_start) AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY part_mpn ORDER BY week_start DESC) AS k FROM weekly) WHERE k <= 52 GROUP BY part_mpn)
SELECT input_id, ch.mpn, manufacturer, round(b.p25, 9) AS price_p25, round(f.forecast_price, 9) AS forecast_price, f.volatility_flag,
       coalesce(told.history, '') AS history, coalesce(l.alternates, '') AS alternates
FROM chosen ch LEFT JOIN band b ON b.part_mpn = ch.manufacturer LEFT JOIN flagged f ON f.part_mpn = ch.manufacturer
LEFT JOIN told ON told.part_mpn = ch.manufacturer LEFT JOIN listed l ON l.mpn = ch.mpn""",
    "spec_intersection": f"""WITH {CATALOG}, {_SPECS} SELECT category, field FROM specs GROUP BY category, field
HAVING count(*) = (SELECT count(*) FROM catalog c WHERE c.category = specs.category)""",
    "risk_scores": f"""{_CATALOG_LINES} SELECT mpn, risk_score, {_TITLE} AS recommendation,
  CASE WHEN risk_score <= 25 THEN 4 WHEN risk_score <= 55 THEN 12 WHEN risk_score IS NOT NULL THEN 36 END AS hours,
  CASE WHEN risk_score IS NOT NULL THEN risk_score > 55 END AS approaching_target,
  array_to_string(CASE WHEN risk_score <= 25 THEN {risk.METHODS[:2]!r} WHEN risk_score <= 55 THEN {risk.METHODS[:5]!r}
    WHEN risk_score IS NOT NULL THEN {risk.METHODS!r} END, '|') AS methods FROM summed""",
    "risk_reasons": f"{_CATALOG_LINES}, e AS (SELECT mpn, unnest(reasons) AS r FROM summed WHERE matched_mpn IS NOT NULL) SELECT mpn, r.code AS code, r.points AS points, r.label AS label FROM e",
    "verify_catalog": f"""WITH {CATALOG} SELECT count(*) AS parts, count(DISTINCT category) AS categories, count(DISTINCT manufacturer) AS manufacturers,
  count(*) FILTER (WHERE lifecycle_status IN ('Obsolete', 'EOL')) AS dead_parts, count(*) FILTER (WHERE is_defense_grade) AS defense_parts,
  count(*) FILTER (WHERE authorized_stock > 0) AS stocked_parts, string_agg(DISTINCT category, ',' ORDER BY category) AS category_list FROM catalog""",
    "catalog_summary": f"""WITH {CATALOG} SELECT category, count(*) AS parts, CAST(sum(authorized_stock) AS BIGINT) AS stock,
  round(count(*) / sum(count(*)) OVER (), 9) AS share FROM catalog GROUP BY category""",
    "rfq_list": f"""WITH {_RFQS}, page AS (SELECT * FROM rfqs ORDER BY created_at DESC, rfq_id DESC LIMIT 20 OFFSET 40)
SELECT rfq_id, left(raw_input, 120) AS preview, source_type, created_at, count(l_orderkey) AS line_count,
       count(*) FILTER (WHERE l_returnflag <> 'R') AS matched_count FROM page LEFT JOIN lineitem ON l_orderkey = rfq_id GROUP BY ALL""",
    "rfq_detail": """SELECT l_linenumber AS line_no, CAST(l_quantity AS INT) AS quantity, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS matched_mpn
FROM lineitem WHERE l_orderkey = 7""",
    "rfq_total": "SELECT count(*) AS total FROM orders",
    "line_cap": """SELECT l_orderkey AS rfq_id, count(*) AS lines, max(l_linenumber) AS last_line FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1""",
    "panel_counts": """SELECT count(*) AS lines, count(*) FILTER (WHERE l_returnflag <> 'R') AS matched, count(*) FILTER (WHERE l_discount * 10 < 0.7) AS needs_review,
  count(*) FILTER (WHERE l_tax > 0.04) AS hot, count(*) FILTER (WHERE CAST(l_quantity * 2 AS INT) > 55) AS full_test FROM lineitem""",
    "line_item_sink": """SELECT l_orderkey AS rfq_id, l_linenumber AS line_no, l_suppkey, CASE WHEN l_linenumber <> 1 AND l_extendedprice > 0 THEN l_extendedprice END AS price_p50,
  '[{"code":"' || CASE WHEN l_tax > 0.06 THEN 'VOLATILE' WHEN l_tax > 0.04 THEN 'ELEVATED' ELSE 'STABLE' END || '","points":'
  || CAST(CAST(l_quantity * 2 AS INT) AS VARCHAR) || '}]' AS risk_reasons FROM lineitem""",
    "union_dedupe": f"""WITH {CATALOG}, u AS (
  SELECT mpn, category, 1 AS feed FROM catalog UNION ALL SELECT mpn, lower(category), 2 FROM catalog
), k AS (SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY feed) AS k FROM u)
SELECT feed, category, count(*) AS parts FROM k WHERE k = 1 GROUP BY feed, category""",
    "integrity_checks": f"""WITH {CATALOG}, {REQUESTS}
SELECT 'found' AS "check", count(*) AS n FROM requests WHERE expected_mpn IN (SELECT mpn FROM catalog)
UNION ALL SELECT 'missing', count(*) FROM requests WHERE expected_mpn IS NOT NULL AND expected_mpn NOT IN (SELECT mpn FROM catalog)
UNION ALL SELECT 'none', count(*) FROM requests WHERE expected_mpn IS NULL""",
    "price_tier": """SELECT CASE WHEN p < 0.07 THEN 'jellybean' WHEN p < 0.67 THEN 'low' WHEN p < 4.2 THEN 'mid' WHEN p < 42 THEN 'high' ELSE 'premium' END AS tier,
  count(*) AS parts FROM (SELECT p_retailprice / [1.0, 50.0, 500.0, 5000.0, 50000.0][p_partkey % 5 + 1] AS p FROM part) GROUP BY 1""",
    "sheet_letters": """SELECT p_partkey, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INT)) ELSE '' END
  || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters
FROM (SELECT p_partkey, p_partkey + 1 AS n FROM part)""",
    "stratified_sample": f"""WITH {CATALOG}, k AS (
  SELECT mpn, lifecycle_status, lifecycle_status IN ('Obsolete', 'EOL') AS dead,
         row_number() OVER (PARTITION BY lifecycle_status IN ('Obsolete', 'EOL') ORDER BY md5(mpn || '7'), mpn) AS place FROM catalog)
SELECT mpn, lifecycle_status FROM k WHERE dead AND place <= 100 OR NOT dead AND place <= 200 - (SELECT count(*) FROM k WHERE dead AND place <= 100)""",
    "part_details": f"""WITH {CATALOG}, {REQUESTS}, {{parts}} SELECT input_id, mpn, manufacturer, lifecycle_status FROM (
  SELECT r.input_id, p.*, row_number() OVER (PARTITION BY r.input_id ORDER BY upper(mpn) <> upper(input_string), lifecycle_status IN ('Obsolete', 'EOL'),
         authorized_stock = 0, mpn) AS k FROM requests r JOIN parts p ON p.part_key = regexp_replace(upper(input_string), '{part_numbers.SEPARATORS}', '', 'g')) WHERE k = 1""".replace(
        "{parts}", "parts AS (SELECT *, regexp_replace(upper(mpn), '" + part_numbers.SEPARATORS + "', '', 'g') AS part_key FROM catalog)"
    ),
    "rules_applied": f"""WITH {CATALOG}, {REQUESTS}, {part_numbers.normalized_sql('requests')}, {_PARTS}, {_READINGS}, steps AS (
  SELECT input_id, input_string AS s0, n0.t AS s1, n2.t AS s2, n6.t AS s3, stub.display AS s4, key, grade, input_id IN (SELECT input_id FROM readings) AS confusable
  FROM requests JOIN n0 USING (input_id) JOIN n2 USING (input_id) JOIN n6 USING (input_id) JOIN stub USING (input_id) JOIN normalized USING (input_id)
), fired AS (
  SELECT unnest(list_filter([CASE WHEN s0 <> s1 THEN 'uppercase_and_collapse' END, CASE WHEN s1 <> s2 THEN 'strip_quantity_artefacts' END,
    CASE WHEN s2 <> s3 THEN 'strip_packaging_suffix' END, CASE WHEN s3 <> s4 THEN 'strip_distributor_prefix' END, CASE WHEN s4 <> key THEN 'normalize_separators' END,
    CASE WHEN grade <> '' THEN 'split_grade_suffix' END, CASE WHEN confusable THEN 'confusable_variants' END], lambda r: r IS NOT NULL)) AS rule FROM steps)
SELECT rule, count(*) AS n FROM fired GROUP BY rule""",
    "price_labels": f"""SELECT p_partkey, {_LABEL} AS shown FROM (SELECT p_partkey, p_retailprice / [1.0, 1000.0, 100000.0][p_partkey % 3 + 1] AS p FROM part)""",
    "band_methods_diff": f"{_CATALOG_LINES}, banded AS (SELECT {_TITLE} AS band, count(*) AS parts FROM summed WHERE risk_score IS NOT NULL GROUP BY 1) SELECT band, method, parts FROM banded JOIN (VALUES "
    + ", ".join(f"('{t}', '{m}')" for i, (_, t, _, _, n) in enumerate(risk.BANDS) for m in risk.METHODS[(risk.BANDS[i - 1][4] if i else 0) : n])
    + ") AS t(band, method) USING (band)",
    "analyze": f"{_ANALYZE} SELECT * FROM analyzed",
    "apply_overrides": f"""{_ANALYZE}, pick AS (SELECT min(mpn) AS mpn FROM catalog WHERE authorized_stock > 0)
SELECT input_id, coalesce(matched_mpn, mpn) AS matched_mpn, CASE WHEN matched_mpn IS NULL THEN 'exact' ELSE match_method END AS match_method,
       CASE WHEN matched_mpn IS NULL THEN 1.0 ELSE confidence END AS confidence FROM analyzed, pick""",
}
