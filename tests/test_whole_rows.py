"""Whole rows of the analysis by all five tiers, against scoring every key; accuracy by value; forecasts by name."""

import pytest

from quotemill.functions import part_numbers, similarity
from quotemill.operators import forecast, matching, pricing, requests
from quotemill.plans import registry
from quotemill.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.input_id: r for r in registry.queries()["analyze_whole_all_tiers"](spark, SF).collect()}


def test_candidates_and_near_misses_against_every_key(spark, rows):
    parts = {}
    for r in matching.keyed(tables.catalog(spark, SF)).collect():
        parts.setdefault(r.part_key, []).append((r.lifecycle_status in ("Obsolete", "EOL"), r.mpn))
    asked = {r.input_id: r.key for r in part_numbers.normalized(tables.requests(spark, SF)).select("input_id", "key").collect()}
    equal = {r.input_id: r for r in registry.queries()["analyze_whole"](spark, SF).collect()}
    assert set(rows) == set(equal) == set(asked)
    seen = set()
    for i, row in rows.items():
        if equal[i].matched_mpn:
            assert row == equal[i]
            continue
        scored = sorted((-similarity.score(asked[i], k), k) for k in parts)[: matching.CANDIDATES]
        above = [(-s, k) for s, k in scored if -s >= matching.FUZZY_LEAST]
        found = sorted((-(0.5 + 0.3 * (s - 82) / 18), dead, mpn) for s, k in above for dead, mpn in parts[k])
        assert row.candidates == "|".join(f"{mpn}:{round(-c * 1e6)}:fuzzy" for c, _, mpn in found[:3])
        near = [] if above else [(-s, min(m for _, m in parts[k])) for s, k in scored[:3]]
        assert row.near_misses == "|".join(f"{mpn}:{round(s * 1e4)}" for s, mpn in near)
        assert row.match_method == ("fuzzy" if above else "no_match") and bool(row.alternates) <= bool(above)
        seen.add(row.match_method)
    assert seen == {"fuzzy", "no_match"}


def test_accuracy_by_value(spark, rows):
    want = {}
    for r in tables.requests(spark, SF).collect():
        found = [c.split(":")[0] for c in rows[r.input_id].candidates.split("|") if c]
        want.setdefault(r.kind, []).append((r.expected_mpn is not None, r.expected_mpn in found[:1], r.expected_mpn in found, bool(found)))
    got = registry.queries()["matcher_accuracy_all_tiers"](spark, SF).collect()
    assert {r.kind for r in got} == set(want)
    for r in got:
        known = [x for x in want[r.kind] if x[0]]
        assert r.n == len(want[r.kind])
        if known:
            assert r.top1 == pytest.approx(sum(x[1] for x in known) / len(known)) and r.top3 == pytest.approx(sum(x[2] for x in known) / len(known))
        else:
            assert r.false_positive == pytest.approx(sum(x[3] for x in want[r.kind]) / len(want[r.kind]))


def test_models_by_name(spark):
    weeks, parts = pricing.weekly(tables.quotes(spark, SF)), tables.brands(spark, SF)
    last = {r.part_mpn: r.forecast_price for r in pricing.naive(weeks).collect()}
    for model in forecast.MODELS:
        found = {r.part_mpn: r for r in forecast.forecasts(weeks, parts, model).collect()}
        assert found.keys() == last.keys() and all(r.forecast_price is not None for r in found.values())
        assert all(r.forecast_price == last[p] for p, r in found.items() if r.forecast_model == "naive")
        assert model == "naive" or any(r.forecast_model != "naive" for r in found.values())
    with pytest.raises(ValueError):
        forecast.forecasts(weeks, parts, "oracle")


def test_details_without_quotes_or_stand_ins(spark):
    catalog = spark.createDataFrame([("A-1", "m", None, "x", "Active", 1, False, "", None), ("B2", "n", "d", "y", "EOL", 0, True, "", {"a": 1.0})], "mpn string, manufacturer string, description string, category string, lifecycle_status string, authorized_stock long, is_defense_grade boolean, date_introduced string, specs map<string,double>")
    quotes = tables.quotes(spark, SF)
    asked = spark.createDataFrame([(1, "a1"), (2, "B2"), (3, "zzz"), (4, None)], "input_id long, input_string string")
    found = {r.input_id: r for r in requests.details_whole(asked, catalog, quotes).collect()}
    assert {i: r.mpn for i, r in found.items()} == {1: "A-1", 2: "B2"}
    assert all(r.history == [] and r.alternates == [] and r.price_p50 is None for r in found.values())
