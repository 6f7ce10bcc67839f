"""Every query over the warehouse tables, against its SQL in DuckDB."""

import itertools
import math
from decimal import Decimal

import duckdb
import pytest

from quotemill.functions import part_numbers, similarity
from quotemill.operators import matching
from quotemill.plans import registry
from quotemill.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: Iterative models and similarity search that SQL doesn't express, tested elsewhere.
WITHOUT_SQL = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sql, name):
    got = registry.queries()[name](spark, SF)
    found = sql.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(repr([_plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert sorted(repr([_plain(r[c]) for c in sorted(columns)]) for r in got.collect()) == want


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_analysis_with_all_tiers(spark):
    """Requests that no equality finds, against scoring every key."""
    keys = {r.part_key for r in matching.keyed(tables.catalog(spark, SF)).select("part_key").distinct().collect()}
    asked = {r.input_id: r.key for r in part_numbers.normalized(tables.requests(spark, SF)).select("input_id", "key").collect()}
    equal = {r.input_id: (r.matched_mpn, r.match_method) for r in registry.queries()["analyze"](spark, SF).collect()}
    rows = {r.input_id: r for r in registry.flagship(spark, SF).collect()}
    assert set(rows) == set(equal)
    left = [i for i, (mpn, _) in equal.items() if mpn is None]
    near = {i for i in left if asked[i] and max(similarity.score(asked[i], k) for k in keys) >= matching.FUZZY_LEAST}
    assert near
    assert {i for i, r in rows.items() if r.match_method == "fuzzy"} == near
    assert all(r.matched_mpn and r.risk_score is not None and r.candidates > 0 for i, r in rows.items() if i in near)
    assert all((r.matched_mpn, r.match_method) == equal[i] for i, r in rows.items() if i not in near)
    chosen = {r.input_id: r for r in registry.queries()["apply_overrides_all_tiers"](spark, SF).collect()}
    assert all((chosen[i].matched_mpn, chosen[i].match_method) == (rows[i].matched_mpn, "fuzzy") for i in near)
    told = registry.queries()["matcher_accuracy_all_tiers"](spark, SF).agg({"n": "sum"}).first()[0]
    assert told == len(rows)


def test_all_readings(spark):
    """Every reading of a key, by trying all; not only the first."""
    swap = {"O": "0", "0": "O", "I": "1", "1": "I"}
    want = set()
    for r in registry.queries()["normalize_inputs"](spark, SF).select("input_id", "key").collect():
        key = r.key or ""
        if 1 <= sum(c in swap for c in key) <= 6:
            readings = sorted({"".join(x) for x in itertools.product(*[(c, swap[c]) if c in swap else (c,) for c in key])} - {key})
            want |= {(r.input_id, at, x) for at, x in enumerate(readings[:8])}
    got = registry.queries()["input_variants"](spark, SF).collect()
    assert len(got) == len(want) and {(r.input_id, r.at, r.variant) for r in got} == want
    assert max(at for _, at, _ in want) == 7


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == registry.flagship(spark, SF).columns
