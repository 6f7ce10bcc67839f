"""Plans that hold at size: rules run once, no large table is sent to all tasks, alike keys without an index of pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import part_numbers, similarity
from quotemill.operators import matching
from quotemill.plans import registry
from quotemill.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["input_variants", "rules_applied", "match_variant"])
def test_filters_hold_no_rules(spark, name):
    """A filter below the rules held each of them over and over: 230 to 271 replacements a row."""
    assert _plan(registry.queries()[name](spark, SF)).count("regexp_replace") <= 4


def test_odd_endings_are_taken_as_before(spark):
    """One look tells whether there is a quantity or an ending at all; what is taken then is the same."""
    rows = ["QTY 10 ,", "AB12 X9 X10 ;", "LM358-TR-ND QTY 5", "LM358/REEL-TAPE", "ABC-TR", "A-TR", "(12) [3]", "TAPEANDREEL", "X-TR7-TR13 PCS 3,", "12 PCS", " , ;", "", "A\nQTY 3\n"]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    many = lambda x, step, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, lambda a, _: step(a))
    got = df.select("i", part_numbers.without_quantity(F.col("t")).alias("q"), part_numbers.without_packaging(F.col("t")).alias("p"))
    want = df.select("i", many(F.col("t"), part_numbers._without_quantity, 12).alias("q"), many(F.col("t"), part_numbers._without_suffix, 12).alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dead_parts_look_for_live_ones_at_their_place(spark, monkeypatch):
    """Parts of a spec's value live and die together; the dead met every block, as their own ones had no good stand-in."""
    from quotemill.operators import alternates

    monkeypatch.setattr(alternates, "BLOCK", 64)
    rng = random.Random(3)
    schema = "category string, mpn string, manufacturer string, lifecycle_status string, authorized_stock long, specs map<string,double>"
    parts = [("c", f"P{i:05d}", f"m{i % 5}", "Obsolete" if i % 50 % 8 < 2 else "Active", 0 if i % 50 % 8 < 2 else 5, {"size": float(i % 50), "weight": rng.random()}) for i in range(6000)]
    frame, met, real = spark.createDataFrame(parts, schema), [], alternates._met

    def counted(*args):
        met.append(real(*args))
        return met[-1]

    monkeypatch.setattr(alternates, "_met", counted)
    dead = frame.where("lifecycle_status = 'Obsolete' AND mpn < 'P01000'")
    found = alternates.alternates(frame, dead).collect()
    assert len(found) == 5 * dead.count() and all(r.lifecycle_status == "Active" for r in found)
    groups = met[0].select("group").distinct().count()
    assert met[0].count() < 0.25 * groups * 6000 / 64


def test_letters_of_any_column_as_in_sql(spark):
    """The first of them was taken modulo 256 from 130,000 on."""
    import duckdb

    from quotemill.functions import units

    at = [0, 25, 26, 701, 702, 18277, 18278, 60000, 129817, 129818, 130000, 146718, 250000, 1199999, 3000000]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT unnest({at}) AS p_partkey")
    want = con.execute(registry.oracle_sql()["sheet_letters"]).fetchall()
    rows = spark.createDataFrame([(i,) for i in at], "p_partkey long")
    got = rows.select("p_partkey", units.column_letter(F.col("p_partkey").cast("int")).alias("letters")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_catalog_is_broadcast(spark):
    """By the bytes of their files catalog and inputs were small enough to go through the driver."""
    inputs, catalog = matching.read(tables.requests(spark, SF)), matching.keyed(tables.catalog(spark, SF))
    for tier in (matching.exact, matching.variant, matching.base_part):
        assert "BroadcastHashJoin" not in tier(inputs, catalog)._jdf.queryExecution().executedPlan().toString()


def test_alike_keys_meet_without_a_join_on_pairs_of_signs(spark):
    """Dense numbers share pairs of signs: an index of them met more rows than there are pairs of keys."""
    rng = random.Random(8)
    word = lambda: "LAR" + str(rng.randrange(10000, 99999)) + "C7"
    keys, asked = sorted({word() for _ in range(400)}), sorted({word() + "X9" for _ in range(40)})
    found = matching.alike(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(k,) for k in keys], "part_key string"), 3)
    assert "Join" not in _plan(found)
    want = set()
    for q in asked:
        best = sorted((-similarity.score(q, k), k) for k in keys)
        want |= {(q, -s, k) for s, k in best[:3] if -s >= matching.FUZZY_LEAST}
    assert want <= {(r.query, r.score, r.part_key) for r in found.collect()}
