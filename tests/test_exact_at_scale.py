"""Order statistics, stand-ins and alike keys: equal to plain computation, and no group or grid in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.functions import similarity
from quotemill.operators import alternates, matching, order_statistics, records


def _alternates(parts, wanted, most=5):
    """parts: category, mpn, manufacturer, lifecycle, stock, specs."""
    values = {}
    for category, _, _, _, _, specs in parts:
        for field, value in (specs or {}).items():
            if value is not None:
                values.setdefault((category, field), []).append(value)
    spread = {}
    for key, v in values.items():
        v.sort()
        if len(v) >= 2:
            width = v[3 * len(v) // 4] - v[len(v) // 4]
            spread[key] = width if width > 0 else abs(v[-1] - v[0]) or abs(v[0]) or 1.0
    out = {}
    for category, mpn, maker, _, _, specs in parts:
        if mpn not in wanted:
            continue
        found = []
        for c, other, m, life, stock, theirs in parts:
            shared = [f for f in (specs or {}) if specs[f] is not None and (theirs or {}).get(f) is not None]
            if c != category or other == mpn or m == maker or not shared:
                continue
            weight = {f: alternates.HEADLINE.get(c, {}).get(f.split(".")[0], 1.0) for f in shared}
            far = sum(weight[f] * min(abs(specs[f] - theirs[f]) / spread.get((c, f), 1.0), 4.0) for f in shared) / sum(weight.values())
            found.append((round(far + 0.6 * (life in ("Obsolete", "EOL")) + 0.2 * (stock == 0), 9), other))
        out[mpn] = [other for _, other in sorted(found)[:most]]
    return {k: v for k, v in out.items() if v}


def _parts(n, rng):
    rows = []
    for i in range(n):
        category = rng.choice(["Logic Gates", "Fixed Resistors", "SRAM"]) if i % 7 else "Alone"
        specs = {"resistance_ohm": round(rng.lognormvariate(3, 2), 3), "power_rating_w": rng.choice([0.1, 0.25, None, 1.0]), "channels": float(rng.randrange(1, 5))}
        specs = {k: v for k, v in specs.items() if rng.random() < 0.8}
        rows.append((category, f"P{i:05d}", f"m{rng.randrange(4)}", rng.choice(["Active", "EOL"]), rng.choice([0, 5, None]), None if rng.random() < 0.03 else specs))
    return rows


SCHEMA = "category string, mpn string, manufacturer string, lifecycle_status string, authorized_stock long, specs map<string,double>"


@pytest.mark.parametrize("block", [16, 2048])
def test_alternates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(alternates, "BLOCK", block)
    parts = _parts(400, random.Random(block))
    frame = spark.createDataFrame(parts, SCHEMA)
    wanted = {p[1] for p in parts if int(p[1][1:]) % 3 == 0}
    found = {}
    for r in sorted(alternates.alternates(frame, frame.where(F.col("mpn").isin(*wanted))).collect(), key=lambda r: (r.mpn, r.rank)):
        found.setdefault(r.mpn, []).append(r.alternate)
    assert found == _alternates(parts, wanted)


def test_alternates_meet_few_of_a_large_category(spark, monkeypatch):
    """In one category of all parts most blocks are never met, and the first and last block are not the exception."""
    monkeypatch.setattr(alternates, "BLOCK", 64)
    rng = np.random.default_rng(4)
    parts = [("Fixed Resistors", f"P{i:05d}", f"m{i % 5}", "Active", 1, {"resistance_ohm": float(x), "power_rating_w": float(i % 3)}) for i, x in enumerate(rng.normal(size=4000).cumsum() * 50)]
    frame = spark.createDataFrame(parts, SCHEMA)
    met, real = [], alternates._met

    def counted(*args):
        out = real(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(alternates, "_met", counted)
    assert alternates.alternates(frame, frame.where("mpn like '%0'")).count() == 5 * 400
    assert met[0] < 0.1 * (4000 / 64) ** 2


def test_order_statistics_of_one_hot_group(spark):
    """Ranks and quantiles of groups of all sizes, one of nearly all rows, with ties, nulls and a null key."""
    rng = random.Random(9)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 10])) for _ in range(5000)] + [("one", 3.0), (None, 4.0), (None, 6.0), ("none", None)]
    rows += [("two", 5.0), ("two", -5.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("hot", None)]
    frame = spark.createDataFrame(rows, "k string, x double")
    n = F.col("size")
    got = {r.k: (r.size, r.first, r.quarter, r.last, r.beyond) for r in order_statistics.at_ranks(frame, ["k"], "x", {"first": F.lit(0), "quarter": F.floor(n / 4), "last": n - 1, "beyond": n}).collect()}
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert got == {k: (len(v), *(sorted(v)[i] for i in (0, len(v) // 4, len(v) - 1)), None) for k, v in groups.items()}
    want = {r.k: r.p for r in frame.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("p")).collect()}
    found = {r.k: [r.a, r.b] for r in order_statistics.quantiles(frame, ["k"], "x", {"a": 0.1, "b": 0.5}).collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)


def test_alike_keys_lose_nothing_to_the_index(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABC01") for _ in range(rng.randrange(1, 16)))
    keys = sorted({word() for _ in range(300)} | {"A", "0", "é", "\U0001f600B", "AB" * 45, "AB" * 44 + "C"})
    asked = sorted({word() for _ in range(120)} | {"B", "é", "Aé", "\U0001f600B1", "AB" * 44, "A" * 80, "Z"})
    got = {(r.query, r.part_key, r.score) for r in matching.alike(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(k,) for k in keys], "part_key string")).collect()}
    want = {(q, k, similarity.score(q, k)) for q in asked for k in keys}
    assert got == {x for x in want if x[2] >= matching.FUZZY_LEAST} and len(got) > 100


def test_common_grams_is_a_bound():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("AB0") for _ in range(rng.randrange(2, 12)))
        b = "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "A", "0B"])
        if similarity.score(a, b) >= matching.FUZZY_LEAST and min(len(a), len(b)) > 1:
            grams = lambda s: [s[i : i + 2] for i in range(len(s) - 1)]
            common = sum(min(grams(a).count(g), grams(b).count(g)) for g in set(grams(a)))
            assert common >= matching.common_grams(min(len(a), len(b)))


@pytest.mark.parametrize("category, field, want", [("Microcontrollers", "operating_voltage", 1.7), ("Operational Amplifiers", "supply_voltage", 1.7), ("Logic Gates", "supply_voltage", 2.0), ("SRAM", "supply_voltage", 2.0)])
def test_names_of_voltages_are_asked_for_in_the_category_s_order(spark, category, field, want):
    attrs = F.create_map(*[F.lit(x) for x in ("voltagesupplymin", "2.0 V", "operatingsupplyvoltagemin", "1.7 V")])
    asked = spark.createDataFrame(records.fields(), records._FIELD_ROWS).where(F.col("category") == category)
    (row,) = asked.select(records.attribute_specs(attrs, F.col("fields")).alias("specs")).collect()
    assert row.specs[f"{field}.min_v"] == want


def test_prefixes_meet_ten_parts_each(spark):
    """A beginning of all parts returns ten without ranking the others; ends of ranges lose nothing."""
    rng = random.Random(7)
    keys = [f"AAAAAA{rng.randrange(3000):04d}" for _ in range(1500)] + ["AAAAAA", "AAAAAB", "ZZZZZZ9", "BBBBBB", "AAAAA", None]
    catalog = spark.createDataFrame([(f"{k}-{i}", k, k, "Active", 1) for i, k in enumerate(keys)], "mpn string, part_key string, part_base string, lifecycle_status string, authorized_stock long")
    asked = ["AAAAAA", "AAAAAA", "AAAAAA1", "AAAAAA29", "AAAAAA2999", "AAAAAAX", "ZZZZZZ", "AAAAA", "CCCCCC", "BBBBBB", None, ""]
    inputs = spark.createDataFrame([(i, k, k) for i, k in enumerate(asked)], "input_id long, input_string string, key string")
    got = sorted((r.input_id, r.mpn) for r in matching.prefix(inputs, catalog).collect())
    rows = sorted((k, f"{k}-{i}") for i, k in enumerate(keys) if k)
    want = sorted((i, mpn) for i, q in enumerate(asked) if q and len(q) >= 6 for _, mpn in [r for r in rows if r[0].startswith(q)][:10])
    assert got == want
    plan = matching.prefix(inputs, catalog)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
