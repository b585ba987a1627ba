"""Every monoid: identity, associativity, and merging parts equals aggregating the whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import laws
from tallyfold.functions import monoids as m

HOUR_US = 3_600_000_000
RNG = random.Random(12)
ROWS = [(RNG.choice("ab"), RNG.choice(["x", "y", "z", "w", "v"]), RNG.randint(-50, 50), RNG.randint(0, 40) * HOUR_US, k) for k in range(180)]


def events(spark, rows):
    return spark.createDataFrame(rows, "entity string, item string, n bigint, t bigint, seq bigint")


CASES = {
    "sum": (m.sum_(), lambda: F.col("n")),
    "count": (m.count(), lambda: F.lit(1)),
    "min": (m.min_(), lambda: F.col("n")),
    "max": (m.max_(), lambda: F.col("item")),
    "monotonic": (m.monotonic(-10), lambda: F.col("n")),
    "first": (m.first(), lambda: F.col("item")),
    "last": (m.last(), lambda: F.col("item")),
    "set": (m.set_(), lambda: F.col("item")),
    "hll": (m.hll(), lambda: F.col("item")),
    "topk": (m.TopK(5), lambda: F.col("item")),
    "topk_weighted": (m.TopK(9, True), lambda: F.struct(F.col("item"), F.abs("n").alias("weight"))),
    "bloom": (m.Bloom(1000, 0.01), lambda: F.col("item")),
    "map": (m.MapMerge(m.sum_()), lambda: F.create_map("item", "n")),
    "map_of_last": (m.MapMerge(m.last()), lambda: F.create_map("item", "n")),
    "tuple": (m.Tuple({"a": m.sum_(), "b": m.last(), "c": m.set_()}), lambda: F.struct(F.col("n").alias("a"), F.col("item").alias("b"), F.col("item").alias("c"))),
    "decayed": (m.DecayedSum(dt.timedelta(hours=3)), lambda: F.abs("n").cast("double")),
    "custom": (m.Custom(lambda a, b: max(a, b), -999, "bigint"), lambda: F.col("n")),
}


def answers(monoid, states):
    out = {}
    for r in states.select("entity", monoid.finalize(F.col("v")).alias("v")).collect():
        v = r["v"]
        out[r["entity"]] = pytest.approx(v, rel=1e-9) if isinstance(v, float) else v
    return out


@pytest.mark.parametrize("name", CASES)
def test_laws(spark, name):
    monoid, value = CASES[name]
    by = ["entity"]
    whole = events(spark, ROWS).withColumn("value", value())
    direct = monoid.aggregate(whole, by)
    third = [monoid.aggregate(whole.filter(F.col("seq") % 3 == k), by) for k in range(3)]

    def merged(*parts):
        first, *rest = parts
        for p in rest:
            first = first.union(p)
        return monoid.merge(first, by)

    a, b, c = third
    want = answers(monoid, direct)
    for got in (merged(a, b, c), merged(merged(a, b), c), merged(a, merged(b, c)), merged(c, b, a), merged(direct)):
        assert answers(monoid, got) == want
    none = monoid.aggregate(whole.filter("false"), by)
    assert answers(monoid, merged(direct, none)) == want


@pytest.mark.parametrize("name", ["last", "map", "decayed", "bloom"])
def test_law_harness(spark, name):
    monoid, value = CASES[name]
    assert laws.broken(monoid, events(spark, ROWS).withColumn("value", value()), ["entity"]) == []


def test_law_harness_names_what_is_broken(spark):
    minus = m.Custom(lambda a, b: a - b, 0, "bigint")
    assert "aggregate of parts" in laws.broken(minus, events(spark, ROWS).withColumn("value", F.col("n")), ["entity"])


def test_bloom_equal(spark):
    b = m.Bloom(1000, 0.01)

    def state(*items):
        return b.aggregate(spark.createDataFrame([("e", i) for i in items], "entity string, value string"), ["entity"])

    one, same, other = state("x", "y"), state("y", "x", "x"), state("x", "z")
    for s, want in ((same, True), (other, False)):
        assert one.select(F.col("v").alias("a")).join(s.select(F.col("v").alias("b"))).select(b.equal(F.col("a"), F.col("b"))).first()[0] is want
    assert one.select(b.equal(F.col("v"), F.lit(None).cast(one.schema["v"].dataType))).first()[0] is False


def test_hll_close_and_idempotent(spark):
    users = spark.range(10_000).select(F.lit("e").alias("entity"), F.concat(F.lit("user-"), "id").alias("value"), F.lit(0).alias("t"), F.lit(0).alias("seq"))
    state = m.hll().aggregate(users, ["entity"])
    for s in (state, m.hll().merge(state.union(state), ["entity"])):
        assert abs(s.select(m.hll().finalize(F.col("v"))).first()[0] - 10_000) <= 500


def topk(spark, k, counts):
    rows = [("e", i, 0, 0, 0) for i, n in counts for _ in range(n)]
    state = m.TopK(k).aggregate(events(spark, rows).withColumn("value", F.col("item")), ["entity"])
    return [(x["item"], x["count"]) for x in state.first()["v"]]


def test_topk(spark):
    assert topk(spark, 3, [("alpha", 5), ("beta", 3), ("delta", 2), ("gamma", 1)]) == [("alpha", 4), ("beta", 2), ("delta", 1)]
    heavy = topk(spark, 5, [("heavy", 200)] + [(f"s{i}", 1) for i in range(400)])
    assert heavy == [("heavy", 199)]
    assert topk(spark, 3, [("b", 2), ("a", 2)]) == [("a", 2), ("b", 2)]


def test_topk_error_bound_above_capacity(spark):
    rows = [("e", f"i{min(RNG.randint(0, 30), RNG.randint(0, 30))}", 0, 0, k) for k in range(500)]
    exact = {}
    for r in rows:
        exact[r[1]] = exact.get(r[1], 0) + 1
    parts = [m.TopK(4).aggregate(events(spark, rows[i::4]).withColumn("value", F.col("item")), ["entity"]) for i in range(4)]
    union = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    got = {x["item"]: x["count"] for x in m.TopK(4).merge(union, ["entity"]).first()["v"]}
    assert len(got) <= 4
    for item, n in exact.items():
        assert n - 2 * len(rows) / 5 <= got.get(item, 0) <= n


def test_bloom(spark):
    bloom = m.Bloom()
    assert (bloom.bits, bloom.hashes) == (958_506, 7)
    values = spark.range(300).select(F.lit("e").alias("entity"), F.col("id").alias("value"))
    state = bloom.aggregate(values, ["entity"])
    shape = state.select(bloom.finalize(F.col("v")).alias("s")).first()["s"]
    assert abs(shape["approx_size"] - 300) <= 2
    asked = spark.range(600).select(F.when(F.col("id") < 550, "e").otherwise("no filter").alias("entity"), F.col("id").alias("q")).union(spark.createDataFrame([("e", None)], "entity string, q bigint"))
    got = {(r["entity"], r["q"]): r["member"] for r in bloom.contains(state, asked, ["entity"], "q").collect()}
    assert len(got) == 601 and all(got["e", k] for k in range(300))
    assert sum(got["e", k] for k in range(300, 550)) <= 5
    assert not any(got["no filter", k] for k in range(550, 600)) and not got["e", None]


def test_decayed(spark):
    d = m.DecayedSum(dt.timedelta(hours=1))
    rows = [("e", "x", 8, 0, 0), ("e", "x", 4, 2 * HOUR_US, 1), ("old", "x", 1, 0, 2), ("old", "x", 1, 5000 * HOUR_US, 3)]
    state = d.aggregate(events(spark, rows).withColumn("value", F.col("n").cast("double")), ["entity"])
    got = {r["entity"]: r for r in state.select("entity", "v", d.at(F.col("v"), F.lit(4 * HOUR_US)).alias("later"), d.at(F.col("v"), F.lit(1 * HOUR_US)).alias("before")).collect()}
    assert got["e"]["v"]["value"] == pytest.approx(6) and got["e"]["later"] == pytest.approx(1.5) and got["e"]["before"] == pytest.approx(12)
    assert got["old"]["v"]["value"] == pytest.approx(1)
    with pytest.raises(ValueError):
        m.DecayedSum(dt.timedelta(0))


def test_kinds():
    assert m.sum_().additive and m.DecayedSum(dt.timedelta(1)).additive and not m.TopK().additive
    assert m.hll().structural and not m.Custom(max, 0, "bigint").structural
    assert set(m.REGISTRY) >= {"sum", "count", "hll", "topk", "bloom", "custom"}
