"""Queries that go through sketches give their SQL's exact answers where the sketches alone can't."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold import queries as core
from tallyfold.functions import monoids as m
from tallyfold.operators import presets
from tallyfold.plans.query import Reader


def against_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(core.ORACLE_SQL[name]).df()
    got = core.QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    ours, theirs = ({tuple(r): k for k, r in enumerate(df.itertuples(index=False))} for df in (got, want))
    assert len(got) == len(want) and ours.keys() == theirs.keys()


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """60,000 users, of whom each type has some: enough that filters pass strangers and estimates are off."""
    folder = tmp_path_factory.mktemp("many")
    rows = spark.range(120_000).select(
        F.col("id").alias("event_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 20)).alias("ts"), (F.col("id") % 60_000).alias("user_id"),
        F.when(F.col("id") % 7 == 0, "purchase").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def odd_users(spark, tmp_path_factory):
    """A type without any user, one with a user and none, one with one user often."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [("click", None), ("click", None), ("view", 5), ("view", None), ("purchase", 5), ("purchase", 5), ("purchase", 5)]
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k), user, kind, 1.0, "{}") for k, (kind, user) in enumerate(rows)], columns).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def other_types(spark, tmp_path_factory):
    """Events, none of a type that a query asks for."""
    folder = tmp_path_factory.mktemp("other")
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame([(0, dt.datetime(2024, 1, 1), 5, "view", 1.0, "{}")], columns).write.parquet(f"{folder}/events.parquet")
    return folder


def test_bloom_membership_of_many_users(spark, many_users):
    against_sql(spark, many_users, "bloom_membership")


def test_bloom_full_filter_with_members(spark):
    bloom = m.Bloom(10, 0.5)
    members = spark.range(500).select(F.lit("e").alias("entity"), F.col("id").alias("value"))
    state = bloom.aggregate(members, ["entity"])
    asked = spark.createDataFrame([("e", 3), ("e", 3), ("e", 700), ("e", None), ("other", 3), (None, 3)], "entity string, q bigint")
    assert [r["member"] for r in bloom.contains(state, asked, ["entity"], "q").filter("q = 700").collect()] == [True]
    got = sorted((str(r["entity"]), str(r["q"]), r["member"]) for r in bloom.contains(state, asked, ["entity"], "q", members).collect())
    assert got == [("None", "3", False), ("e", "3", True), ("e", "3", True), ("e", "700", False), ("e", "None", False), ("other", "3", False)]


@pytest.mark.parametrize("folder", ["many_users", "odd_users"])
def test_bloom_shape(spark, request, folder):
    against_sql(spark, request.getfixturevalue(folder), "bloom_shape")


@pytest.mark.parametrize("folder", ["many_users", "odd_users", "other_types"])
def test_cardinality_over(spark, request, folder):
    against_sql(spark, request.getfixturevalue(folder), "cardinality_over")


@pytest.mark.parametrize("folder", ["many_users", "odd_users"])
def test_distinct_users_hll(spark, request, folder):
    against_sql(spark, request.getfixturevalue(folder), "distinct_users_hll")


def test_over_no_state(spark):
    p = presets.counter("c", F.col("k")).at(F.lit("2024-01-01").cast("timestamp"), F.lit(0))
    state = p.compile(spark.createDataFrame([("a",), ("a",), ("b",)], "k string"))
    for entities, want in (["a", "b", "b"], 3), (["b"], 1), (["c"], 0), ([], 0):
        asked = spark.createDataFrame([(e,) for e in entities], "entity string")
        assert [r["v"] for r in Reader(p, state).over(asked).collect()] == [want]


def test_hll_fits(spark):
    for n, estimate, want in (0, 0, True), (0, 3, False), (10, 8, True), (10, 7, False), (100_000, 108_000, True), (100_000, 91_000, False):
        assert spark.range(1).select(m.hll_fits(F.lit(estimate), F.lit(n))).first()[0] is want, (n, estimate)


def test_bloom_fits(spark):
    """Filters from empty to full fit the number of their values and no number far from it; full ones tell many numbers apart no longer."""
    bloom = m.Bloom(1000, 0.01)
    for n in (0, 1, 30, 1000, 5000, 20_000):
        state = bloom.aggregate(spark.range(n).select(F.lit("e").alias("entity"), F.col("id").alias("value")), ["entity"])
        whole = spark.range(1).join(state, how="left").select(bloom.finalize(F.col("v")).alias("s"))
        fits = [whole.select(bloom.fits(F.col("s"), F.lit(k))).first()[0] for k in (n, n // 3, 3 * n + 20)]
        assert fits == [True, n < 5 or n == 20_000, n == 20_000], n


def test_sketch_that_does_not_fit(spark):
    one = spark.range(1)
    assert one.select(m.settled(F.lit(7).cast("bigint"), F.lit(True)).alias("n")).first()["n"] == 7
    with pytest.raises(Exception, match="doesn't fit the count 7"):
        one.select(m.settled(F.col("id") + 7, F.col("id") > 0)).collect()
