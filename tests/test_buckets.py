import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import buckets
from tallyfold.operators import projection
from tallyfold.operators.dedup import debounced, deduplicated, unseen


def of(spark, values, column):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(column(F.col("v"))).collect()]


def test_log_linear_manual(spark):
    assert of(spark, [-100, 0, 1, 9, 10, 99, 100, 999, 1000, 9999, 10_000, 10**6, 10**7], buckets.log_bucket) == [0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 6, 7]
    assert of(spark, [-5, 0, 9, 10, 25], lambda v: buckets.linear_bucket(v, 10)) == [0, 0, 0, 1, 2]
    assert of(spark, [3], lambda v: buckets.linear_bucket(v, 0)) == [3]
    assert of(spark, [0, 10, 49, 50, 1000], lambda v: buckets.manual_bucket(v, [10, 50, 50, 100])) == [0, 1, 1, 3, 4]
    with pytest.raises(ValueError):
        buckets.manual_bucket(F.lit(1), [5, 1])


def along(spark, values, band):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i int, v bigint")
    return [r["bucket"] for r in buckets.Sticky(buckets.log_bucket, band).along(rows, "k", ["i"], "v").orderBy("i").collect()]


def test_sticky(spark):
    assert along(spark, [500, 950, 1100, 950, 1100], 0.2) == [2] * 5
    assert along(spark, [500, 5000, 950, 500], 0.2) == [2, 3, 3, 2]
    assert along(spark, [500, 1100, 950], 0.0) == [2, 3, 2]


def test_changes_of_a_counter(spark):
    values = [10 ** (k / 40) for k in range(241)]
    rows = spark.createDataFrame([("k", i, int(v)) for i, v in enumerate(values)], "k string, i int, v bigint")
    found = projection.history_changes(rows, buckets.log_bucket, key="k", order=["i"], value="v").orderBy("i").collect()
    assert [r["bucket"] for r in found] == [0, 1, 2, 3, 4, 5, 6]


def test_change_rows(spark):
    rows = spark.createDataFrame([("a", None, 5), ("b", 50, 60), ("c", 95, 105), ("d", 95, 150), ("e", 500, None), (None, 1, 100), ("f", 5, None)], "pk string, old_v bigint, new_v bigint")
    got = {r["pk"]: (r["old_bucket"], r["new_bucket"]) for r in projection.changes(rows, buckets.log_bucket, band=0.1).collect()}
    assert got == {"a": (-1, 0), "d": (1, 2), "e": (2, 0)}


def test_transition(spark):
    row = spark.createDataFrame([(9, 10)], "a bigint, b bigint").select(buckets.transition(buckets.log_bucket, F.col("a"), F.col("b"))).first()[0]
    assert row[:] == (0, 1, True)


def timed(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + dt.timedelta(minutes=m), v, i) for i, (k, m, v) in enumerate(rows)], "k string, t timestamp, v int, i int")


def test_debounce(spark):
    rows = timed(spark, [("a", 0, 1), ("a", 4, 1), ("a", 9, 2), ("a", 10, 1), ("a", 19, 1), ("a", 20, 1), ("b", 1, 1), (None, 0, 1), (None, 0, 1), ("", 0, 1)])
    kept = lambda **o: sorted(r["i"] for r in debounced(rows, F.col("k"), F.col("t"), dt.timedelta(minutes=10), ["i"], **o).collect())
    assert kept() == [0, 3, 5, 6, 7, 8, 9]
    assert kept(value=F.col("v")) == [0, 2, 3, 5, 6, 7, 8, 9]
    last = spark.createDataFrame([("a", int(dt.datetime(2023, 12, 31, 23, 55, tzinfo=dt.timezone.utc).timestamp() * 1e6))], "key string, t bigint")
    assert kept(last=last) == [2, 4, 6, 7, 8, 9]


def test_dedup(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("", 3), ("", 4), (None, 5), ("y", 6)], "event_id string, n int")
    assert sorted(r["n"] for r in deduplicated(rows, order=["n"]).collect()) == [1, 3, 4, 5, 6]
    seen = spark.createDataFrame([("y",), (None,), ("",)], "event_id string")
    assert sorted(r["n"] for r in unseen(rows, seen).collect()) == [1, 2, 3, 4, 5]
