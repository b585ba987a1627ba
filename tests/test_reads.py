import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import keys, monoids, windows
from tallyfold.operators import presets, rerank
from tallyfold.operators.pipeline import Pipeline, PipelineError
from tallyfold.plans.query import Reader, combined, described, snapshot_plus, warm
from tallyfold.plans.registry import NamedQuery, Registry

NOW = dt.datetime(2026, 5, 7, 12)
DAY = dt.timedelta(days=1)


def pipeline():
    return presets.counter("pages", F.col("page")).windowed(windows.daily())


def page_views(spark):
    rows = [("page-A", NOW - d * DAY, f"{d}-{k}") for d in range(10) for k in range(10 - d)] + [("page-B", NOW, "b")]
    return spark.createDataFrame(rows, "page string, event_time timestamp, event_id string")


def reader(spark):
    return Reader(pipeline(), pipeline().compile(page_views(spark)))


def state(spark, values, entity="e"):
    top = windows.daily().bucket_of(NOW)
    return spark.createDataFrame([(entity, top - d, v) for d, v in enumerate(values)], "entity string, bucket bigint, v bigint")


@pytest.mark.parametrize(("days", "n"), [(1, 10), (2, 19), (3, 27), (7, 49), (10, 55), (30, 55)])
def test_windows_of_a_counter(spark, days, n):
    assert reader(spark).window("page-A", days * DAY, NOW).collect()[0]["v"] == n


def test_ranges_and_missing(spark):
    r = reader(spark)
    assert r.range("page-A", NOW - 5 * DAY, NOW - 3 * DAY).first()["v"] == 18
    assert r.range("page-A", NOW, NOW - DAY).first()["v"] == 0
    asked = spark.createDataFrame([(0, "page-B"), (1, "none"), (2, "page-A"), (3, "page-B")], "ord bigint, entity string")
    got = r.window_many(asked, DAY, NOW).orderBy("ord").collect()
    assert [(x["v"], x["present"]) for x in got] == [(1, True), (0, False), (10, True), (1, True)]


def test_trailing_counts_whole_days(spark):
    p = presets.trailing(pipeline(), 7 * DAY, -DAY)
    assert p.window.retention == 8 * DAY
    assert Reader(p, state(spark, [1, 2, 3, 4, 5, 6, 7, 8])).trailing("e", 7 * DAY, NOW).first()["v"] == 28
    assert Reader(p, state(spark, [1] * 31)).trailing("e", 30 * DAY, NOW).first()["v"] == 30
    plain = pipeline()
    assert presets.trailing(plain) is plain


def test_view_and_delta(spark):
    view, delta = state(spark, [10, 9, 8, 7, 6, 5, 4]), state(spark, [2, 3])
    assert combined(pipeline(), view, delta).window("e", 7 * DAY, NOW).first()["v"] == 54
    only = combined(pipeline(), view.filter("false"), delta).window("e", DAY, NOW).first()["v"]
    assert only == 2


def test_missing_buckets_are_the_identity(spark):
    p = pipeline().aggregate(monoids.monotonic(-100), windows.daily())
    assert Reader(p, state(spark, [-7])).window("e", 7 * DAY, NOW).first()["v"] == -7
    assert Reader(p, state(spark, [-7])).window("other", 7 * DAY, NOW).first()["v"] == -100


def test_snapshot_sliding_warm_described(spark):
    r = Reader(pipeline(), state(spark, [1, 2, 3]))
    snapshot = spark.createDataFrame([("e", 100), ("f", 5)], "entity string, v bigint")
    assert {x["entity"]: x["v"] for x in snapshot_plus(snapshot, r, NOW - DAY, NOW).collect()} == {"e": 103, "f": 5}
    assert sorted(x["v"] for x in r.sliding(2 * DAY).collect()) == [3, 3, 5]
    rows, n = warm(r, spark.createDataFrame([("e",), ("g",)], "entity string"), 2 * DAY, NOW)
    assert n == 2
    rows.unpersist()
    assert r.state.select(described(F.col("v"), r.monoid)).first()[0] == "1"
    with pytest.raises(ValueError):
        Reader(presets.counter("x", F.col("k")), r.state).window("e", DAY, NOW)


def test_pipeline_names_what_is_missing(spark):
    with pytest.raises(PipelineError, match="no key and no value and no monoid"):
        Pipeline("p").validated()
    with pytest.raises(PipelineError, match="no store"):
        pipeline().validated(store=True)


def test_many_keys(spark):
    p = Pipeline("likes", (), F.lit(1), monoids.count()).key_by_many([F.lit("all"), F.col("post"), F.concat_ws("|", "post", "country"), F.when(F.col("country") == "x", "x")])
    rows = spark.createDataFrame([("p", "x", 1), ("p", "y", 2)], "post string, country string, event_id bigint").withColumn("event_time", F.lit(NOW))
    assert {r["entity"]: r["v"] for r in p.compile(rows).collect()} == {"all": 2, "p": 2, "p|x": 1, "p|y": 1, "x": 1}


def test_named_queries(spark):
    with pytest.raises(ValueError, match="no field"):
        NamedQuery("GetX", "get_all_time", "x:{y}", {"z": "string"})
    with pytest.raises(ValueError, match="needs a duration"):
        NamedQuery("GetX", "get_window", "x:{y}", {"y": "string"})
    with pytest.raises(ValueError, match="capital"):
        NamedQuery("getX", "get_all_time", "{y}", {"y": "string"})
    with pytest.raises(ValueError, match="must be int64"):
        NamedQuery("GetX", "get_window", "{y}", {"y": "string", "d": "string"}, duration="d")
    q = NamedQuery("GetRange", "get_range", "{page}", {"page": "string", "a": "int64", "b": "int64"}, start="a", end="b")
    seconds = lambda t: windows.epoch_micros(t) // 1_000_000
    got = Registry(q).run("GetRange", reader(spark), {"page": "page-A", "a": seconds(NOW - 5 * DAY), "b": seconds(NOW - 3 * DAY)}, NOW)
    assert got.first()["v"] == 18


def test_rerank(spark):
    c = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0)], "id string, relevance double")
    counts = spark.createDataFrame([("A", 10), ("B", 1000), ("C", 100)], "entity string, v bigint")
    assert [r["id"] for r in rerank.rerank(c, counts, counts).collect()] == ["B", "C", "A"]
    assert [r["id"] for r in rerank.rerank(c, counts.filter("false"), counts, recall=2, top=1).collect()] == ["B"]


def test_keys(spark):
    row = spark.createDataFrame([(1, None)], "a int, b int")
    assert row.select(keys.from_template("x:{a}|y"), keys.from_template("{a}{b}")).first()[:] == ("x:1|y", None)
