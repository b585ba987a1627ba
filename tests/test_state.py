import datetime as dt
import json
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions import monoids, windows
from tallyfold.operators import presets
from tallyfold.operators.pipeline import Pipeline
from tallyfold.sources import files, queues
from tallyfold.streaming import metrics, runtime
from tallyfold.streaming.runtime import Bound, Options, backoff, bootstrap, replay, run, start
from tallyfold.streaming.state import Alias, StateTable, VersionConflict, VersionRegressed

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2026, 5, 7, 12, tzinfo=dt.timezone.utc)


def rows(spark, *values):
    return spark.createDataFrame([(e, 0, v) for e, v in values], "entity string, bucket bigint, v bigint")


def totals(table):
    return {r["entity"]: r["v"] for r in table.read().collect()}


def orders(spark, *items, at=NOW):
    return spark.createDataFrame([(i, c, a, at) for i, c, a in items], "event_id string, customer string, amount bigint, event_time timestamp")


def order_pipeline():
    return Pipeline("orders", (F.col("customer"),), F.col("amount"), monoids.sum_())


def test_versions_segments_and_compaction(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), monoids.sum_(), most_segments=3)
    assert t.version() == 0 and t.read() is None
    for k in range(1, 6):
        assert t.merge(rows(spark, ("a", k), ("b", 1))) == k
        assert len(t.commit_info(k)["segments"]) <= 3
    assert totals(t) == {"a": 15, "b": 5}
    assert {r["entity"]: r["v"] for r in t.read(2).collect()} == {"a": 3, "b": 2}
    t.vacuum(keep=1)
    assert totals(t) == {"a": 15, "b": 5}


def test_a_batch_counts_once_and_failed_writes_are_not_seen(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), monoids.sum_())
    t.merge(rows(spark, ("a", 1)), stream="s", batch=0)
    t.merge(rows(spark, ("a", 1)), stream="s", batch=0)
    t.merge(rows(spark, ("a", 1)), stream="other", batch=0)
    assert totals(t) == {"a": 2}
    rows(spark, ("a", 99)).write.parquet(t._part("state", "000000000003-lost"))  # a write that never committed
    assert totals(t) == {"a": 2}
    t.merge(rows(spark, ("a", 5)))
    assert totals(t) == {"a": 7}


def test_two_writers_of_one_version(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), monoids.sum_())
    t.merge(rows(spark, ("a", 1)))
    with pytest.raises(VersionConflict):
        t._commit(1, t.commit_info(1), NOW)
    assert totals(t) == {"a": 1}


def test_writers_commit_on_top_of_each_other(spark, tmp_path, monkeypatch):
    t, other = (StateTable(spark, str(tmp_path), monoids.sum_()) for _ in range(2))
    t.merge(rows(spark, ("a", 1)))
    versions = iter([1, 2, 2])  # the first look is before the other's commit
    other.merge(rows(spark, ("a", 10)))
    monkeypatch.setattr(t, "version", lambda: next(versions))
    assert t.merge(rows(spark, ("a", 100)), stream="s") == 3
    assert totals(other) == {"a": 111}
    with pytest.raises(VersionConflict):
        other.merge(rows(spark, ("a", 1)), base=2)


def test_a_batch_is_deduplicated_again_after_a_conflict(spark, tmp_path, monkeypatch):
    one, two = (Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_()), Options(dedup=True)) for _ in range(2))
    merge, met = one.table.merge, []

    def late(*args, **kwargs):
        if not met:
            met.append(two.apply(orders(spark, ("1", "a", 5)), "two", 0))
        return merge(*args, **kwargs)

    monkeypatch.setattr(one.table, "merge", late)
    assert one.apply(orders(spark, ("1", "a", 5), ("2", "a", 7)), "one", 0) == 2
    assert totals(one.table) == {"a": 12}
    got = one.recorder.snapshot("orders")
    assert (got["events"], got["retries"], got["skips"]) == (2, 1, {"dedup": 1})


def test_rows_are_rewritten_once_a_level(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), monoids.sum_(), most_segments=2)
    levels = []
    for k in range(1, 10):
        t.merge(rows(spark, ("a", k)))
        levels.append(sorted(n for _, n in t.commit_info(k)["segments"]))
    assert levels == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1], [0, 0, 1, 1], [2]]
    t.vacuum(keep=1)
    assert totals(t) == {"a": 45} and t.folder.names("_commits") == ["000000000009"] and len(t.folder.names("state")) == 1


def test_bad_events_go_alone(spark, tmp_path):
    p = Pipeline("orders", (F.col("customer"),), F.col("raw").cast("bigint"), monoids.sum_())
    bound = Bound(p, StateTable(spark, str(tmp_path / "t"), monoids.sum_()), Options(attempts=1, dead_letters=runtime.to_folder(str(tmp_path / "dead"))))
    events = orders(spark, *[(str(k), "a", k) for k in range(40)])
    events = events.withColumn("raw", F.when(F.col("event_id").isin("7", "23"), F.lit("?")).otherwise(F.col("amount").cast("string")))
    bound.apply_with_retry(events, "s", 0)
    assert totals(bound.table) == {"a": sum(range(40)) - 30}
    dead = spark.read.json(str(tmp_path / "dead"))
    assert sorted(r["event_id"] for r in dead.collect()) == ["23", "7"] and dead.filter("_error is null").count() == 0


def test_debounce_forgets(spark, tmp_path):
    p = presets.counter("clicks", F.col("customer"))
    bound = Bound(p, StateTable(spark, str(tmp_path), monoids.count()), Options(key_debounce=dt.timedelta(minutes=10), debounce_kept=dt.timedelta(minutes=30)))
    for batch, (who, minute) in enumerate((("a", 0), ("b", 5), ("b", 6), ("c", 33))):
        bound.apply(orders(spark, (str(batch), who, 1), at=NOW + dt.timedelta(minutes=minute)), "s", batch)
    assert sorted(r["key"] for r in bound.table.last_accepted().collect()) == ["b", "c"]
    assert bound.recorder.snapshot("clicks")["skips"] == {"debounce": 1}


def test_expiry_is_by_write_time(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), monoids.sum_(), windows.daily(2 * DAY))
    t.merge(rows(spark, ("old", 1), ("kept", 1)), now=NOW - 3 * DAY)
    t.merge(rows(spark, ("kept", 1)), now=NOW)
    t.expire(NOW)
    assert totals(t) == {"kept": 2}


def test_hooks(spark, tmp_path):
    seen, logged = [], []
    t = StateTable(spark, str(tmp_path), monoids.sum_(), on_commit=[lambda d, v: seen.append((d.count(), v)), lambda d, v: 1 / 0], log=logged.append)
    t.merge(rows(spark, ("a", 1)))
    assert seen == [(1, 1)] and len(logged) == 1
    t.hook_errors = True
    with pytest.raises(ZeroDivisionError):
        t.merge(rows(spark, ("a", 1)))


def test_alias_only_moves_on(spark, tmp_path):
    a = Alias(spark, str(tmp_path), "likes")
    assert a.active() == 1 and a.path().endswith("likes_v1")
    a.activate(3)
    for v in (3, 2, 0):
        with pytest.raises(VersionRegressed):
            a.activate(v)
    a.activate(4)
    assert a.path().endswith("likes_v4")


def test_snapshot_then_live_with_redeliveries(spark, tmp_path):
    bound = Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_()), Options(dedup=True))
    token = bootstrap(lambda: "token", lambda: orders(spark, ("1", "cust-a", 100), ("2", "cust-a", 50), ("3", "cust-b", 25)), bound)
    assert token == "token" and totals(bound.table) == {"cust-a": 150, "cust-b": 25}
    live = orders(spark, ("1", "cust-a", 100), ("4", "cust-a", 75), ("5", "cust-b", 200), ("5", "cust-b", 200), ("6", "c", 999), ("", "c", 1), ("", "c", 1))
    bound.apply(live, "live", 0)
    bound.apply(live, "live", 0)
    assert totals(bound.table) == {"cust-a": 225, "cust-b": 225, "c": 1001}


def test_ids_are_kept_for_a_while(spark, tmp_path):
    bound = Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_(), ids_kept=DAY), Options(dedup=True))
    for batch, (now, total) in enumerate(((NOW, 1), (NOW + DAY / 2, 1), (NOW + 2 * DAY, 2), (NOW + 4 * DAY, 3))):
        bound.apply(orders(spark, ("1", "a", 1)), "s", batch, now)
        assert totals(bound.table)["a"] == total and len(bound.table.commit_info(batch + 1)["ids"]) <= 2
    bound.table.vacuum(keep=1)
    assert bound.table.seen(now=NOW + 4 * DAY).count() == 1


def test_debounce_over_batches(spark, tmp_path):
    p = presets.counter("clicks", F.col("customer"))
    bound = Bound(p, StateTable(spark, str(tmp_path), monoids.count()), Options(key_debounce=dt.timedelta(minutes=10)))
    for batch, minute in enumerate((0, 5, 9, 10, 12, 21)):
        bound.apply(orders(spark, (str(batch), "a", 1), at=NOW + dt.timedelta(minutes=minute)), "s", batch)
    assert totals(bound.table) == {"a": 3}
    both = Bound(order_pipeline(), StateTable(spark, str(tmp_path) + "/v", monoids.sum_()), Options(value_debounce=dt.timedelta(minutes=10)))
    for batch, amount in enumerate((1, 1, 2, 2)):
        both.apply(orders(spark, (str(batch), "a", amount), at=NOW), "s", batch)
    assert totals(both.table) == {"a": 3}


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "event_id string, customer string, amount bigint, event_time timestamp"
    for k in range(3):
        orders(spark, *[(f"{k}-{i}", f"c{i % 4}", i) for i in range(20)], (f"{k}-0", "c0", 0)).coalesce(1).write.mode("append").parquet(source)
    frame = files.stream_parquet(spark, source, spark.createDataFrame([], schema).schema, files_per_batch=1)
    one, two = order_pipeline(), presets.counter("n", F.col("customer"))
    tables = [StateTable(spark, f"{tmp_path}/{p.name}", p.monoid) for p in (one, two)]
    start(frame, [Bound(one, tables[0], Options(dedup=True)), Bound(two, tables[1], Options(dedup=True))], str(tmp_path / "cp")).awaitTermination()
    for p, t in ((one, tables[0]), (two, tables[1])):
        whole = p.compile(spark.read.parquet(source).dropDuplicates(["event_id"]))
        assert totals(t) == {r["entity"]: r["v"] for r in whole.collect()}
    version = tables[0].version()
    run(frame, one, tables[0], str(tmp_path / "cp2"), Options(dedup=True))  # the same stream name and batch ids: nothing new
    assert tables[0].version() == version


def test_retries_and_dead_letters(spark, tmp_path, monkeypatch):
    dead, slept = [], []
    monkeypatch.setattr(runtime, "time", SimpleNamespace(sleep=slept.append, monotonic=time.monotonic))  # of this module alone; other threads sleep too
    bound = Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_()), Options(dead_letters=lambda d, e: dead.append((d.count(), str(e)))))
    monkeypatch.setattr(bound.table, "merge", lambda *a, **k: 1 / 0)
    bound.apply_with_retry(orders(spark, ("1", "a", 1)), "s", 0)
    assert dead == [(1, "division by zero")] and slept == [0.05, 0.1]
    assert bound.recorder.snapshot("orders")["errors"] == 3
    assert [backoff(n, 1, 5) for n in (1, 2, 3, 4)] == [1, 2, 4, 5] and backoff(1, 1, 5, 1.0) == 1.5


def test_events_are_counted_one_by_one(spark, tmp_path):
    bound = Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_()))
    for batch in range(2):
        bound.apply_with_retry(orders(spark, *[(f"{batch}-{k}", "a", 1) for k in range(7)]), "s", batch)
    assert bound.recorder.snapshot("orders")["events"] == 14


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\nnot json\n{"id": null, "n": 2}\n{"id": "", "n": 3}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    read = files.read_jsonl(spark, str(tmp_path), schema, event_id=F.col("id"), required=["n"])
    got = {r["n"]: r["event_id"] for r in read.records.collect()}
    assert got[1] == "x" and got[2].startswith("jsonl:file:") and got[3] != "" and set(got) == {1, 2, 3}
    assert [(r["raw"], r["error"]) for r in read.rejected.collect()] == [("not json", "decode")]


def test_hive_folders_are_pruned(spark, tmp_path):
    spark.range(8).selectExpr("id", "id % 4 AS hour").write.partitionBy("hour").parquet(str(tmp_path / "t"))
    rows = files.read_parquet(spark, str(tmp_path / "t"), partitions=F.col("hour") >= 2, columns=["id", "hour"])
    assert rows.count() == 4
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan
    assert rows.select("event_id").distinct().count() == 4


def test_messages(spark):
    m = spark.createDataFrame([("t", 0, 5, NOW, bytearray(b'{"a": 1}')), ("t", 1, 6, NOW, bytearray(b"{")), ("t", 1, 7, NOW, None)], "topic string, partition int, offset bigint, timestamp timestamp, value binary")
    read = queues.decoded(m, T.StructType([T.StructField("a", T.LongType())]))
    assert [(r["event_id"], r["a"]) for r in read.records.collect()] == [("t:0:5", 1)]
    assert sorted(r["source"] for r in read.rejected.collect()) == ["t:1:6", "t:1:7"]
    assert queues.Kafka("h:1", ("t", "u")).settings(per_batch=5)["maxOffsetsPerTrigger"] == "5"
    assert json.loads(queues.offsets_token({"t": {0: 7}})) == {"t": {"0": 7}}
    ids = spark.createDataFrame([('{"$oid": "ab"}',), ('{"$numberLong": "5"}',), ("plain",), ('{"x": 1}',)], "i string").select(queues.document_id(F.col("i"))).collect()
    assert [r[0] for r in ids] == ["ab", "5", "plain", None]


def test_totals_from_sql(spark, tmp_path):
    spark.createDataFrame([("page-A", 1)] * 3 + [("page-B", 1)] * 2 + [("page-C", 7)], "p string, n int").createOrReplaceTempView("totals_in")
    t = StateTable(spark, str(tmp_path), monoids.sum_())
    t.merge(files.keyed_totals(spark, "SELECT p AS pk, sum(n) AS v FROM totals_in GROUP BY p"))
    assert totals(t) == {"page-A": 3, "page-B": 2, "page-C": 7}
    with pytest.raises(ValueError):
        files.keyed_totals(spark, "SELECT 1 AS pk, 2 AS v")
    with pytest.raises(Exception, match="null column"):
        files.keyed_totals(spark, "SELECT 'a' AS pk, cast(NULL AS bigint) AS v").collect()


def test_replay_of_files(spark, tmp_path):
    bound = Bound(order_pipeline(), StateTable(spark, str(tmp_path), monoids.sum_()))
    replay(orders(spark, ("1", "A", 10), ("2", "A", 20), ("3", "B", 5), ("4", "B", 5), ("5", "B", 5), ("6", "A", 30)), bound)
    assert totals(bound.table) == {"A": 60, "B": 15}


def test_metrics():
    r = metrics.Recorder()
    for k in range(100):
        r.latency("p", k)
    assert r.snapshot("p")["latency"].p95 == 94 and metrics.percentile([], 0.5) == 0
    clock, n = iter([0.0, 1.0, 2.0, 3.0]), iter([0, 50, 10, 30])
    rate = metrics.EventsPerSecond(lambda: next(n), lambda: next(clock))
    assert [rate.sample() for _ in range(4)] == [0, 50, 0, 20]
    out, errors = [], []
    metrics.emit(lambda: 1.0, lambda v: out.append(v) if len(out) < 1 else 1 / 0, 2, on_error=errors.append)
    assert out == [1.0] and len(errors) == 1
