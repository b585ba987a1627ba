import pytest
from pyspark.sql import functions as F

from tallyfold.functions import monoids
from tallyfold.operators.pipeline import Pipeline
from tallyfold.operators.presets import counter
from tallyfold.streaming import worker
from tallyfold.streaming.runtime import Bound
from tallyfold.streaming.state import StateTable


class Query:
    def __init__(self, polls, error=None):
        self.polls, self.error, self.stopped = polls, error, False

    def awaitTermination(self, seconds):
        self.polls -= 1
        if self.error and self.polls < 0:
            raise self.error
        return self.polls < 0

    def stop(self):
        self.stopped = True


def test_exit_codes():
    assert worker.work(lambda: Query(2)) == worker.DONE
    assert worker.work(lambda: Query(1, RuntimeError("x"))) == worker.FAILED
    assert worker.work(lambda: 1 / 0) == worker.NOT_STARTED


@pytest.mark.parametrize("make", [lambda b: worker.shard_handler(b, "arn"), lambda b: worker.queue_handler(b, "arn"), lambda b: worker.change_handler(b, F.col("page") != "skip")])
def test_handlers(spark, tmp_path, make, monkeypatch):
    bound = Bound(counter("pages", F.col("page")), StateTable(spark, str(tmp_path), monoids.count()))
    rows = spark.createDataFrame([("a", "1", 1000), ("a", "2", None), ("skip", "3", 1000)], "page string, message_id string, sent_ms bigint")
    rows = rows.withColumn("sequence_number", F.col("message_id")).withColumn("arrival", F.current_timestamp()).withColumn("event_time", F.current_timestamp()).withColumn("event_id", F.col("message_id"))
    handle = make(bound)
    assert handle(rows, "s", 0).count() == 0
    assert {r["entity"]: r["v"] for r in bound.table.read().collect()}["a"] == 2
    monkeypatch.setattr(bound.table, "merge", lambda *a, **k: 1 / 0)
    assert sorted(r["item"] for r in handle(rows, "s", 1).collect()) == ["1", "2", "3"]


def test_only_bad_items_come_again(spark, tmp_path):
    bound = Bound(Pipeline("n", (F.col("page"),), F.col("n").cast("bigint"), monoids.sum_()), StateTable(spark, str(tmp_path), monoids.sum_()))
    rows = spark.createDataFrame([("a", str(k), "x" if k == 5 else "1", 1000) for k in range(9)], "page string, message_id string, n string, sent_ms bigint")
    handle = worker.queue_handler(bound, "arn")
    assert [r["item"] for r in handle(rows, "s", 0).collect()] == ["5"]
    assert {r["entity"]: r["v"] for r in bound.table.read().collect()} == {"a": 8}
