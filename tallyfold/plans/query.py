"""Reads over state rows ``entity, bucket, v``.

Every read is a filter on buckets, a merge per entity, and the monoid's
``finalize``; filters reach the scan of the state's files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.monoids import Expression, Monoid
from ..functions.windows import ALL_TIME, Window
from ..operators.pipeline import Pipeline


#: Entities of one read that are sent to the state; a read of more is a join by shuffle.
SENT_ENTITIES = 100_000


def _sent(asked: DataFrame) -> DataFrame:
    """The distinct entities of a read, marked for a broadcast if they were counted to be within the bound."""
    wanted = asked.select("entity").distinct()
    return F.broadcast(wanted) if wanted.limit(SENT_ENTITIES + 1).count() <= SENT_ENTITIES else wanted


class Reader:
    """Answers of one pipeline's state.

    ``now`` is explicit everywhere, so a read can be repeated.
    """

    def __init__(self, pipeline: Pipeline, state: DataFrame):
        self.pipeline, self.state, self.monoid = pipeline, state, pipeline.monoid

    def _window(self) -> Window:
        if self.pipeline.window is None:
            raise ValueError(f"pipeline {self.pipeline.name!r} has no window")
        return self.pipeline.window

    def _answer(self, merged: DataFrame) -> DataFrame:
        return merged.withColumn("v", self.monoid.finalize(F.col("v")))

    def get(self, entity: str) -> DataFrame:
        """``entity, v``: the all-time answer; no row if there is no state."""
        return self._answer(self.state.filter((F.col("entity") == entity) & (F.col("bucket") == ALL_TIME))).select("entity", "v")

    def all(self) -> DataFrame:
        """``entity, bucket, v``: every state's answer."""
        return self._answer(self.state).select("entity", "bucket", "v")

    def _fold(self, low: int, high: int, entity: Column | None = None) -> DataFrame:
        rows = self.state.filter(F.col("bucket").between(low, high))
        rows = rows if entity is None else rows.filter(F.col("entity") == entity)
        return self.monoid.merge(rows.select("entity", "v"), ["entity"])

    def window(self, entity: str, span: dt.timedelta, now: dt.datetime) -> DataFrame:
        """``entity, v``: one row, the identity's answer if nothing is there."""
        return self.window_many(self._one(entity), span, now).select("entity", "v")

    def range(self, entity: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        return self.range_many(self._one(entity), start, end).select("entity", "v")

    def _one(self, entity: str) -> DataFrame:
        return self.state.sparkSession.createDataFrame([(0, entity)], "ord bigint, entity string")

    def _many(self, asked: DataFrame, merged: DataFrame) -> DataFrame:
        """``ord, entity, v, present`` for rows ``ord, entity``, each in its place; the same entity may be asked twice."""
        side = merged.select(F.col("entity").alias("_entity"), F.col("v"), F.lit(True).alias("present"))
        rows = asked.join(side, asked["entity"] == F.col("_entity"), "left").drop("_entity")
        kind = merged.schema["v"].dataType
        v = F.when(F.col("present"), F.col("v")).otherwise(self.monoid.identity().cast(kind))
        return rows.withColumn("v", self.monoid.finalize(v)).withColumn("present", F.coalesce("present", F.lit(False))).select("ord", "entity", "v", "present")

    def get_many(self, asked: DataFrame) -> DataFrame:
        rows = self.state.filter(F.col("bucket") == ALL_TIME).join(_sent(asked), "entity", "left_semi")
        return self._many(asked, rows.select("entity", "v"))

    def _narrowed(self, asked: DataFrame, low: int, high: int) -> DataFrame:
        rows = self.state.filter(F.col("bucket").between(low, high)).join(_sent(asked), "entity", "left_semi")
        return self.monoid.merge(rows.select("entity", "v"), ["entity"])

    def window_many(self, asked: DataFrame, span: dt.timedelta, now: dt.datetime) -> DataFrame:
        return self._many(asked, self._narrowed(asked, *self._window().last(now, span)))

    def range_many(self, asked: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
        return self._many(asked, self._narrowed(asked, *self._window().range(start, end)))

    #: A trailing read is a window read.
    trailing, trailing_many = window, window_many

    def over(self, entities: DataFrame, low: int = ALL_TIME, high: int = ALL_TIME) -> DataFrame:
        """``v``: one answer over the union of several entities' states, within buckets; the identity's answer if none has any."""
        rows = self.state.filter(F.col("bucket").between(low, high)).join(_sent(entities), "entity", "left_semi")
        merged = self.monoid.merge(rows.select(F.lit("all").alias("entity"), "v"), ["entity"])
        return self._many(self._one("all"), merged).select("v")

    def sliding(self, span: dt.timedelta) -> DataFrame:
        """``entity, bucket, v``: at each bucket with state, the fold of the buckets of the ``span`` that ends there.

        For monoids that are one aggregate expression.
        """
        if not isinstance(self.monoid, Expression):
            raise ValueError(f"a sliding series needs an aggregate expression, not {self.monoid.kind}")
        low, high = self._window().last(dt.datetime(1970, 1, 1), span)
        frame = W.partitionBy("entity").orderBy("bucket").rangeBetween(low - high, 0)
        return self.state.select("entity", "bucket", self.monoid.finalize(self.monoid.refold(F.col("v")).over(frame)).alias("v"))


def combined(pipeline: Pipeline, view: DataFrame, delta: DataFrame) -> Reader:
    """A reader over a batch view and a realtime delta, merged bucket by bucket."""
    columns = ["entity", "bucket", "v"]
    return Reader(pipeline, pipeline.merge(view.select(columns), delta.select(columns)))


def snapshot_plus(snapshot: DataFrame, delta: Reader, taken_at: dt.datetime, now: dt.datetime) -> DataFrame:
    """``entity, v``: a snapshot's value and what has been added since it was taken, for sums."""
    since = delta._fold(*delta._window().range(taken_at, now)).select("entity", "v")
    both = snapshot.select("entity", "v").unionByName(since)
    return delta.monoid.merge(both, ["entity"])


def warm(reader: Reader, entities: DataFrame, span: dt.timedelta | None = None, now: dt.datetime | None = None) -> tuple[DataFrame, int]:
    """The persisted state rows of some entities, for repeated reads, and how many there are."""
    rows = reader.state.join(_sent(entities), "entity", "left_semi")
    if span is not None:
        rows = rows.filter(F.col("bucket").between(*reader._window().last(now, span)))
    rows = rows.persist()
    return rows, rows.count()


def described(v: Column, monoid: Monoid) -> Column:
    """A state's answer as text: numbers, item lists and filter shapes; anything else as an opaque kind."""
    if monoid.kind in ("sum", "count", "min", "max", "hll", "set", "first", "last", "decayed_sum"):
        return monoid.finalize(v).cast("string")
    if monoid.kind in ("topk", "bloom", "tuple"):
        return F.to_json(monoid.finalize(v))
    return F.when(v.isNotNull(), F.lit(f"opaque({monoid.kind})"))
