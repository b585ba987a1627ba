"""Dropping repeated deliveries and too frequent repeats."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import micros


def deduplicated(events: DataFrame, event_id: str = "event_id", order: list[str] | None = None) -> DataFrame:
    """One event per id, the first in ``order``; a null or empty id is never a repeat."""
    named = F.coalesce(F.col(event_id).cast("string"), F.lit("")) != ""
    own = W.partitionBy(event_id).orderBy(*(order or [event_id]))
    first = events.filter(named).withColumn("_nth", F.row_number().over(own)).filter("_nth = 1").drop("_nth")
    return first.unionByName(events.filter(~named))


def unseen(events: DataFrame, seen: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Events whose id isn't in ``seen``; a null or empty id never is."""
    ids = seen.select(F.col(event_id).cast("string").alias("_seen")).filter("_seen <> ''")
    return events.join(ids, F.col(event_id).cast("string") == F.col("_seen"), "left_anti")


def debounced(events: DataFrame, key: Column, time: Column, window: dt.timedelta, order: list[str], value: Column | None = None, last: DataFrame | None = None) -> DataFrame:
    """Events at least ``window`` after the last accepted one of their key, or of their key and value.

    Dropped events don't extend the wait; a null or empty key is never dropped.
    ``last`` has ``key, t`` of events accepted earlier.  Rows of a key are
    sorted, spilling to disk, and read in batches: the fold keeps one number.
    """
    name = key.cast("string") if value is None else F.concat(key.cast("string"), F.lit("\x00"), F.coalesce(value.cast("string"), F.lit("\x00")))
    rows = events.withColumn("_key", F.when(F.coalesce(key.cast("string"), F.lit("")) != "", name)).withColumn("_t", F.unix_micros(time.cast("timestamp")))
    free, bound = rows.filter("_key is null"), rows.filter("_key is not null")
    bound = bound.withColumn("_before", F.lit(False))
    if last is not None:
        bound = bound.unionByName(last.select(F.col("key").alias("_key"), F.col("t").alias("_t"), F.lit(True).alias("_before")), allowMissingColumns=True)
    width = micros(window)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, accepted = None, None
        for batch in batches:
            keep = []
            for k, t, before in zip(*(batch[c].to_pylist() for c in ("_key", "_t", "_before")), strict=True):
                if k != now:
                    now, accepted = k, None
                go = before or accepted is None or t - accepted >= width
                accepted = t if go else accepted
                keep.append(go and not before)
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bound.schema)
    sorted_ = bound.repartition("_key").sortWithinPartitions("_key", F.col("_t"), F.desc("_before"), *order)
    kept = sorted_.mapInArrow(fold, schema)
    return kept.drop("_before").unionByName(free).drop("_key", "_t")
