"""Pipelines in common use."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import monoids
from ..functions.windows import DAY, Window
from .pipeline import Pipeline


def counter(name: str, *keys: Column) -> Pipeline:
    """Events per key."""
    return Pipeline(name, keys, F.lit(1), monoids.count())


def unique_count(name: str, element: Column, *keys: Column) -> Pipeline:
    """Distinct elements per key, by HyperLogLog."""
    return Pipeline(name, keys, element, monoids.hll())


def top_n(name: str, n: int, element: Column, *keys: Column, weight: Column | None = None) -> Pipeline:
    """The n most frequent elements per key; 0 stands for 10."""
    value = element if weight is None else F.struct(element.alias("item"), weight.alias("weight"))
    return Pipeline(name, keys, value, monoids.TopK(n or 10, weight is not None))


def trending(name: str, half_life: dt.timedelta, *keys: Column, amount: Column | None = None) -> Pipeline:
    """An exponentially decayed sum per key, by event time."""
    return Pipeline(name, keys, F.lit(1.0) if amount is None else amount, monoids.DecayedSum(half_life))


def sessions(events: DataFrame, key: str, time: str, gap: dt.timedelta) -> DataFrame:
    """``entity, started, ended, v``: runs of a key's events with less than ``gap`` between them; it ends a gap after its last event."""
    width = f"{gap // dt.timedelta(microseconds=1)} microseconds"
    rows = events.groupBy(F.col(key).cast("string").alias("entity"), F.session_window(F.col(time), width).alias("s")).agg(F.count(F.lit(1)).alias("v"))
    return rows.select("entity", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "v")


def trailing(pipeline: Pipeline, *spans: dt.timedelta) -> Pipeline:
    """Daily buckets, kept long enough for the longest positive span and a day more; without one, as it was."""
    kept = [s for s in spans if s > dt.timedelta(0)]
    return pipeline.windowed(Window(DAY, max(kept) + DAY)) if kept else pipeline
