"""A pipeline: keys, value, monoid and window, compiled to one aggregation plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid
from ..functions.windows import Window


class PipelineError(ValueError):
    """A pipeline that lacks a part it needs."""


@dataclass(frozen=True)
class Pipeline:
    """What an aggregation is, wherever it runs.

    ``keys`` are columns: an event counts under each of them, twice where two
    are equal and not at all where one is null.  ``event_id`` identifies an
    event for dedup and breaks ties of time.  Without a window all events share
    bucket 0.
    """

    name: str
    keys: tuple[Column, ...] = ()
    value: Column | None = None
    monoid: Monoid | None = None
    window: Window | None = None
    event_time: Column = field(default_factory=lambda: F.col("event_time"))
    event_id: Column = field(default_factory=lambda: F.col("event_id"))
    where: Column | None = None
    store: str | None = None

    def key_by(self, key: Column) -> Pipeline:
        return replace(self, keys=(key,))

    def key_by_many(self, keys: Sequence[Column]) -> Pipeline:
        """Several keys per event: rollups, cubes and grouping sets."""
        return replace(self, keys=tuple(keys))

    def of(self, value: Column) -> Pipeline:
        return replace(self, value=value)

    def aggregate(self, monoid: Monoid, window: Window | None = None) -> Pipeline:
        return replace(self, monoid=monoid, window=window)

    def windowed(self, window: Window | None) -> Pipeline:
        return replace(self, window=window)

    def filtered(self, condition: Column) -> Pipeline:
        return replace(self, where=condition)

    def at(self, event_time: Column, event_id: Column | None = None) -> Pipeline:
        return replace(self, event_time=event_time, event_id=self.event_id if event_id is None else event_id)

    def store_in(self, path: str) -> Pipeline:
        return replace(self, store=path)

    def validated(self, store: bool = False) -> Pipeline:
        """This pipeline, or an error that names what is missing."""
        missing = [what for what, there in (("key", self.keys), ("value", self.value is not None), ("monoid", self.monoid), ("store", self.store or not store)) if not there]
        if missing:
            raise PipelineError(f"pipeline {self.name!r} has no {' and no '.join(missing)}")
        return self

    def bucket(self) -> Column:
        return self.window.bucket(self.event_time) if self.window else F.lit(0).cast("bigint")

    def lifted(self, events: DataFrame) -> DataFrame:
        """A row per event and key: ``entity, bucket, value, t, seq``."""
        self.validated()
        rows = events if self.where is None else events.filter(self.where)
        entity = self.keys[0] if len(self.keys) == 1 else F.explode(F.array(*[k.cast("string") for k in self.keys]))
        rows = rows.select(
            entity.cast("string").alias("entity") if len(self.keys) == 1 else entity.alias("entity"), self.bucket().alias("bucket"), self.value.alias("value"),
            F.unix_micros(self.event_time.cast("timestamp")).alias("t"), self.event_id.alias("seq"),
        )
        return rows.filter("entity is not null")

    def compile(self, events: DataFrame) -> DataFrame:
        """State rows ``entity, bucket, v`` of events."""
        return self.monoid.aggregate(self.lifted(events), ["entity", "bucket"])

    def merge(self, *states: DataFrame) -> DataFrame:
        """One state of several, such as a view and a delta."""
        first, *rest = states
        for s in rest:
            first = first.unionByName(s)
        return self.monoid.merge(first, ["entity", "bucket"])
