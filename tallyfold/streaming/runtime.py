"""Micro-batches into state tables: dedup, debounce, aggregate, commit.

What a batch accepts and what it adds are committed together, so an event that
fails is neither lost nor counted twice when its batch runs again.  There is no
watermark: late events land in their own buckets.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.windows import micros
from ..operators.dedup import debounced, deduplicated, unseen
from ..operators.pipeline import Pipeline
from .metrics import Recorder
from .state import COMMIT_ATTEMPTS, StateTable, VersionConflict

#: Halvings by which events that can't be aggregated are told from the rest of their batch, and parts that are followed at once.
HALVINGS, FOLLOWED = 16, 32


@dataclass(frozen=True)
class Options:
    """``key_debounce``/``value_debounce``: least time between accepted events of a key, or of a key and value.

    ``debounce_kept``: how far behind the newest accepted event a key's time is still remembered (None: forever);
    events later than that may be accepted once too often.
    """

    dedup: bool = False
    key_debounce: dt.timedelta | None = None
    value_debounce: dt.timedelta | None = None
    debounce_kept: dt.timedelta | None = None
    attempts: int = 3
    backoff: float = 0.05
    longest_backoff: float = 5.0
    dead_letters: Callable[[DataFrame, Exception], None] | None = None


def backoff(attempt: int, base: float, longest: float, jitter: float = 0.0) -> float:
    """Seconds before the next attempt: doubled each time, within ``longest``, and up to half more by jitter 0 to 1."""
    return min(longest, base * 2 ** (attempt - 1)) * (1 + jitter / 2)


class Bound:
    """A pipeline with its table and options."""

    def __init__(self, pipeline: Pipeline, table: StateTable, options: Options | None = None, recorder: Recorder | None = None):
        self.pipeline, self.table = pipeline.validated(), table
        self.options, self.recorder = options or Options(), recorder or Recorder()

    def apply(self, events: DataFrame, stream: str, batch: int | None, now: dt.datetime | None = None) -> int:
        """One batch, once; if another writer commits meanwhile, again on top of that."""
        for attempt in range(1, COMMIT_ATTEMPTS + 1):
            try:
                return self._apply(events, stream, batch, now)
            except VersionConflict:
                self.recorder.retry(self.pipeline.name)
                if attempt == COMMIT_ATTEMPTS:
                    raise

    def _apply(self, events: DataFrame, stream: str, batch: int | None, now: dt.datetime | None) -> int:
        p, o = self.pipeline, self.options
        if batch is not None and self.table.applied(stream, batch):
            return self.table.version()
        began, base = time.monotonic(), self.table.version()
        rows, ids, last, kept, skipped = events.withColumn("_event_id", p.event_id), None, None, [], {}
        arrived = n = events.count()  # a scan of no columns

        def counted(left: DataFrame, cause: str) -> DataFrame:
            """What is left, computed once for its count, its state and its ids."""
            nonlocal n
            kept.append(left.persist())
            now_left = kept[-1].count()
            skipped[cause], n = skipped.get(cause, 0) + n - now_left, now_left
            return kept[-1]

        try:
            first_key = p.keys[0]
            for wait, value in ((o.key_debounce, None), (o.value_debounce, p.value)):  # key, then value, then dedup
                if wait is None:
                    continue
                before = self.table.last_accepted(base)
                kind = "key" if value is None else "value"
                mine = None if before is None else before.filter(F.col("kind") == kind).select("key", "t")
                rows = counted(debounced(rows, first_key, p.event_time, wait, ["_event_id"], value, mine), "debounce")
                name = first_key.cast("string") if value is None else F.concat(first_key.cast("string"), F.lit("\x00"), F.coalesce(value.cast("string"), F.lit("\x00")))
                fresh = rows.select(F.lit(kind).alias("kind"), name.alias("key"), F.unix_micros(p.event_time.cast("timestamp")).alias("t")).filter("key <> ''")
                old = fresh if before is None else fresh.unionByName(before.filter(F.col("kind") == kind))
                latest = self._remembered(old.groupBy("kind", "key").agg(F.max("t").alias("t")))
                last = latest if last is None else last.unionByName(latest)
            if o.dedup:
                seen = self.table.seen(base, now).withColumnRenamed("event_id", "_event_id")
                rows = counted(unseen(deduplicated(rows, "_event_id"), seen, "_event_id"), "dedup")
                ids = rows.select(F.col("_event_id").cast("string").alias("event_id"))
            version = self.table.merge(p.compile(rows), stream=stream, batch=batch, ids=ids, last=last, now=now, base=base if kept else None)
        finally:
            for frame in kept:
                frame.unpersist()
        self.recorder.latency(p.name, time.monotonic() - began)
        self.recorder.events(p.name, arrived)
        for cause, many in skipped.items():
            self.recorder.skip(p.name, cause, many)
        return version

    def _remembered(self, latest: DataFrame) -> DataFrame:
        """Times that are not too far behind the newest."""
        if self.options.debounce_kept is None:
            return latest
        newest = latest.agg(F.max("t")).first()[0]
        return latest if newest is None else latest.filter(F.col("t") >= newest - micros(self.options.debounce_kept))

    def parted(self, events: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """The events that can be aggregated, and those that can't; None if all can, so that the fault is elsewhere.

        Parts by a hash of the event's id are aggregated to nowhere, and those that fail halved.  Where very many
        fail, halving ends earlier, and good events go with bad ones.
        """
        hashed = F.xxhash64(F.coalesce(self.pipeline.event_id.cast("string"), F.lit("")))

        def fails(part: DataFrame) -> bool:
            try:
                self.pipeline.compile(part).write.format("noop").mode("overwrite").save()
            except Exception:
                return True
            return False

        def among(parts: list[int], bits: int):
            return F.pmod(hashed, F.lit(1 << bits)).isin(parts)

        bad, bits = [0], 0
        if not fails(events):
            return None
        while bits < HALVINGS and len(bad) <= FOLLOWED:
            halves = [h for x in bad for h in (x, x + (1 << bits))]
            found = [h for h in halves if fails(events.filter(among([h], bits + 1)))]
            if not found:  # only together do they fail
                break
            bad, bits = found, bits + 1
        return events.filter(~among(bad, bits)), events.filter(among(bad, bits))

    def apply_with_retry(self, events: DataFrame, stream: str, batch: int | None) -> None:
        """Attempts with growing waits; then events that can't be aggregated go to dead letters, if there are any.

        The rest is applied; if it can't be, the whole batch goes there, and the stream goes on.  After a
        crash between the two the dead letters are written again.
        """
        for attempt in range(1, self.options.attempts + 1):
            try:
                self.apply(events, stream, batch)
                return
            except Exception as e:
                self.recorder.error(self.pipeline.name, e)
                if attempt == self.options.attempts:
                    if self.options.dead_letters is None:
                        raise
                    self._without_bad(events, stream, batch, e)
                    return
                self.recorder.retry(self.pipeline.name)
                time.sleep(backoff(attempt, self.options.backoff, self.options.longest_backoff))

    def _without_bad(self, events: DataFrame, stream: str, batch: int | None, error: Exception) -> None:
        parts = self.parted(events)
        if parts is None:
            self.options.dead_letters(events, error)
            return
        good, bad = parts
        self.options.dead_letters(bad, error)
        try:
            self.apply(good, stream, batch)
        except Exception as e:
            self.recorder.error(self.pipeline.name, e)
            self.options.dead_letters(good, e)


def to_folder(path: str) -> Callable[[DataFrame, Exception], None]:
    """Dead letters as JSON lines below ``path``, each with its ``_error``."""
    return lambda events, error: events.withColumn("_error", F.lit(str(error).split("\n")[0])).write.mode("append").json(path)


def start(stream: DataFrame, bound: list[Bound], checkpoint: str, *, name: str = "stream", once: bool = True, interval: str | None = None) -> StreamingQuery:
    """Run pipelines over one stream, each batch to all of them before it counts as done.

    With ``once`` what is there is worked off and the query ends.
    """
    if not bound:
        raise ValueError("no pipeline to run")

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist() if len(bound) > 1 else rows
        try:
            for b in bound:
                b.apply_with_retry(rows, name, number)
        finally:
            if len(bound) > 1:
                rows.unpersist()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval or "1 second")
    return writer.start()


def run(stream: DataFrame, pipeline: Pipeline, table: StateTable, checkpoint: str, options: Options | None = None, name: str = "stream") -> None:
    """Work off what is there for one pipeline."""
    start(stream, [Bound(pipeline, table, options)], checkpoint, name=name).awaitTermination()


def bootstrap(capture: Callable[[], str], scan: Callable[[], DataFrame], bound: Bound) -> str:
    """Merge a snapshot and return the token, taken before the scan, from which the live stream goes on."""
    token = capture()
    bound.apply(scan(), "bootstrap", None)
    return token


def replay(archive: DataFrame, bound: Bound) -> int:
    """Merge an archive into a table, as a rule a shadow that an alias is then moved to."""
    return bound.apply(archive, "replay", None)
