"""Running a stream as a process, and batches as a queue hands them over."""

from __future__ import annotations

import signal
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.queues import change_rows, queued, sequenced
from .runtime import Bound

#: Exit codes: ended or stopped by a signal; failed while running; never started.
DONE, FAILED, NOT_STARTED = 0, 1, 2


def work(begin: Callable[[], StreamingQuery], poll_seconds: float = 1.0) -> int:
    """Run a query until it ends, fails, or the process is told to stop; the exit code."""
    stopped: list[int] = []
    before = {s: signal.signal(s, lambda n, _: stopped.append(n)) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        try:
            query = begin()
        except Exception as e:
            print(f"could not start: {e}")
            return NOT_STARTED
        try:
            while not query.awaitTermination(poll_seconds):
                if stopped:
                    query.stop()
                    return DONE
        except Exception as e:
            print(f"failed: {e}")
            return FAILED
        return DONE
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def _handler(bound: Bound, shaped: Callable[[DataFrame], DataFrame], item: str) -> Callable[[DataFrame, str, int | None], DataFrame]:
    """A function of a batch, its stream and number that returns ``item, error`` of what is to be delivered again.

    Events that can't be aggregated are, while the others are merged; if the fault is elsewhere, all of them are.
    """

    def handle(rows: DataFrame, stream: str, batch: int | None = None) -> DataFrame:
        events, failed, error = shaped(rows), rows.limit(0), ""
        try:
            bound.apply(events, stream, batch)
        except Exception as e:
            bound.recorder.error(bound.pipeline.name, e)
            failed, error = rows, str(e)
            parts = bound.parted(events)
            if parts is not None:
                try:
                    bound.apply(parts[0], stream, batch)
                    failed = parts[1]
                except Exception as again:
                    bound.recorder.error(bound.pipeline.name, again)
        return failed.select(F.col(item).cast("string").alias("item"), F.lit(error).alias("error"))

    return handle


def shard_handler(bound: Bound, arn: str, sequence: str = "sequence_number", arrival: str = "arrival"):
    """For shard-and-sequence queues."""
    return _handler(bound, lambda rows: sequenced(rows, arn, sequence, arrival), sequence)


def queue_handler(bound: Bound, arn: str, message: str = "message_id", sent_ms: str = "sent_ms"):
    """For message queues."""
    return _handler(bound, lambda rows: queued(rows, arn, message, sent_ms), message)


def change_handler(bound: Bound, keep=None, item: str = "event_id"):
    """For change streams; rows that ``keep`` declines are skipped."""
    return _handler(bound, lambda rows: change_rows(rows, keep), item)
