"""Tumbling time buckets as integer arithmetic on microseconds.

A bucket is the event time divided by the granularity, truncated towards zero;
bucket 0 is also the all-time bucket of pipelines without a window.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_TIME = 0
DAY, HOUR, MINUTE = dt.timedelta(days=1), dt.timedelta(hours=1), dt.timedelta(minutes=1)


def micros(span: dt.timedelta) -> int:
    return span // dt.timedelta(microseconds=1)


def epoch_micros(at: dt.datetime) -> int:
    """Microseconds since 1970; a time without zone is UTC."""
    at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
    return micros(at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc))


def _quotient(a: int, b: int) -> int:
    return abs(a) // b * (1 if a >= 0 else -1)


@dataclass(frozen=True)
class Window:
    """Granularity of the buckets, and how long after a write a bucket is kept (None: forever)."""

    granularity: dt.timedelta
    retention: dt.timedelta | None = None

    def bucket(self, time: Column) -> Column:
        """The bucket of a TIMESTAMP or TIMESTAMP_NTZ column; NTZ counts in the session's time zone, which should be UTC."""
        width = micros(self.granularity)
        if width <= 0:
            return F.lit(0).cast("bigint")
        return truncated_quotient(F.unix_micros(time.cast("timestamp")), width)

    def bucket_of(self, at: dt.datetime) -> int:
        width = micros(self.granularity)
        return _quotient(epoch_micros(at), width) if width > 0 else 0

    def range(self, start: dt.datetime, end: dt.datetime) -> tuple[int, int]:
        """Buckets of both ends, inclusive; partial buckets at the edges count whole."""
        return self.bucket_of(start), self.bucket_of(end)

    def last(self, now: dt.datetime, span: dt.timedelta) -> tuple[int, int]:
        """The buckets of the last ``span``: as many as it has granules, rounded up, one at least, ending with now's."""
        width = micros(self.granularity)
        high = self.bucket_of(now)
        n = max(1, -(-micros(span) // width)) if width > 0 else 1
        return high - n + 1, high


def truncated_quotient(value: Column, width: int) -> Column:
    """Whole quotient, truncated towards zero."""
    return F.call_function("div", value, F.lit(width))


def daily(retention: dt.timedelta | None = None) -> Window:
    return Window(DAY, retention)


def hourly(retention: dt.timedelta | None = None) -> Window:
    return Window(HOUR, retention)


def minutely(retention: dt.timedelta | None = None) -> Window:
    return Window(MINUTE, retention)
