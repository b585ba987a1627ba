"""Counts, errors and latencies of pipelines, and load signals from progress reports."""

from __future__ import annotations

import time
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass

#: Latencies that are kept per pipeline.
RING = 4096


@dataclass(frozen=True)
class Latencies:
    count: int
    p50: float
    p95: float
    p99: float
    most: float


def percentile(ordered: list[float], p: float) -> float:
    """The value at index floor((n - 1) * p) of a sorted list; 0 if it is empty."""
    return ordered[int((len(ordered) - 1) * p)] if ordered else 0.0


class Recorder:
    """Metrics in memory."""

    def __init__(self):
        self._events: dict[str, int] = defaultdict(int)
        self._errors: dict[str, int] = defaultdict(int)
        self._retries: dict[str, int] = defaultdict(int)
        self._skips: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self._last: dict[str, str] = {}
        self._times: dict[str, deque[float]] = defaultdict(lambda: deque(maxlen=RING))

    def events(self, pipeline: str, n: int) -> None:
        self._events[pipeline] += n

    def error(self, pipeline: str, error: Exception) -> None:
        self._errors[pipeline] += 1
        self._last[pipeline] = str(error)

    def retry(self, pipeline: str) -> None:
        self._retries[pipeline] += 1

    def skip(self, pipeline: str, cause: str, n: int) -> None:
        """Events that were not counted, by cause: ``dedup`` or ``debounce``."""
        self._skips[pipeline][cause] += n

    def latency(self, pipeline: str, seconds: float) -> None:
        self._times[pipeline].append(seconds)

    def snapshot(self, pipeline: str) -> dict:
        t = sorted(self._times[pipeline])
        return {
            "events": self._events[pipeline], "errors": self._errors[pipeline], "last_error": self._last.get(pipeline),
            "retries": self._retries[pipeline], "skips": dict(self._skips[pipeline]),
            "latency": Latencies(len(t), percentile(t, 0.5), percentile(t, 0.95), percentile(t, 0.99), t[-1] if t else 0.0),
        }


class EventsPerSecond:
    """A rate from a counter that only grows; 0 at first and after a reset."""

    def __init__(self, read: Callable[[], int], clock: Callable[[], float] = time.monotonic):
        self._read, self._clock, self._before = read, clock, None

    def sample(self) -> float:
        now, n = self._clock(), self._read()
        before, self._before = self._before, (now, n)
        if before is None or n < before[1] or now <= before[0]:
            return 0.0
        return (n - before[1]) / (now - before[0])


def emit(signal: Callable[[], float], sink: Callable[[float], None], samples: int, wait: Callable[[], None] = lambda: None, on_error: Callable[[Exception], None] | None = None) -> None:
    """Hand a signal to a sink again and again; errors go to ``on_error`` and don't end it."""
    for _ in range(samples):
        try:
            sink(signal())
        except Exception as e:
            if on_error:
                on_error(e)
        wait()
