"""Laws that a monoid must keep, checked over events of one's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .monoids import Monoid


def _comparable(v: Column, kind: T.DataType) -> Column:
    return F.array_sort(F.map_entries(v)) if isinstance(kind, T.MapType) else v


def broken(monoid: Monoid, events: DataFrame, by: list[str], parts: int = 3, tolerance: float = 1e-9) -> list[str]:
    """Names of the laws that don't hold for ``events``, rows of ``by``, ``value``, ``t`` and ``seq``.

    Events are dealt into parts by a hash of ``seq``.  Merging the parts' states, in any order and grouping, must give the
    answer of all events at once; a state of no events must change nothing.  Fractions may differ by ``tolerance`` of
    themselves.
    """
    states = [monoid.aggregate(events.filter(F.pmod(F.xxhash64("seq"), F.lit(parts)) == k), by) for k in range(parts)]
    whole, none = monoid.aggregate(events, by), monoid.aggregate(events.filter("false"), by)

    def merged(*frames: DataFrame) -> DataFrame:
        return monoid.merge(reduce(DataFrame.unionByName, frames), by)

    ways = {
        "aggregate of parts": merged(*states),
        "order": merged(*reversed(states)),
        "grouping to the left": reduce(merged, states),
        "grouping to the right": reduce(lambda a, b: merged(b, a), reversed(states)),
        "identity": merged(whole, none),
    }

    def answers(frame: DataFrame, name: str) -> DataFrame:
        rows = frame.select(*[F.col(c).alias(f"{name}_{c}") for c in by], monoid.finalize(F.col("v")).alias(name))
        return rows.withColumn(name, _comparable(F.col(name), rows.schema[name].dataType))

    want = answers(whole, "want")
    real = isinstance(want.schema["want"].dataType, (T.DoubleType, T.FloatType))

    def holds(frame: DataFrame) -> bool:
        got = answers(frame, "got")
        both = want.join(got, reduce(Column.__and__, [F.col(f"want_{c}").eqNullSafe(F.col(f"got_{c}")) for c in by]), "full")
        same = F.col("want").eqNullSafe(F.col("got"))
        if real:
            same = same | F.coalesce(F.abs(F.col("want") - F.col("got")) <= tolerance * F.abs("want"), F.lit(False))
        return both.filter(~same).isEmpty()

    return [law for law, frame in ways.items() if not holds(frame)]
