"""Monoids: how values of one entity and bucket combine.

Every monoid turns event rows into state rows and merges state rows; both are
grouped aggregations, so partial sums happen before any shuffle.  Event rows
have the grouping columns and ``value, t, seq``: the value, the event time in
microseconds and a tie breaker.  State rows have the grouping columns and ``v``.
An unset state is null, which is every monoid's identity.
"""

from __future__ import annotations

import datetime as dt
import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import micros

#: Kinds that have a plan of their own; anything else is custom.
STRUCTURAL = ("sum", "count", "min", "max", "first", "last", "set", "hll", "topk", "bloom", "map", "tuple", "decayed_sum")


class Monoid(ABC):
    """Each has a ``kind``; ``additive`` says that deltas may be combined before they reach the state."""

    additive = False

    @abstractmethod
    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        """State rows ``by, v`` of event rows."""

    @abstractmethod
    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        """One state row per group of state rows."""

    def identity(self) -> Column:
        """What a reader gets where there is no state."""
        return F.lit(None)

    def finalize(self, v: Column) -> Column:
        """The answer that a state stands for."""
        return v

    @property
    def structural(self) -> bool:
        return self.kind in STRUCTURAL


@dataclass(frozen=True)
class Expression(Monoid):
    """A monoid that is a single aggregate expression, in events and in states."""

    kind: str
    lift: Callable[[Column, Column, Column], Column]
    fold: Callable[[Column], Column]
    refold: Callable[[Column], Column]
    empty: Callable[[], Column] = lambda: F.lit(None)
    final: Callable[[Column], Column] = lambda v: v
    additive: bool = False

    def fold_events(self, value: Column, t: Column, seq: Column) -> Column:
        return self.fold(self.lift(value, t, seq))

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        return events.groupBy(*by).agg(self.fold_events(F.col("value"), F.col("t"), F.col("seq")).alias("v"))

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        return states.groupBy(*by).agg(self.refold(F.col("v")).alias("v"))

    def identity(self) -> Column:
        return self.empty()

    def finalize(self, v: Column) -> Column:
        return self.final(v)


def _plain(value: Column, t: Column, seq: Column) -> Column:
    return value


def sum_() -> Expression:
    """Sum of any numeric value; 0 where there is none."""
    return Expression("sum", _plain, F.sum, F.sum, lambda: F.lit(0), additive=True)


def count() -> Expression:
    """Number of events."""
    return Expression("count", lambda value, t, seq: F.lit(1), F.count, F.sum, lambda: F.lit(0).cast("bigint"), additive=True)


def min_() -> Expression:
    return Expression("min", _plain, F.min, F.min)


def max_() -> Expression:
    return Expression("max", _plain, F.max, F.max)


def monotonic(identity: Any) -> Expression:
    """The largest absolute value seen, however late it arrives; ``identity`` where there is none."""
    return Expression("max", _plain, F.max, F.max, lambda: F.lit(identity), lambda v: F.greatest(v, F.lit(identity)))


def _stamped(value: Column, t: Column, seq: Column) -> Column:
    return F.struct(t.alias("t"), seq.alias("seq"), value.alias("v"))


def first() -> Expression:
    """The value of least time, of equal times that of least tie breaker."""
    return Expression("first", _stamped, F.min, F.min, final=lambda v: v["v"])


def last() -> Expression:
    """The value of greatest time, of equal times that of greatest tie breaker."""
    return Expression("last", _stamped, F.max, F.max, final=lambda v: v["v"])


def set_() -> Expression:
    """The distinct values, sorted."""
    return Expression(
        "set", _plain, lambda v: F.array_sort(F.collect_set(v)), lambda v: F.array_sort(F.array_distinct(F.flatten(F.collect_list(v)))), lambda: F.array()
    )


HLL_BITS = 14


def hll(bits: int = HLL_BITS) -> Expression:
    """A HyperLogLog sketch of the distinct values; the answer is the estimate."""
    return Expression(
        "hll", lambda value, t, seq: value.cast("string"), lambda v: F.hll_sketch_agg(v, bits), lambda v: F.hll_union_agg(v),
        final=lambda v: F.coalesce(F.hll_sketch_estimate(v), F.lit(0).cast("bigint")),
    )


def hll_fits(estimate: Column, n: Column, bits: int = HLL_BITS) -> Column:
    """Whether a sketch may tell this estimate of ``n`` different values: it is within ten standard errors, and two values, of them."""
    return F.abs(estimate - n) <= F.lit(10 * 1.04 / math.sqrt(2**bits)) * n + 2


@dataclass(frozen=True)
class Tuple(Monoid):
    """Several expression monoids side by side, each over a field of a struct value; the state is a struct."""

    parts: dict[str, Expression]
    kind = "tuple"

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        each = [m.fold_events(F.col("value")[f], F.col("t"), F.col("seq")).alias(f) for f, m in self.parts.items()]
        return events.groupBy(*by).agg(F.struct(*each).alias("v"))

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        return states.groupBy(*by).agg(F.struct(*[m.refold(F.col("v")[f]).alias(f) for f, m in self.parts.items()]).alias("v"))

    def identity(self) -> Column:
        return F.struct(*[m.identity().alias(f) for f, m in self.parts.items()])

    def finalize(self, v: Column) -> Column:
        return F.struct(*[m.finalize(v[f]).alias(f) for f, m in self.parts.items()])


@dataclass(frozen=True)
class MapMerge(Monoid):
    """Maps combine key by key with an inner monoid."""

    inner: Monoid
    kind = "map"

    def _collected(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("v"))

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        each = events.select(*by, "t", "seq", F.explode("value").alias("k", "value"))
        return self._collected(self.inner.aggregate(each, [*by, "k"]), by)

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        return self._collected(self.inner.merge(states.select(*by, F.explode("v").alias("k", "v")), [*by, "k"]), by)

    def finalize(self, v: Column) -> Column:
        return F.transform_values(v, lambda _, x: self.inner.finalize(x))


@dataclass(frozen=True)
class TopK(Monoid):
    """Heavy hitters with counts, as a Misra-Gries summary of k items.

    The value is an item, or a struct ``item, weight``.  Counts are exact, then
    reduced once: with t the (k+1)-th largest count, items above t stay with
    their count less t.  The result does not depend on the order of events, is
    exact with at most k items, and never off by more than total / (k + 1).
    Stored summaries are merged all at once, never pair by pair.
    """

    k: int = 10
    weighted: bool = False
    kind = "topk"

    def _reduced(self, counts: DataFrame, by: list[str]) -> DataFrame:
        ranked = counts.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("count"), F.asc("item"))))
        top = ranked.filter(F.col("_rank") <= self.k + 1).groupBy(*by).agg(
            F.coalesce(F.max(F.when(F.col("_rank") == self.k + 1, F.col("count"))), F.lit(0).cast("bigint")).alias("_cut"),
            F.collect_list(F.struct((-F.col("count")).alias("minus"), "item")).alias("_all"),
        )
        # Sorted by falling count, then item.
        kept = F.filter(F.array_sort("_all"), lambda x: -x["minus"] > F.col("_cut"))
        return top.select(*by, F.transform(kept, lambda x: F.struct(x["item"].alias("item"), (-x["minus"] - F.col("_cut")).alias("count"))).alias("v"))

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        item, weight = (F.col("value.item"), F.col("value.weight")) if self.weighted else (F.col("value"), F.lit(1))
        counts = events.groupBy(*by, item.alias("item")).agg(F.sum(weight).cast("bigint").alias("count"))
        return self._reduced(counts, by)

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        each = states.select(*by, F.explode("v").alias("x"))
        return self._reduced(each.groupBy(*by, F.col("x.item").alias("item")).agg(F.sum("x.count").alias("count")), by)


@dataclass(frozen=True)
class Bloom(Monoid):
    """A Bloom filter sized for ``capacity`` values at false-positive rate ``rate``.

    The state is the filter's non-empty 4 KB pages; merging ORs them.
    """

    capacity: int = 100_000
    rate: float = 0.01
    kind = "bloom"

    @property
    def bits(self) -> int:
        return math.ceil(-self.capacity * math.log(self.rate) / math.log(2) ** 2)

    @property
    def hashes(self) -> int:
        return max(1, math.ceil(self.bits / self.capacity * math.log(2)))

    def positions(self, value: Column) -> Column:
        """The bits of a value, by double hashing; null has none."""
        text, m = value.cast("string"), F.lit(self.bits)
        h1, h2 = F.pmod(F.xxhash64(text), m), F.pmod(F.xxhash64(text, F.lit(7)), m)
        each = F.array(*[F.pmod(h1 + F.lit(i) * h2, m) for i in range(self.hashes)])
        return F.when(value.isNotNull(), each)

    def _pages(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "bits"))).alias("v"))

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        # Distinct values first: they are hashed, while building pages sorts its rows.
        values = events.select(*by, F.col("value").alias("value")).distinct()
        each = values.select(*by, F.explode(self.positions(F.col("value"))).alias("p")).withColumn("p", F.col("p") + 1)
        pages = each.groupBy(*by, F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        return self._pages(pages, by)

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        each = states.select(*by, F.explode("v").alias("x")).select(*by, "x.page", "x.bits")
        return self._pages(each.groupBy(*by, "page").agg(F.bitmap_or_agg("bits").alias("bits")), by)

    def finalize(self, v: Column) -> Column:
        """``bits, hashes, set_bits, approx_size``."""
        ones = F.aggregate(F.coalesce(v, F.array()), F.lit(0).cast("bigint"), lambda n, x: n + F.bitmap_count(x["bits"]))
        size = -F.lit(self.bits / self.hashes) * F.log1p(-ones / F.lit(float(self.bits)))
        return F.struct(F.lit(self.bits).alias("bits"), F.lit(self.hashes).alias("hashes"), ones.alias("set_bits"), F.round(size).cast("bigint").alias("approx_size"))

    def fits(self, shape: Column, n: Column) -> Column:
        """Whether a filter of this shape may hold ``n`` different values: its set bits are within ten standard deviations, and two values, of theirs."""
        m, load = F.lit(float(self.bits)), n * F.lit(self.hashes / self.bits)
        clear = F.exp(-load)
        spread = F.sqrt(F.greatest(m * (clear - (1 + load) * clear * clear), F.lit(0.0)))
        return F.abs(shape["set_bits"] - m * (1 - clear)) <= 10 * spread + 2 * self.hashes

    def equal(self, a: Column, b: Column) -> Column:
        """Whether two states have the same bits; null is the empty filter."""
        return F.coalesce(a, F.array()) == F.coalesce(b, F.array())

    def contains(self, states: DataFrame, asked: DataFrame, by: list[str], value: str, members: DataFrame | None = None) -> DataFrame:
        """``asked`` with a boolean ``member``: whether each row's value may be in its group's filter; no filter: no.

        With the event rows ``by, value`` that the filters were made of as ``members``, what passes
        is looked up among them, and the answer is exact however full the filters are.
        """
        keys = [*by, value]
        each = asked.select(*keys).distinct().select(*keys, F.explode_outer(self.positions(F.col(value))).alias("_p")).withColumn("_p", F.col("_p") + 1)
        each = each.select(*keys, F.bitmap_bucket_number("_p").alias("page"), F.bitmap_bit_position("_p").alias("_bit"))
        pages = states.select(*by, F.explode("v").alias("x")).select(*by, "x.page", "x.bits")
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.call_function("getbit", byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
        found = each.join(pages, [*by, "page"], "left").groupBy(*keys).agg(F.min(hit).alias("member"))
        if members is not None:
            found = found.filter("member").join(members.select(*by, F.col("value").alias(value)).distinct(), keys, "left_semi")
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "member")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return asked.join(found, same, "left").drop(*[f"_{k}" for k in keys]).withColumn("member", F.coalesce("member", F.lit(False)))


@dataclass(frozen=True)
class DecayedSum(Monoid):
    """A sum whose parts halve every half-life; the state is ``value`` as of the latest time ``t``.

    Events are first summed in stretches of RUN half-lives, each towards its own
    end, so that no power over- or underflows; stretches are then combined.
    """

    half_life: dt.timedelta
    kind = "decayed_sum"
    additive = True
    RUN = 256

    def __post_init__(self):
        if micros(self.half_life) <= 0:
            raise ValueError("a half-life must be positive")

    @property
    def _us(self) -> float:
        return float(micros(self.half_life))

    def _power(self, later: Column, earlier: Column) -> Column:
        return F.pow(F.lit(2.0), -(later - earlier) / F.lit(self._us))

    def _combined(self, rows: DataFrame, by: list[str]) -> DataFrame:
        width = micros(self.half_life) * self.RUN
        rows = rows.withColumn("_run", F.floor(F.col("t") / F.lit(float(width))).cast("bigint"))
        end = (F.col("_run") + 1) * F.lit(width)
        runs = rows.groupBy(*by, "_run").agg(F.sum(F.col("x") * self._power(end, F.col("t"))).alias("s"), F.max("t").alias("t"))
        runs = runs.select(*by, (F.col("s") * self._power(F.col("t"), end)).alias("x"), "t")
        # Few rows per group are left: a pass for the latest time within the sums.
        pairs = F.collect_list(F.struct("x", "t"))
        whole = runs.groupBy(*by).agg(F.max("t").alias("t"), pairs.alias("p"))
        value = F.aggregate("p", F.lit(0.0), lambda a, y: a + y["x"] * self._power(F.col("t"), y["t"]))
        return whole.select(*by, F.struct(value.alias("value"), "t").alias("v"))

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        return self._combined(events.select(*by, F.col("value").cast("double").alias("x"), "t"), by)

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        return self._combined(states.filter("v is not null").select(*by, F.col("v.value").alias("x"), F.col("v.t").alias("t")), by)

    def finalize(self, v: Column) -> Column:
        return F.coalesce(v["value"], F.lit(0.0))

    def at(self, v: Column, when: Column) -> Column:
        """The value as of a time in microseconds, before or after the state's; unset: 0."""
        return F.coalesce(v["value"] * self._power(when, v["t"]), F.lit(0.0))


@dataclass(frozen=True)
class Custom(Monoid):
    """Any fold, in event order per group: ``combine(a, b)`` over values, from ``start``.

    Values of one group meet in one Python call; prefer a built-in monoid for
    groups without bound.
    """

    combine: Callable[[Any, Any], Any]
    start: Any
    value_type: str
    kind = "custom"

    def _folded(self, rows: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
        combine, start = self.combine, self.start

        def fold(group: pd.DataFrame) -> pd.DataFrame:
            total = start
            for x in (group.sort_values(order, kind="stable") if order else group)[column]:
                total = combine(total, x)
            return group[by].head(1).assign(v=[total])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)
        return rows.groupBy(*by).applyInPandas(fold, f"{fields}, v {self.value_type}")

    def aggregate(self, events: DataFrame, by: list[str]) -> DataFrame:
        return self._folded(events.select(*by, "value", "t", "seq"), by, "value", ["t", "seq"])

    def merge(self, states: DataFrame, by: list[str]) -> DataFrame:
        return self._folded(states.select(*by, "v"), by, "v", [])

    def identity(self) -> Column:
        return F.lit(self.start)


def distinct_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """``by, n``: how many different values each group of event rows has, null aside; exact, and spread over tasks by value."""
    return events.select(*by, F.col("value").alias("value")).distinct().groupBy(*by).agg(F.count("value").alias("n"))


def settled(n: Column, fits: Column) -> Column:
    """An exact count beside a sketch of the same values; a sketch that doesn't fit it is an error, not an answer."""
    return F.when(fits, n).otherwise(F.raise_error(F.concat(F.lit("a sketch doesn't fit the count "), F.coalesce(n.cast("string"), F.lit("null")))))


#: What a named query or a description may ask for by kind.
REGISTRY: dict[str, Callable[..., Monoid]] = {
    "sum": sum_, "count": count, "min": min_, "max": max_, "monotonic": monotonic, "first": first, "last": last, "set": set_,
    "hll": hll, "topk": TopK, "bloom": Bloom, "map": MapMerge, "tuple": Tuple, "decayed_sum": DecayedSum, "custom": Custom,
}
