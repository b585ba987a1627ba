"""Value buckets: coarse classes of a counter, for indexes that should only see rare changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import truncated_quotient


def log_bucket(v: Column) -> Column:
    """The number of decimal digits less one; 0 below 1."""
    return F.when(v < 1, 0).otherwise(F.floor(F.log10(v.cast("double")))).cast("int")


def linear_bucket(v: Column, band: int) -> Column:
    """Whole multiples of the band, truncated; a band that isn't positive counts as 1."""
    return truncated_quotient(v, band if band > 0 else 1)


def manual_bucket(v: Column, breaks: list[int]) -> Column:
    """How many of the ascending break points are at most the value."""
    if any(a > b for a, b in zip(breaks, breaks[1:], strict=False)):
        raise ValueError("break points must ascend")
    total = F.lit(0)
    for b in breaks:
        total = total + (v >= b).cast("int")
    return total


def sticky(inner: Callable[[Column], Column], band: float, previous: Column, v: Column) -> Column:
    """The bucket after ``previous``, which only changes once the value is ``band`` beyond the boundary.

    A previous bucket below 0 stands for none; without a band the inner bucket
    is taken as it is.
    """
    naive = inner(v)
    if band <= 0:
        return naive
    up = inner((v / F.lit(1 + band)).cast("bigint")) > previous
    down = inner((v * F.lit(1 + band)).cast("bigint")) < previous
    return F.when((previous < 0) | (naive == previous), naive).when((naive > previous) & up, naive).when((naive < previous) & down, naive).otherwise(previous)


@dataclass(frozen=True)
class Sticky:
    """Sticky buckets along each key's history."""

    inner: Callable[[Column], Column]
    band: float

    def along(self, rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
        """``rows`` with ``previous_bucket`` (-1 at first) and ``bucket``, folded per key in order.

        The three inner buckets that a step can need are computed beforehand as
        columns; the fold itself reads sorted batches and keeps one number.
        """
        v = F.col(value)
        wide = rows.withColumns({
            "_naive": self.inner(v).cast("bigint"),
            "_up": self.inner((v / F.lit(1 + self.band)).cast("bigint")).cast("bigint"),
            "_down": self.inner((v * F.lit(1 + self.band)).cast("bigint")).cast("bigint"),
        })
        band = self.band

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bucket = object(), -1
            for batch in batches:
                before, after = [], []
                for k, naive, up, down in zip(*(batch[c].to_pylist() for c in (key, "_naive", "_up", "_down")), strict=True):
                    if k != now:
                        now, bucket = k, -1
                    before.append(bucket)
                    if band <= 0 or bucket < 0 or (naive > bucket < up) or (naive < bucket > down):
                        bucket = naive
                    after.append(bucket)
                kept = batch.drop_columns(["_naive", "_up", "_down"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(before, pa.int64()), pa.array(after, pa.int64())], [*kept.schema.names, "previous_bucket", "bucket"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return wide.repartition(key).sortWithinPartitions(key, *order).mapInArrow(fold, f"{schema}, previous_bucket bigint, bucket bigint")


def transition(inner: Callable[[Column], Column], old: Column, new: Column) -> Column:
    """``old, new, changed``: the buckets of two values."""
    return F.struct(inner(old).alias("old"), inner(new).alias("new"), (inner(old) != inner(new)).alias("changed"))
