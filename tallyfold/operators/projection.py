"""Writing an index only when a counter changes its bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import Sticky, sticky

Bucket = Callable[[Column], Column]


def changes(rows: DataFrame, inner: Bucket, *, key: str = "pk", old: str = "old_v", new: str = "new_v", band: float = 0.0) -> DataFrame:
    """Change rows whose bucket differs, with ``old_bucket`` and ``new_bucket``.

    A missing old value is a first observation (-1), a missing new value a
    deletion, which counts as 0; rows without a key are left out.
    """
    before = F.when(F.col(old).isNull(), F.lit(-1)).otherwise(inner(F.col(old)))
    after = sticky(inner, band, F.col("old_bucket"), F.coalesce(F.col(new), F.lit(0).cast("bigint")))
    return rows.filter(F.col(key).isNotNull()).withColumn("old_bucket", before.cast("int")).withColumn("new_bucket", after.cast("int")).filter("old_bucket <> new_bucket")


def history_changes(rows: DataFrame, inner: Bucket, *, key: str, order: list[str], value: str) -> DataFrame:
    """Rows of a key's history whose bucket differs from the one before; the first of a key always does."""
    v = inner(F.col(value)).cast("bigint")
    before = F.lag("bucket").over(W.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("bucket", v)
    return rows.withColumn("previous_bucket", F.coalesce(before, F.lit(-1).cast("bigint"))).filter("bucket <> previous_bucket")


def sticky_changes(rows: DataFrame, inner: Bucket, band: float, *, key: str, order: list[str], value: str) -> DataFrame:
    """The same with sticky buckets, which need the value to pass a boundary by ``band``."""
    return Sticky(inner, band).along(rows, key, order, value).filter("bucket <> previous_bucket")
