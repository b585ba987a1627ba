"""Two-stage ranking: recall by relevance, then score with counters; and pages of the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates recalled, and results.
RECALL, TOP = 200, 20


def popularity_score(relevance: Column, recent: Column, total: Column) -> Column:
    # The formula and its weights.
    return relevance * (1 + F.log10(recent + 1)) * (1 + 0.2 * F.log10(total + 1))


def rerank(
    candidates: DataFrame, total: DataFrame, recent: DataFrame, *, recall: int = RECALL, top: int = TOP,
    score: Callable[[Column, Column, Column], Column] = popularity_score, item: str = "id", relevance: str = "relevance",
) -> DataFrame:
    """The ``top`` of the ``recall`` most relevant candidates by score, ties by id.

    ``total`` and ``recent`` have ``entity, v``; a missing counter is 0.
    """
    found = candidates.orderBy(F.desc(relevance), item).limit(recall)
    entity = F.col(item).cast("string")
    # At most ``recall`` ids go out to where the counters are; only their counters come back.
    wanted = F.broadcast(found.select(entity.alias("entity")))
    for name, counts in (("total", total), ("recent", recent)):
        side = counts.join(wanted, "entity", "left_semi").select(F.col("entity").alias(f"_{name}"), F.col("v").alias(name))
        found = found.join(side, entity == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    return found.withColumn("score", score(F.col(relevance), F.col("recent"), F.col("total"))).orderBy(F.desc("score"), item).limit(top)


def page(ranked: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) of a bounded ranked list, by position."""
    return ranked.withColumn("position", F.row_number().over(W.orderBy(*order))).filter(F.col("position").between((number - 1) * size + 1, number * size))


def page_after(rows: DataFrame, score: str, item: str, size: int, after: tuple | None = None) -> DataFrame:
    """The next page by falling score, then id, after the last row's ``(score, id)``; without a sort of all before it."""
    if after is not None:
        s, i = after
        rows = rows.filter((F.col(score) < F.lit(s)) | ((F.col(score) == F.lit(s)) & (F.col(item) > F.lit(i))))
    return rows.orderBy(F.desc(score), item).limit(size)
