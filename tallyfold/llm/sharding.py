"""Sharding by Karmarkar-Karp differencing, with equal texts kept together.

Groups of equal texts are dealt into blocks of bounded size.  Each block is
differenced into as many parts as there are shards; a part then counts as one
indivisible item of the next level, until the items fit one last differencing.
Groups too large for their block's evenness go to the last level as they are,
so that smaller parts can make up for them.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SHARDS = 40
#: Bytes that each document counts besides its text.
OVERHEAD = 16
#: Items differenced in one task, about.
BLOCK_ITEMS = 8192
#: The last differencing, on the driver, has at most the parts of so many blocks, besides LARGE groups. Where there are
#: more groups than that, they are dealt into so many blocks at least: many small parts balance better than few large ones.
LAST_BLOCKS = 256
#: Groups above 1 / LARGE of all bytes, at most LARGE of them, skip the blocks.
LARGE = 4096
#: Rows of a shard that are numbered in one task.
SLOT_ROWS = 4096


def differenced(sizes: list[int], ways: int) -> list[int]:
    """The part, 0 to ways - 1, of each item.

    Every item begins as a partial partition with all its bytes in one part.
    The two partials with the largest spread are combined, the largest part of
    one with the smallest of the other, until one is left.  Parts are numbered
    by falling bytes.  Ties go by position, so reruns agree.
    """
    if not sizes:
        return []
    # Of a partial only the parts that hold something are kept, largest first: (bytes, members) with members nested pairs.
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        parts, free = [], ways - len(a)
        for k, x in enumerate(b):  # b's largest meets a's smallest, an empty one first
            at = ways - 1 - k
            if k < free:
                parts.append(x)
            else:
                y = a[at]
                parts.append((x[0] + y[0], (x[1], y[1])))
        parts += a[: len(a) - max(0, len(b) - free)]
        parts.sort(key=lambda p: -p[0])
        low = parts[-1][0] if len(parts) == ways else 0
        heapq.heapreplace(heap, (low - parts[0][0], fresh, parts))
        fresh += 1
    out = [0] * len(sizes)
    for part, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                out[x] = part
    return out


def assigned(items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(item, shard)`` for items with columns ``item`` (a unique string) and ``size``."""

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("item", "ascending")])
        parts = differenced(group["size"].to_pylist(), shards)
        return pa.table({"item": group["item"], "size": group["size"], "block": group["block"], "part": pa.array(parts, pa.int32())})

    known = items.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    large = items.filter(F.col("size") > F.lit((known["bytes"] or 0) / LARGE))
    small = items.filter(F.col("size") <= F.lit((known["bytes"] or 0) / LARGE))
    n = known["n"]
    levels = []
    # A level's item names the block and the part of the level below.
    while n > LAST_BLOCKS * shards:
        blocks = max(LAST_BLOCKS, -(-n // BLOCK_ITEMS))
        dealt = small.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        done = checkpointed(dealt.groupBy("block").applyInArrow(block, "item string, size bigint, block bigint, part int"))
        levels.append(done)
        small = done.groupBy("block", "part").agg(F.sum("size").alias("size")).select(F.concat_ws(":", "block", "part").alias("item"), "size")
        n = blocks * shards
    # At most LAST_BLOCKS * shards parts and LARGE groups: a bound that does not grow with the input.
    top = small.select("item", "size", F.lit(False).alias("own")).union(large.select("item", "size", F.lit(True)))
    top = sorted(map(tuple, top.collect()), key=lambda x: (-x[1], x[0]))
    parts = differenced([x[1] for x in top], shards)
    rows = [(x[0], x[2], p) for x, p in zip(top, parts, strict=True)]
    last = items.sparkSession.createDataFrame(rows, "item string, own boolean, shard int")
    up = last.filter("not own").select("item", "shard")
    for done in reversed(levels):
        names = up.select(F.col("item").alias("name"), "shard")
        up = done.withColumn("name", F.concat_ws(":", "block", "part")).join(names, "name").select("item", "shard")
    return up.union(last.filter("own").select("item", "shard"))


def numbered(rows: DataFrame, by: str, order: list[str], per_task: int = SLOT_ROWS) -> DataFrame:
    """``slot``: 0, 1, ... within each value of ``by``, without sorting a value's rows in one task.

    Rows are dealt by hash into buckets within ``by``; a bucket starts where the
    ones before it end.
    """
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0] or 1
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(-(-most // per_task))))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(by, "_bucket").count().select(by, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_bucket").orderBy(*order)
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(starts, [by, "_bucket"])
    return placed.withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("bigint")).drop("_bucket", "_at", "_start")


def shard_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Every row's shard, with near-equal bytes per shard and equal texts in one shard.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes of the text plus 16; null: 16),
    ``text_crc32`` (of UTF-8; null: of nothing), ``shard`` and ``slot`` (0, 1,
    ... within a shard).  Null and empty texts are one group.  Repeated rows are
    of one group and keep a row each; null ids are allowed.  Other columns are
    not read.  An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.concat_ws(".", F.hex(F.xxhash64(body)), F.hex(F.xxhash64(F.lit(1), body)), F.octet_length(body)).alias("group"),
    )
    thin = checkpointed(thin)
    groups = checkpointed(thin.groupBy(F.col("group").alias("item")).agg(F.sum("size").alias("size")))
    place = assigned(groups, shards)
    placed = checkpointed(thin.join(place, thin["group"] == place["item"]).select("doc_id", "size", "text_crc32", "group", F.col("shard").cast("int").alias("shard")))
    # Rows equal in all of these are alike, so their order doesn't matter; the row's own number spreads them over buckets.
    spread = placed.withColumn("_row", F.monotonically_increasing_id())
    return numbered(spread, "shard", ["doc_id", "group", "_row"]).select("doc_id", "size", "text_crc32", "shard", "slot")
