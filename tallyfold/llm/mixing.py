"""Mixing sources to target weights with histograms over hash thresholds.

Each document has a hash; a source's mix takes whole passes over the source and,
for the rest of its target, the documents whose hash is under a threshold.  The
threshold comes from a histogram of tokens by source and leading hash bits; only
the bucket in which the target falls is refined by its next bits.  Nothing is
sorted, and a larger budget takes a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, free_name, small_side

WEIGHTS = (5, 2, 1)
#: The words that a mix may take from a source, as a multiple of the source's words.
MOST_PASSES = 3
#: Hash bits per histogram, and histograms at most: together 60 bits.
BITS, LEVELS = 12, 5
_HASH_BITS = BITS * LEVELS


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in the whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")


def ranked(keys: DataFrame, column: str) -> DataFrame:
    """``rank``: 0, 1, ... by code point, null last, for a table of distinct keys, without a sort in one task."""
    rows = checkpointed(keys.orderBy(F.asc_nulls_last(column)).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one per partition
    starts, total = {}, 0
    for p, n in counts:
        starts[p], total = total, total + n
    start = F.lit(0)
    if starts:
        start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[part]
    return rows.withColumn("rank", start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in order of code point, null last, have the weights in turn and
    share all words by weight; a target stops at MOST_PASSES times its source's
    words and the excess is shared again among the others.
    """
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = checkpointed(sources.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(float(MOST_PASSES))
    level, held = 0.0, -1
    while True:  # the words per unit of weight only rise; each turn holds at least one more source at its cap
        over = cap <= F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.count(F.when(over, 1)).alias("held"), F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")
        ).first()
        if sums["held"] == held or not sums["open"]:
            break
        held, level = sums["held"], (sums["all"] - (sums["capped"] or 0.0)) / sums["open"]
    return sources.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def thresholds(hashed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, below``: the hash under which a source's documents come near its ``rest``.

    ``hashed`` has ``source, size, h`` with h from 0 to 2**60 - 1.
    """
    state = budgets.select("source", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = hashed.alias("d").join(small_side(state).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        inside = inside.filter(F.shiftright("d.h", shift + BITS) == F.col("s.prefix"))
        histogram = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.h", shift).alias("bucket")).agg(
            F.sum("d.size").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.first("s.rest").alias("rest")
        )
        run = Window.partitionBy("source").orderBy("bucket")  # at most 2 ** BITS rows per source
        run = histogram.withColumn("upto", F.sum("tokens").over(run))
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), "tokens", "rows")))
        edge = run.groupBy("source").agg(first.alias("x"), F.max("rest").alias("rest"), F.max("bucket").alias("last"))
        # No bucket goes over: all that is inside is taken. Otherwise refine the one in which the budget ends.
        edge = edge.select(
            "source", "rest",
            F.coalesce(F.col("x.bucket"), F.col("last") + 1).alias("prefix"),
            (F.col("rest") - F.coalesce(F.col("x.before"), F.col("rest"))).alias("left"),
            F.coalesce(F.col("x.tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.col("x.rows"), F.lit(0)).alias("rows"),
        )
        # At the end, or with one document in the bucket, take the bucket if that comes nearer.
        last = (F.col("rows") <= 1) | F.lit(level == LEVELS - 1)
        whole = F.col("tokens") - F.col("left") < F.col("left")
        prefix = F.col("prefix") + F.when(last & whole, 1).otherwise(0)
        state = checkpointed(edge.select("source", F.col("left").alias("rest"), prefix.alias("prefix"), (prefix * F.lit(1 << shift)).cast("bigint").alias("below"), last.alias("done")))
        settled = state.filter("done").select("source", "below")
        ended = settled if level == 0 else ended.union(settled)
        state = state.filter("not done")
        if not state.take(1):
            break
    return ended


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, into: str = "mix",
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column about how often the mix takes each row, and that column's name.

    The struct holds ``size`` (words), ``source_size``, ``target`` (of its
    source) and ``copies`` (0 to MOST_PASSES).  A null text has size 0; a
    document of size 0 is copied like others of its hash.  The null source is
    one source, the last in order.  Rows equal in id, source and text share a
    hash and are taken or left together.  Other columns pass through; the
    column takes another name if ``docs`` has one like it.  An empty table gives
    an empty result.

    Texts are read twice, once to count and once for the result, and never
    shuffled: what is joined to them has a row per source.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ident = [F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(source), F.lit("")), body]
    h = F.shiftrightunsigned(F.xxhash64(*ident), 64 - _HASH_BITS)
    rows = checkpointed(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h")))
    targets = checkpointed(source_targets(rows, weights))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    budgets = targets.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    below = thresholds(rows, budgets)
    plan = budgets.alias("t").join(below.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left")
    plan = checkpointed(plan.select(F.struct("t.source", "source_size", "target", "full", F.coalesce("below", F.lit(0)).alias("below")).alias("plan_")))
    name = free_name(docs, into)
    own = free_name(docs, name + "_plan")
    plan = small_side(plan.withColumnRenamed("plan_", own))
    copies = F.least(F.col(f"{own}.full") + (h < F.col(f"{own}.below")).cast("bigint"), F.lit(MOST_PASSES)).cast("int")
    out = docs.join(plan, F.col(source).eqNullSafe(F.col(f"{own}.source")))
    taken = F.struct(word_count(F.col(text)).alias("size"), F.col(f"{own}.source_size"), F.col(f"{own}.target"), copies.alias("copies"))
    return out.withColumn(name, taken).drop(own), name


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as :func:`mix` takes it."""
    out, name = mix(docs, **options)
    again = free_name(out, "again")
    return out.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(f"{name}.copies")))).select(*docs.columns)
