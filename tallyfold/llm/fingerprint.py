"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A sketch has cells of a count, a key and a checksum.  Each distinct paragraph's
digest goes into one cell of each of three tables.  The difference of two
sketches holds only what the texts don't share; cells with a single digest in
them give it up, which frees more cells, until all differing digests are known.
Where this gets stuck the sketches were too small, and the comparison is made
again with larger ones: digests are dealt into groups with a sketch each, and a
group that gets stuck is tried again with more cells and other hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let

TABLES = 3
#: log2 of the cells per table: of the fingerprint itself, then of the tries for a group.
WIDTHS = (3, 6, 8)
#: Digests of both texts in a group, about.
GROUP = 4
#: Turns of taking out single digests before a sketch counts as stuck.
TURNS = 10
#: Documents, about, that are ordered together when each looks for the next.
BUCKET_ROWS = 128
#: Keys that one task may order.
ORDERED = 1 << 16

_FOUND = "array<struct<key:bigint,n:int>>"


def paragraphs(text: Column) -> Column:
    """Digests of the distinct lines that aren't empty; a null or empty text has none."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\\n"), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, cell: Column, width: int, tries: int) -> Column:
    """Whether a digest belongs in a cell, cells being numbered table after table."""
    mixed = F.xxhash64(F.lit(tries), key) if tries else key
    shift = F.shiftright(cell, width) * 8
    return F.call_function("shiftrightunsigned", mixed, shift).bitwiseAND(F.lit((1 << width) - 1)) == cell.bitwiseAND(F.lit((1 << width) - 1))


def sketch(digests: Column, width: int = WIDTHS[0], tries: int = 0) -> Column:
    """The cells of an array of distinct digests."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))

    def cell(own: Column, c: Column) -> Column:
        return F.aggregate(
            F.filter(own, lambda x: _place(x, c, width, tries)), zero,
            lambda a, x: F.struct((a["n"] + 1).alias("n"), a["key"].bitwiseXOR(x).alias("key"), a["check"].bitwiseXOR(_check(x)).alias("check")),
        )

    return let(digests, lambda own: F.transform(F.sequence(F.lit(0), F.lit((TABLES << width) - 1)), lambda c: cell(own, c)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peeled(difference: Column, width: int = WIDTHS[0], tries: int = 0) -> Column:
    """``array<struct<key, n>>``: the differing digests, n 1 for those of the first text and -1 for the second; null if stuck."""

    def turn(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]))
        single = F.array_distinct(F.transform(single, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))

        def taken(single: Column) -> Column:
            cells = F.transform(state["cells"], lambda c, k: F.aggregate(
                F.filter(single, lambda s: _place(s["key"], k, width, tries)), c,
                lambda a, s: F.struct((a["n"] - s["n"]).alias("n"), a["key"].bitwiseXOR(s["key"]).alias("key"), a["check"].bitwiseXOR(_check(s["key"])).alias("check")),
            ))
            return F.struct(F.when(F.size(single) == 0, state["cells"]).otherwise(cells).alias("cells"), F.concat(state["found"], single).alias("found"))

        return let(single, taken)

    start = F.struct(difference.alias("cells"), F.array().cast(_FOUND).alias("found"))
    left = F.lit(0)
    done = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, turn)
    empty = lambda s: ~F.exists(s["cells"], lambda c: (c["n"] != left) | (c["key"] != 0) | (c["check"] != 0))
    return let(done, lambda s: F.when(empty(s), s["found"]))


def _larger(a: Column, b: Column) -> Column:
    """The differing digests by groups; those of a group stuck at every size are told by setting its digests against each other."""

    def group(own: Column, other: Column) -> Column:
        tries = [peeled(subtracted(sketch(own, w, k), sketch(other, w, k)), w, k) for k, w in enumerate(WIDTHS)]
        signed = lambda x, n: F.transform(x, lambda key: F.struct(key.alias("key"), F.lit(n).alias("n")))
        return F.coalesce(*tries, F.concat(signed(F.array_except(own, other), 1), signed(F.array_except(other, own), -1)))

    def bits(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.log2((F.size(a) + F.size(b)) / F.lit(float(GROUP)))).cast("int"))

    def deal(a: Column, b: Column, low: int, high: Column, use) -> Column:
        """``use`` on each group by the bits from ``low`` on, as many as ``high`` says."""
        mask = F.call_function("shiftleft", F.lit(1), high) - 1
        of = lambda x, g: F.filter(x, lambda key: F.shiftrightunsigned(key, low).bitwiseAND(mask) == g)
        return F.flatten(F.transform(F.sequence(F.lit(0), mask), lambda g: let(F.struct(of(a, g).alias("a"), of(b, g).alias("b")), lambda s: use(s["a"], s["b"]))))

    def all_(s: Column) -> Column:
        half = F.shiftright(bits(s["a"], s["b"]) + 1, 1)
        rest = bits(s["a"], s["b"]) - half
        # In two steps, so that a digest is looked at by the square root of the groups.
        return let(F.struct(half.alias("half"), rest.alias("rest")), lambda n: deal(s["a"], s["b"], 24, n["half"], lambda x, y: deal(x, y, 44, n["rest"], group)))

    return let(F.struct(a.alias("a"), b.alias("b")), all_)


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests that two texts don't share, from their sketches, or from larger ones if those are too small."""
    return F.coalesce(peeled(subtracted(sketch_a, sketch_b)), _larger(a, b))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Shared digests by all digests of two texts, 1 for two without any."""
    both, apart = F.size(a) + F.size(b), F.size(differing(a, b, sketch_a, sketch_b))
    return let(F.struct(both.alias("both"), apart.alias("apart")), lambda s: F.when(s["both"] == 0, 1.0).otherwise((s["both"] - s["apart"]) / (s["both"] + s["apart"])))


def as_text(cells: Column) -> Column:
    """A sketch as base64: per cell two bytes of count, eight of key and four of checksum."""
    part = lambda x, n: F.lpad(F.hex(x), n, "0")
    cell = lambda c: F.concat(part(c["n"].bitwiseAND(F.lit(0xFFFF)), 4), part(c["key"], 16), part(c["check"], 8))
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(cells, cell), ""))), "\r\n", "")


def successors(keys: DataFrame) -> DataFrame:
    """``key, after``: of distinct longs the next larger one, and the least one after the largest.

    Ordered in groups by leading bits, and the groups in turn, so that no task
    orders more than a bounded number of keys.
    """

    def of(keys: DataFrame, shift: int) -> DataFrame:
        if keys.count() <= ORDERED:
            return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("after"))
        up = keys.withColumn("up", F.shiftright("key", shift))
        inside = up.select("key", "up", F.lead("key").over(Window.partitionBy("up").orderBy("key")).alias("after"))
        first = up.groupBy("up").agg(F.min("key").alias("first"))
        higher = of(checkpointed(first.select(F.col("up").alias("key"))), shift).select(F.col("key").alias("u"), F.col("after").alias("v"))
        first = first.select(F.col("up").alias("w"), "first")
        jump = higher.join(first, higher["v"] == first["w"]).select("u", "first")
        return inside.join(jump, inside["up"] == jump["u"], "left").select("key", F.coalesce("after", "first").alias("after"))

    keys = checkpointed(keys.select("key"))
    low = keys.agg(F.min("key")).first()[0]
    return of(keys, 12).select("key", F.coalesce("after", F.lit(low)).alias("after"))


def _bucket_shift(ids: DataFrame) -> int:
    """Trailing bits of an id to leave out so that ids fall into buckets of about BUCKET_ROWS."""
    known = ids.agg(F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if not known["n"]:
        return 0
    shift = max(0, int(math.log2(max(1.0, (known["high"] - known["low"] + 1) / known["n"] * BUCKET_ROWS))))
    while shift > 7:  # ids that lie in clusters
        most = ids.groupBy(F.shiftright("id", shift)).agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
        if most <= 8 * BUCKET_ROWS:
            break
        shift -= 3
    return shift


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likenesses.

    The edited text is the text with its last floor(n / 2) code points replaced
    by the first as many, or all, of the next document's.  Next is the next
    larger id, after the largest the least; null ids come before all others, and
    rows of one id are ordered by hashes of their texts.  A null text counts as
    empty.  Result: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  ``doc_id`` must be an integer;
    other columns are not read.  A table of one row is its own next; an empty one
    gives an empty result.

    Texts are shuffled once, by ranges of ids.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.col(doc_id).cast("bigint").alias("id"))
    shift = _bucket_shift(ids)
    # Nulls have a bucket of their own before all others. A bucket is never null, or a test for that would be put below
    # one of the two reads of the shuffled rows, and they would be shuffled twice.
    bucket = F.coalesce(F.shiftright(F.col(doc_id).cast("bigint"), shift), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), bucket.alias("bucket")).repartition("bucket")
    rows = rows.withColumn("own", paragraphs(F.col("text")))
    rows = rows.withColumn("cells", sketch(F.col("own")))
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    carried = F.struct("text", "own", "cells")
    placed = rows.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead(carried).over(order))
    after = successors(ids.select(F.coalesce(F.shiftright("id", shift), F.lit(-(1 << 63))).alias("key")).distinct())
    first = placed.filter("at = 1").select(F.col("bucket").alias("from"), carried.alias("first"))
    jump = first.join(after, first["from"] == after["after"]).select(F.col("key").alias("to"), "first")
    out = placed.join(jump, placed["bucket"] == jump["to"], "left").select("doc_id", "text", "own", "cells", F.coalesce("next", "first").alias("next"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    out = out.withColumn("edited", F.concat(F.left(F.col("text"), n - half), F.left(F.col("next.text"), half)))
    out = out.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "cells", F.col("next.own").alias("next_own"), F.col("next.cells").alias("next_cells"), paragraphs(F.col("edited")).alias("edited_own"))
    out = out.withColumn("edited_cells", sketch(F.col("edited_own")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("cells")).alias("fingerprint"), as_text(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own"), F.col("cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), F.col("cells"), F.col("next_cells")).alias("near_next"),
    )
