"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``.

    A scan of fewer tasks than cores, as of a single small file, is dealt out to
    all cores; a larger one stays as it is, without a shuffle.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where nothing is set (tests, one machine) a temporary folder is used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows, and bytes as JSON, of a table that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def small_side(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if it has been counted and measured to be within both bounds."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES else df


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is much faster than ``translate`` and agrees with it where every
    character is a single byte.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


SPACES = "\\x20\\x09-\\x0D"


def space_words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]``, in order; an empty array where there is none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACES}]+"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, inside lambdas too."""
    return F.transform(F.array(value), use)[0]


def exploded(df: DataFrame, array: Column, into: str, *columns) -> DataFrame:
    """``columns`` and a row per element of an array without nulls.

    An inner ``explode`` is preceded by a test that the array isn't empty, which
    computes the array again; an outer one isn't.
    """
    return df.select(*columns, F.explode_outer(array).alias(into)).filter(F.col(into).isNotNull())


#: Matches whose places are added up in one go; longer lists go by runs of so many.
RUN = 512


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as ``array<struct<start, stop, match>>`` in code points, end exclusive.

    ``pattern`` is a Java regular expression that never matches the empty
    string.  What lies between matches comes from ``split``, so places are sums
    of lengths; sums go by runs, which keeps very long lists of matches cheap.
    """
    between = F.transform(F.split(text, pattern), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda gap, m: F.struct(F.coalesce(gap, F.lit(0)).alias("gap"), m.alias("match"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
    # What follows the last match has no match beside it.
    pairs = let(pairs, lambda p: F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))

    def run(first: Column, part: Column) -> Column:
        none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
        return F.aggregate(
            part,
            F.struct(first.alias("at"), none.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("stop"), x["match"].alias("match")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    def runs(p: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.slice(p, k + 1, F.lit(RUN)))
        starts = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,part:array<struct<gap:int,match:string,size:int>>>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + F.aggregate(x, F.lit(0), lambda n, y: n + y["gap"] + y["size"])).alias("at"),
                F.concat(a["out"], F.array(F.struct(a["at"].alias("first"), x.alias("part")))).alias("out"),
            ),
            lambda a: a["out"],
        )
        return F.flatten(F.transform(starts, lambda s: run(s["first"], s["part"])))

    return let(pairs, runs)


def text_key(doc_id: Column, text: Column) -> Column:
    """Two hashes of id and text: rows equal in both share it."""
    ident = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.struct(F.xxhash64(*ident).alias("a"), F.xxhash64(F.lit(1), *ident).alias("b"))
