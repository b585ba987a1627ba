"""Event records from files.

Readers return the payload's columns, ``event_id`` and ``event_time``.  Ids that
aren't given come from the file and the row's place in its split, so they are
the same whenever the same files are read by the same splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Read:
    """Good records, and rows that could not be decoded as ``raw, source, error``."""

    records: DataFrame
    rejected: DataFrame


def _identified(rows: DataFrame, prefix: str, event_id: Column | None, event_time: Column | None) -> DataFrame:
    """Ids and times: given ones where they aren't null or empty, else by place and now."""
    place = F.concat_ws(":", F.lit(prefix), F.col("_file"), F.monotonically_increasing_id())
    own = place if event_id is None else F.coalesce(F.when(event_id.cast("string") != "", event_id.cast("string")), place)
    time = F.current_timestamp() if event_time is None else F.coalesce(event_time.cast("timestamp"), F.current_timestamp())
    return rows.withColumn("event_id", own).withColumn("event_time", time)


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: T.StructType, *, event_id: Column | None = None, event_time: Column | None = None,
    required: list[str] | None = None, name_glob: str | None = None, prefix: str = "jsonl",
) -> Read:
    """Lines of JSON, gzip by suffix; blank lines don't count.

    A line that isn't JSON of the schema, or lacks a required field, is
    rejected.  Corrupt lines are told apart without a second read of the files.
    """
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    rows = reader.json(path).withColumn("_file", F.col("_metadata.file_path"))
    bad = F.col(CORRUPT).isNotNull()
    for f in required or []:
        bad = bad | F.col(f).isNull()
    whole = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*schema.fieldNames())))
    rejected = rows.filter(bad).select(whole.alias("raw"), F.col("_file").alias("source"), F.when(F.col(CORRUPT).isNotNull(), "decode").otherwise("required").alias("error"))
    return Read(_identified(rows.filter(~bad), prefix, event_id, event_time).drop(CORRUPT, "_file"), rejected)


def read_parquet(
    spark: SparkSession, path: str | list[str], *, schema: T.StructType | None = None, event_id: Column | None = None, event_time: Column | None = None,
    partitions: Column | None = None, columns: list[str] | None = None, prefix: str = "parquet",
) -> DataFrame:
    """Parquet files, with Hive-style ``key=value`` folders as columns.

    ``partitions`` is a condition on those columns: files outside it aren't read.
    ``columns`` narrows the scan.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(*([path] if isinstance(path, str) else path))
    if partitions is not None:
        rows = rows.filter(partitions)
    rows = rows.select(*(columns or rows.columns), F.col("_metadata.file_path").alias("_file"))
    return _identified(rows, prefix, event_id, event_time).drop("_file")


def stream_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream of JSON lines from files as they arrive; ids by file and offset are left to ``event_id`` columns."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files from a folder as they arrive, or of the one file that the path names."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def keyed_totals(spark: SparkSession, sql: str) -> DataFrame:
    """State rows ``entity, bucket, v`` of a SQL query with ``pk``, ``v`` and maybe ``sk``.

    Columns of another type, and nulls, are errors.
    """
    rows = spark.sql(sql)
    types = dict(rows.dtypes)
    whole = {"tinyint", "smallint", "int", "bigint"}
    if types.get("pk") != "string" or types.get("v") not in whole or types.get("sk", "bigint") not in whole:
        raise ValueError(f"a query for totals returns pk string, v bigint and maybe sk bigint, not {types}")
    rows = rows.select(F.col("pk").alias("entity"), (F.col("sk") if "sk" in types else F.lit(0)).cast("bigint").alias("bucket"), F.col("v").cast("bigint").alias("v"))
    null = F.col("entity").isNull() | F.col("bucket").isNull() | F.col("v").isNull()
    checked = F.when(null, F.raise_error(F.lit("a total has a null column"))).otherwise(F.col("entity"))
    return rows.withColumn("entity", checked)
