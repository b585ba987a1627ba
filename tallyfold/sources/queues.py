"""Event records from message queues: options for Spark's connectors, and decoding.

The connectors' jars are the cluster's; decoding works on any frame with their
columns.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Read


@dataclass(frozen=True)
class Kafka:
    """Topics to subscribe to."""

    servers: str
    topics: tuple[str, ...]
    options: dict[str, str] = field(default_factory=dict)

    def settings(self, starting: str = "latest", per_batch: int | None = None) -> dict[str, str]:
        if not self.servers or not self.topics:
            raise ValueError("Kafka needs servers and topics")
        limit = {"maxOffsetsPerTrigger": str(per_batch)} if per_batch else {}
        return {"kafka.bootstrap.servers": self.servers, "subscribe": ",".join(self.topics), "startingOffsets": starting, **limit, **self.options}

    def stream(self, spark: SparkSession, starting: str = "latest", per_batch: int | None = None) -> DataFrame:
        return spark.readStream.format("kafka").options(**self.settings(starting, per_batch)).load()

    def replay(self, spark: SparkSession, starting: str = "earliest", ending: str = "latest") -> DataFrame:
        """A bounded read of the topics."""
        return spark.read.format("kafka").options(**self.settings(starting), endingOffsets=ending).load()


def offsets_token(offsets: dict[str, dict[int, int]]) -> str:
    """Offsets by topic and partition as ``startingOffsets``: where the stream goes on after a snapshot."""
    return json.dumps({t: {str(p): o for p, o in by.items()} for t, by in offsets.items()}, sort_keys=True)


def decoded(messages: DataFrame, schema: T.StructType, event_id: Column | None = None) -> Read:
    """Records of frames with ``topic, partition, offset, timestamp, value``.

    The id is ``topic:partition:offset`` unless ``event_id``, over the payload,
    gives one; the time is the broker's.  Values that aren't JSON of the schema
    are rejected with their bytes, place and error, fit for a dead-letter topic.
    """
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    place = F.concat_ws(":", "topic", "partition", "offset")
    rows = messages.withColumn("_p", parsed).withColumn("_place", place)
    bad = F.col("value").isNull() | F.col("_p._corrupt").isNotNull() | F.col("_p").isNull()
    good = rows.filter(~bad).select("_place", F.col("timestamp").alias("event_time"), *[F.col(f"_p.{f}").alias(f) for f in schema.fieldNames()])
    own = F.col("_place") if event_id is None else F.coalesce(F.when(event_id.cast("string") != "", event_id.cast("string")), F.col("_place"))
    rejected = rows.filter(bad).select(F.col("value").alias("raw"), F.col("_place").alias("source"), F.lit("decode").alias("error"))
    return Read(good.withColumn("event_id", own).drop("_place"), rejected)


def dead_letters(rejected: DataFrame) -> DataFrame:
    """Rejected rows as messages ``value, headers`` for a dead-letter topic: the bytes as they came, and where and why they failed."""
    header = lambda name, value: F.struct(F.lit(f"x-{name}").alias("key"), value.cast("string").cast("binary").alias("value"))
    parts = F.split("source", ":")
    headers = [header("source-topic", parts[0]), header("source-partition", F.get(parts, F.lit(1))), header("source-offset", F.get(parts, F.lit(2))), header("error-kind", F.col("error"))]
    return rejected.select(F.col("raw").cast("binary").alias("value"), F.array(*headers).alias("headers"))


def sequenced(rows: DataFrame, arn: str, sequence: str = "sequence_number", arrival: str = "arrival") -> DataFrame:
    """Records of a shard-and-sequence queue: ``event_id`` ``arn/sequence``, the arrival as time."""
    return rows.withColumn("event_id", F.concat(F.lit(arn), F.lit("/"), F.col(sequence).cast("string"))).withColumn("event_time", F.col(arrival).cast("timestamp"))


def queued(rows: DataFrame, arn: str, message: str = "message_id", sent_ms: str = "sent_ms") -> DataFrame:
    """Records of a message queue: ``event_id`` ``arn/message``; sent milliseconds as time, or now."""
    time = F.coalesce(F.timestamp_millis(F.col(sent_ms).cast("bigint")), F.current_timestamp())
    return rows.withColumn("event_id", F.concat(F.lit(arn), F.lit("/"), F.col(message))).withColumn("event_time", time)


def change_rows(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Change-data rows; those that ``keep`` declines are skipped."""
    return rows if keep is None else rows.filter(keep)


def scanned(spark: SparkSession, url: str, table: str, segments: int, column: str, low: int, high: int, **options: str) -> DataFrame:
    """A table over JDBC, read in segments of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=segments, **options).load()


def document_id(raw: Column) -> Column:
    """A document's ``_id`` as text, from extended JSON: object ids, numbers, binary and plain strings."""
    forms = ["$.$oid", "$.$numberLong", "$.$numberInt", "$.$numberDecimal", "$.$binary.base64"]
    return F.coalesce(*[F.get_json_object(raw, f) for f in forms], F.when(~raw.startswith("{"), raw))


def snapshot_time(now: dt.datetime) -> str:
    """A hand-off token for sources that resume by time."""
    return json.dumps({"at": now.isoformat()})
