"""A versioned state table in Parquet.

A merge writes its own state rows as a segment, under a name of its own, and then
a commit file that names the segments a version consists of; reads merge them.
So many segments of one level are compacted into one of the next, so that a row is
rewritten once a level.  A commit file is created only if it isn't there yet, which
the store must do atomically (HDFS and local disks do); of several writers one wins,
and the others commit on top of it.  Readers take the newest committed version, so a
failed write is never seen, and a micro-batch whose id is already committed is not
applied again.  Ids of accepted events and debounce times are part of the version
that accepted them.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.monoids import Monoid
from ..functions.windows import Window


class VersionConflict(RuntimeError):
    """Another writer committed the same version."""


class VersionRegressed(ValueError):
    """An alias may only move to a greater version."""


class Folder:
    """Small files and listings in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if it was there."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # of the store's own kind
            if self._fs.exists(self._at(name)):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))


def _numbered(n: int) -> str:
    return f"{n:012d}"


#: Times that a merge is committed on top of other writers' versions before it gives up.
COMMIT_ATTEMPTS = 8


@dataclass
class StateTable:
    """The state of one pipeline at ``path``."""

    spark: SparkSession
    path: str
    monoid: Monoid
    window: Window | None = None
    on_commit: list[Callable[[DataFrame, int], None]] = field(default_factory=list)
    hook_errors: bool = False
    #: Segments of one level beyond which they are compacted into one of the next.
    most_segments: int = 8
    #: How long accepted ids are kept for dedup (None: forever).
    ids_kept: dt.timedelta | None = None
    log: Callable[[str], None] = print

    def __post_init__(self):
        self.folder = Folder(self.spark, self.path)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        names = self.folder.names("_commits")
        return int(names[-1]) if names else 0

    def commit_info(self, version: int) -> dict:
        return json.loads(self.folder.read(f"_commits/{_numbered(version)}")) if version else {"batches": {}, "segments": [], "ids": [], "debounce": None}

    def _part(self, part: str, name: str) -> str:
        return f"{self.path}/{part}/{name}"

    def _write(self, part: str, version: int, rows: DataFrame) -> str:
        """The name, no other writer's, under which rows were written."""
        name = f"{_numbered(version)}-{uuid.uuid4().hex}"
        rows.write.parquet(self._part(part, name))
        return name

    def _write_state(self, version: int, rows: DataFrame) -> str:
        # In order within files, so that reads of an entity skip most of a file by its statistics.
        return self._write("state", version, rows.sortWithinPartitions("entity", "bucket"))

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per entity and bucket; a later write keeps its bucket for another retention."""
        by = ["entity", "bucket"]
        kept = rows.groupBy(*by).agg(F.max("expires_at").alias("expires_at"))
        return self.monoid.merge(rows.select(*by, "v"), by).join(kept, by).select(*by, "v", "expires_at")

    def _segments(self, segments: list[list]) -> DataFrame:
        """State rows of ``[name, level]`` pairs."""
        return self.spark.read.parquet(*[self._part("state", name) for name, _ in segments])

    def read(self, version: int | None = None) -> DataFrame | None:
        """``entity, bucket, v, expires_at`` of a version; None before the first."""
        segments = self.commit_info(self.version() if version is None else version)["segments"]
        if not segments:
            return None
        rows = self._segments(segments)
        return self._merged(rows) if len(segments) > 1 else rows

    def seen(self, version: int | None = None, now: dt.datetime | None = None) -> DataFrame:
        """Ids of accepted events up to a version, as long as they are kept."""
        now = now or dt.datetime.now(dt.timezone.utc)
        parts = self.commit_info(self.version() if version is None else version)["ids"]
        paths = [self._part("ids", n) for n, at in parts if self._kept(at, now)]
        schema = T.StructType([T.StructField("event_id", T.StringType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last_accepted(self, version: int | None = None) -> DataFrame | None:
        """``kind, key, t`` of debounce, if the table has any."""
        at = self.commit_info(self.version() if version is None else version)["debounce"]
        return self.spark.read.parquet(self._part("debounce", at)) if at else None

    def applied(self, stream: str, batch: int) -> bool:
        return self.commit_info(self.version())["batches"].get(stream, -1) >= batch

    def merge(
        self, delta: DataFrame, *, stream: str = "batch", batch: int | None = None, ids: DataFrame | None = None, last: DataFrame | None = None, now: dt.datetime | None = None,
        base: int | None = None,
    ) -> int:
        """Merge state rows ``entity, bucket, v``; the version committed, or the one there if the batch was applied before.

        ``base`` is the version that the rows depend on, as through ids seen so far: if another writer has committed
        since, that is a conflict.  Without it the rows are committed on top of whatever is there.
        """
        now = now or dt.datetime.now(dt.timezone.utc)
        current = self.version()
        if batch is not None and self.applied(stream, batch):
            return current
        if base is not None and current != base:
            raise VersionConflict(f"{self.path}: version {current} was committed after {base}")
        until = F.lit(now + self.window.retention) if self.window and self.window.retention else F.lit(None)
        own = [self._write_state(current + 1, delta.select("entity", "bucket", "v").withColumn("expires_at", until.cast("timestamp"))), 0]
        seen = None if ids is None else self._write("ids", current + 1, ids.select(F.col("event_id").cast("string")).filter("event_id <> ''").distinct())
        times = None if last is None else self._write("debounce", current + 1, last)
        for attempt in range(1, COMMIT_ATTEMPTS + 1):
            info = self.commit_info(current)
            if batch is not None and info["batches"].get(stream, -1) >= batch:
                return current
            info["segments"] = self._compacted(current + 1, [*info["segments"], own])
            if seen is not None:
                info["ids"] = [x for x in info["ids"] if self._kept(x[1], now)] + [[seen, now.isoformat()]]
            if times is not None:
                info["debounce"] = times
            if batch is not None:
                info["batches"][stream] = batch
            try:
                self._commit(current + 1, info, now)
                break
            except VersionConflict:
                if base is not None or attempt == COMMIT_ATTEMPTS:
                    raise
                current = self.version()
        for hook in self.on_commit:
            try:
                hook(self._segments([own]).select("entity", "bucket", "v"), current + 1)
            except Exception as e:
                if self.hook_errors:
                    raise
                self.log(f"hook after version {current + 1} failed: {e}")
        return current + 1

    def _compacted(self, version: int, segments: list[list]) -> list[list]:
        """The segments, those of a level that are too many merged into one of the next."""
        level = 0
        while any(n >= level for _, n in segments):
            mine = [x for x in segments if x[1] == level]
            if len(mine) > self.most_segments:
                merged = self._write_state(version, self._merged(self._segments(mine)))
                segments = [x for x in segments if x[1] != level] + [[merged, level + 1]]
            level += 1
        return segments

    def _kept(self, at: str, now: dt.datetime) -> bool:
        return self.ids_kept is None or now - dt.datetime.fromisoformat(at) <= self.ids_kept

    def _commit(self, version: int, info: dict, now: dt.datetime) -> None:
        if not self.folder.create(f"_commits/{_numbered(version)}", json.dumps({**info, "at": now.isoformat()})):
            raise VersionConflict(f"{self.path}: version {version} was committed by another writer")

    def expire(self, now: dt.datetime) -> int:
        """Drop buckets whose retention is over, as a new, compacted version."""
        current = self.version()
        rows = self.read(current)
        if rows is None:
            return 0
        version, info = current + 1, self.commit_info(current)
        left = self._write_state(version, rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now))))
        self._commit(version, {**info, "segments": [[left, max(n for _, n in info["segments"])]]}, now)
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Remove commits before the newest ``keep`` versions, and files of that time that none of these use.

        A writer that takes longer than ``keep`` versions of others must not be running.
        """
        oldest = max(1, self.version() - keep + 1)
        infos = [self.commit_info(v) for v in range(oldest, self.version() + 1)]
        used = {"state": {name for i in infos for name, _ in i["segments"]}, "ids": {name for i in infos for name, _ in i["ids"]}, "debounce": {i["debounce"] for i in infos}}
        for part, names in used.items():
            for name in self.folder.names(part):
                if int(name.split("-")[0]) <= oldest and name not in names:
                    self.folder.delete(f"{part}/{name}")
        for name in self.folder.names("_commits"):
            if int(name) < oldest:
                self.folder.delete(f"_commits/{name}")


class Alias:
    """A name that points to the newest of several tables, so that a replay can be switched in."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.folder, self.root, self.name = Folder(spark, f"{root.rstrip('/')}/_alias/{name}"), root.rstrip("/"), name

    def active(self) -> int:
        """The version pointed to; 1 if none was set."""
        names = self.folder.names()
        return int(names[-1]) if names else 1

    def activate(self, version: int) -> None:
        names = self.folder.names()
        if version < 1 or (names and version <= int(names[-1])):
            raise VersionRegressed(f"{self.name} is at version {self.active()}; {version} isn't greater")
        if not self.folder.create(_numbered(version), ""):
            raise VersionRegressed(f"{self.name} was moved to version {version} by another writer")

    def path(self, version: int | None = None) -> str:
        return f"{self.root}/{self.name}_v{self.active() if version is None else version}"
