"""Which events a destination holds, as a table of ids by hash bucket.

The rows of a destination are the truth; the index only spares reading them. A batch's data is written
first, its ids second, and last a mark that names the batch. Batches of a run follow each other, so after a
stop at most the batch behind each run's mark holds data without ids; its ids are then read from the data
and added. A run without a mark (data from before the index) is read and added whole. So the index and
what is healed are together exact, whatever a stop left undone, and a replay writes its own place again.

A batch reads the folders of its own buckets only: files of other buckets are not even listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.plans.staging import drop_shared, on_file_system

BUCKETS = 64
#: Ids for which a lookup is pushed into the scan; Spark hands longer lists on as a range.
PUSHED = 10
_SCHEMA = "event_id string, bucket int, run string, batch bigint"


def children(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern, by name."""
    files, place = on_file_system(spark, pattern)
    return sorted(str(found.getPath()) for found in (files.globStatus(place) or []))


def _value(path: str, name: str) -> str | None:
    """``v`` of the part ``name=v`` of a path."""
    return next((p.split("=", 1)[1] for p in path.split("/") if p.startswith(f"{name}=")), None)


class DeliveredIndex:
    """Ids of delivered events below ``root``."""

    def __init__(self, root: str, buckets: int = BUCKETS):
        self.root, self.buckets = root, buckets

    def bucket(self, event_id: str | Column = "event_id") -> Column:
        return F.pmod(F.xxhash64(event_id), F.lit(self.buckets)).cast("int")

    def add(self, ids: DataFrame, run: str, batch_id: int) -> None:
        """Record the ids of a batch in place of what it recorded before, then mark the batch."""
        placed = ids.select("event_id", self.bucket().alias("bucket"), F.lit(run).alias("run"), F.lit(batch_id).alias("batch"))
        self._write(placed, "overwrite")
        self._mark(ids.sparkSession, run, batch_id)

    def _write(self, placed: DataFrame, mode: str, ids_per_file: int | None = None) -> None:
        writer = placed.repartition("bucket").sortWithinPartitions("bucket", "event_id").write.mode(mode)
        writer = writer.option("partitionOverwriteMode", "dynamic")
        if ids_per_file:
            writer = writer.option("parquet.bloom.filter.enabled#event_id", "true").option(
                "parquet.bloom.filter.expected.ndv#event_id", str(ids_per_file))
        writer.partitionBy("bucket", "run", "batch").parquet(f"{self.root}/ids")

    def _mark(self, spark: SparkSession, run: str, batch_id: int) -> None:
        files, place = on_file_system(spark, f"{self.root}/marks/run={run}/batch={batch_id}")
        files.create(place, True).close()
        for old in children(spark, f"{self.root}/marks/run={run}/batch=*"):
            if int(_value(old, "batch")) < batch_id:
                drop_shared(spark, old)

    def marks(self, spark: SparkSession) -> dict[str, int]:
        """The last recorded batch of each run."""
        out: dict[str, int] = {}
        for path in children(spark, f"{self.root}/marks/run=*/batch=*"):
            run = _value(path, "run")
            out[run] = max(out.get(run, -1), int(_value(path, "batch")))
        return out

    def heal(self, spark: SparkSession, data: str, ids_of: Callable[[list[tuple[str, int]]], DataFrame], run: str, batch_id: int) -> None:
        """Add batches whose data was written and whose ids were not; ``data`` is the pattern of the folders above ``run=``.

        ``ids_of`` reads the ids of some batches from the data. The batch that is running now is not looked at.
        """
        marks = self.marks(spark)
        for found in children(spark, f"{data}/run=*"):
            own = _value(found, "run")
            batches = children(spark, f"{found}/batch={marks[own] + 1}" if own in marks else f"{found}/batch=*")
            open_ = sorted({int(_value(b, "batch")) for b in batches} - ({batch_id} if own == run else set()))
            for batch in open_:
                self.add(ids_of([(own, batch)]), own, batch)

    def held(self, spark: SparkSession, buckets: list[int]) -> DataFrame | None:
        """``event_id``, ``bucket``, ``run`` and ``batch`` of all ids in some buckets."""
        paths = [p for b in sorted(set(buckets)) for p in children(spark, f"{self.root}/ids/bucket={b}")]
        if not paths:
            return None
        return spark.read.schema(_SCHEMA).option("basePath", f"{self.root}/ids").parquet(*paths)

    def drop_held(self, changes: DataFrame, run: str, batch_id: int) -> DataFrame:
        """The changes whose ids no other batch has recorded."""
        # at most as many rows as there are buckets
        touched = [r.bucket for r in changes.select(self.bucket().alias("bucket")).distinct().collect()]
        held = self.held(changes.sparkSession, touched)
        if held is None:
            return changes
        others = held.where(~((F.col("run") == run) & (F.col("batch") == batch_id))).select("event_id")
        return changes.join(others, "event_id", "left_anti")

    def find(self, spark: SparkSession, event_ids: list[str]) -> DataFrame | None:
        """Where events were delivered (``event_id``, ``run``, ``batch``); up to ``PUSHED`` ids are looked up in the files' Bloom filters."""
        named = spark.createDataFrame([(e,) for e in event_ids], "event_id string")
        held = self.held(spark, [r.bucket for r in named.select(self.bucket().alias("bucket")).distinct().collect()])
        if held is None:
            return None
        found = held.where(F.col("event_id").isin(event_ids)) if len(event_ids) <= PUSHED else held.join(named, "event_id", "left_semi")
        return found.select("event_id", "run", "batch")

    def compact(self, spark: SparkSession, generation: str) -> None:
        """Replace the files of all recorded batches by one for each bucket, with Bloom filters. For times when nothing is delivered.

        The new files are written before the old ones go, and both together mean the same.
        """
        old = [p for p in children(spark, f"{self.root}/ids/bucket=*/run=*") if _value(p, "run") != generation]
        if not old:
            return
        held = spark.read.schema(_SCHEMA).option("basePath", f"{self.root}/ids").parquet(f"{self.root}/ids")
        merged = held.select("event_id", "bucket").distinct()
        each = max(1_000, merged.count() // self.buckets)
        self._write(merged.select("event_id", "bucket", F.lit(generation).alias("run"), F.lit(0).alias("batch")), "overwrite", each)
        for path in old:
            drop_shared(spark, path)
