"""Counts, latencies and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed


def outcome_counts(routed: DataFrame) -> DataFrame:
    """Messages by table, outcome and drift type (rows of ``routing.with_reports``)."""
    table = F.when(F.coalesce("source_table", F.lit("")) == "", "unknown").otherwise(
        F.concat(F.col("source_name"), F.lit(":"), F.col("source_database"), F.lit("."), F.col("source_table")))
    return routed.groupBy(table.alias("source"), "outcome", "drift_type").agg(F.count("*").alias("messages"))


def observed(routed: DataFrame, name: str = "routing") -> DataFrame:
    """The same rows with live counters that a query listener can read."""
    starts = lambda p: F.count_if(F.col("outcome").startswith(p))
    return routed.observe(
        name, F.count("*").alias("received"), starts("validated").alias("valid"),
        starts("dlq").alias("dlq"), starts("skipped").alias("skipped"))


def repair_counts(decided: DataFrame) -> DataFrame:
    """Decisions by table, drift type, status and repair source."""
    return decided.groupBy(
        F.concat_ws(".", "source_database", "source_table").alias("source_table"),
        F.coalesce("drift_report.drift_type", F.lit("NONE")).alias("drift_type"), "status",
        F.coalesce("chosen.proposal.origin", F.lit("")).alias("repair_source"),
    ).agg(F.count("*").alias("events"))


def latency_histogram(df: DataFrame, seconds: str, buckets: list[float] | None = None) -> DataFrame:
    """Cumulative counts per upper bound, as one pass over the data."""
    bounds = buckets or fixed.LATENCY_BUCKETS
    counted = df.agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.count(seconds).alias("le_all"))
    rows = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("observations")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("le_all").alias("observations")))
    return counted.withColumn("rows", rows).select(F.explode("rows").alias("r")).select("r.*")


def delivery_stats(attempted: DataFrame) -> DataFrame:
    """Per destination: delivered, duplicates, skipped, failed batches and last delivery.

    ``attempted``: ``destination, result, delivered_at`` with one row per change or failed batch,
    or with one row per batch and result and their number in ``changes``.
    """
    weight = F.col("changes") if "changes" in attempted.columns else F.lit(1)
    n = lambda r: F.coalesce(F.sum(F.when(F.col("result") == r, weight)), F.lit(0)).cast("bigint")
    return attempted.groupBy("destination").agg(
        n("delivered").alias("delivered"), n("duplicate").alias("duplicates"), n("skipped").alias("skipped"),
        n("failed_batch").alias("failed_batches"),
        F.max(F.when(F.col("result") == "delivered", F.col("delivered_at"))).alias("last_delivery"))


def topic_counts(log: DataFrame) -> DataFrame:
    """Messages per topic and partition by offset range."""
    return log.groupBy("topic", "partition").agg(
        F.min("offset").alias("low"), F.max("offset").alias("high"),
        (F.max("offset") - F.min("offset") + 1).alias("messages"))


def peek(log: DataFrame, n: int, per_partition: bool = False) -> DataFrame:
    """The last ``n`` messages of every topic by time, or of every partition by offset.

    Every task sends at most ``n`` rows of each into the shuffle.
    """
    order = ["offset"] if per_partition else [c for c in ("timestamp", "partition", "offset") if c in log.columns]
    newest = Window.partitionBy("topic", *(["partition"] if per_partition else [])).orderBy(*map(F.desc_nulls_last, order))
    return log.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def find(df: DataFrame, field: str, value: str) -> DataFrame:
    return df.filter(F.col(field).cast("string") == value)


def trace(dlq: DataFrame, repaired: DataFrame, audit: DataFrame, delivered: DataFrame,
          event_id: str | None = None) -> DataFrame:
    """Where an event went: dead letter, repair, audit and destinations, with coordinates.

    ``delivered``: ``_event_id, destination``.
    """
    start = dlq if event_id is None else dlq.filter(F.col("event_id") == event_id)
    fixed_rows = repaired.select("event_id", "repair_id", F.lit(True).alias("is_repaired"))
    judged = audit.select("event_id", "repair_result", "risk_level")
    # the destinations of one event: bounded by the destination registry
    landed = delivered.select(F.col("_event_id").alias("event_id"), "destination").distinct().groupBy(
        "event_id").agg(F.array_sort(F.collect_list("destination")).alias("destinations"))
    return start.select(
        "event_id", "reason", F.concat_ws("/", "topic", F.col("partition").cast("string"),
                                          F.col("offset").cast("string")).alias("dlq_coordinates"),
        F.col("drift_report.drift_type").alias("drift_type"),
    ).join(judged, "event_id", "left").join(fixed_rows, "event_id", "left").join(
        landed, "event_id", "left").withColumn("is_repaired", F.coalesce("is_repaired", F.lit(False)))


def decision_stats(decisions: DataFrame) -> DataFrame:
    """Events by status."""
    return decisions.groupBy("status").agg(F.count("*").alias("events"))
