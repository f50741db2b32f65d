"""Routing: validated rows, dead letters, skipped tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions import jsonvalue as jv
from tidegate.functions.binding import seal
from tidegate.functions.names import RenameHints
from tidegate.functions.sqltypes import TypeMatrix
from tidegate.operators import drift
from tidegate.operators.envelope import parse_envelopes
from tidegate.sources.catalog import Catalog

_NOTICE = f"struct<control_event:string,compatible_type_changes:array<{drift.TYPE_CHANGE}>>"


def outcome(compatible_type_change_routing: str = "dlq") -> Column:
    """Where a row goes.  Every row gets exactly one outcome."""
    if compatible_type_change_routing not in ("dlq", "validated"):
        raise ValueError("compatible_type_change_routing is 'dlq' or 'validated'")
    widened = F.lit(compatible_type_change_routing == "validated") & drift.only_compatible_type_changes()
    return (
        F.when(F.col("is_tombstone"), "skipped:tombstone")
        .when(F.col("json_error").isNotNull(), "dlq:MALFORMED_JSON")
        .when(F.col("envelope_error").isNotNull(), "dlq:MALFORMED_ENVELOPE")
        .when(F.col("operation").isin(*fixed.CONTROL_OPS), "validated:control")
        .when(F.col("has_contract").isNull(), "dlq:UNKNOWN_SCHEMA")
        .when(F.col("drift_detected").isNull(), "dlq:PROCESSING_ERROR")
        .when(~F.col("drift_detected"), "validated")
        .when(widened, "validated:compatible_widening")
        .otherwise("dlq:SCHEMA_DRIFT")
    )


def route_changes(log: DataFrame, catalog: Catalog, compatible_type_change_routing: str = "dlq") -> DataFrame:
    """Decode, compare and route a change log: one row per message, with its ``outcome``.

    The plan reads the log once, has no shuffle of it and no Python.  Split the result with
    ``to_validated`` and ``to_dlq``; persist it when more than one output is written.
    """
    compared = drift.compare(drift.resolve_contract(parse_envelopes(log), catalog), catalog.matrix)
    # what only the comparison needed does not go on
    kept = compared.drop("field_names", "required", "allows_additional", "column_count")
    return seal(kept.withColumn("outcome", outcome(compatible_type_change_routing)), ["outcome"])


def with_reports(routed: DataFrame, matrix: TypeMatrix | None = None, hints: RenameHints | None = None,
                 meet: drift.Meet | None = None) -> DataFrame:
    """Routed rows with their drift report; ``drift_type`` is NONE where nothing was compared."""
    compared = F.col("outcome").isin("validated", "validated:compatible_widening", "dlq:SCHEMA_DRIFT")
    reported = drift.report_renames(routed, matrix, hints, meet)
    return reported.withColumn("drift_type", F.when(compared, F.col("drift_type")).otherwise("NONE"))


def to_validated(routed: DataFrame) -> DataFrame:
    """Clean rows, with a notice for control events and accepted widenings."""
    control = F.col("outcome") == "validated:control"
    widened = F.col("outcome") == "validated:compatible_widening"
    notice = F.when(control | widened, F.struct(
        F.when(control, F.col("operation")).alias("control_event"),
        F.when(widened, F.col("type_mismatches")).alias("compatible_type_changes")).cast(_NOTICE))
    return routed.filter(F.col("outcome").startswith("validated")).select(
        "event_id", "correlation_id", "source_name", "source_database", "source_table", "operation",
        F.when(control, "").otherwise(F.coalesce("contract_id", F.lit(""))).alias("contract_id"),
        F.col("key_json").alias("key"),
        jv.image_json(F.col("image")).alias("payload"),
        jv.image_json(F.col("before")).alias("before"),
        "source_metadata", "ts_ms", notice.alias("schema_notice"),
        "topic", "partition", "offset", F.current_timestamp().alias("validated_at"))


def to_dlq(routed: DataFrame, matrix: TypeMatrix | None = None, hints: RenameHints | None = None,
           meet: drift.Meet | None = None) -> DataFrame:
    """Dead letters with everything needed to decide on a repair.

    Without ``meet`` nothing runs before the result is asked for, and the log is decoded for the shapes and for the
    rows. With the one of a ``ShapeDictionary``, hand in routed rows that are stored or persisted.
    """
    dead = with_reports(routed.filter(F.col("outcome").startswith("dlq:")), matrix, hints, meet)
    reason = F.regexp_extract("outcome", "^dlq:(.*)$", 1)
    drifted = F.col("outcome") == "dlq:SCHEMA_DRIFT"
    malformed = F.col("outcome").startswith("dlq:MALFORMED")
    error = (
        F.when(malformed, F.coalesce("json_error", "envelope_error"))
        .when(reason == "UNKNOWN_SCHEMA", F.concat(
            F.lit("no canonical contract for "),
            F.when(F.col("source_name") == "", "?").otherwise(F.col("source_name")), F.lit(":"),
            F.col("source_database"), F.lit("."), F.col("source_table")))
        .when(reason == "PROCESSING_ERROR", "the row could not be compared with its contract")
    )
    whole = lambda c: F.when(~malformed, c)
    name = lambda c: F.when(malformed, "").otherwise(F.col(c))
    return dead.select(
        "event_id", "correlation_id", reason.alias("reason"), error.alias("error"),
        "topic", "partition", "offset",
        name("source_name").alias("source_name"), name("source_database").alias("source_database"),
        name("source_table").alias("source_table"), name("operation").alias("operation"),
        F.col("key_json").alias("key"),
        whole(jv.image_json(F.col("image"))).alias("payload"),
        whole(jv.image_json(F.col("before"))).alias("before"),
        whole(F.col("source_metadata")).alias("source_metadata"),
        whole(F.col("column_schema")).alias("column_schema"),
        F.when(malformed, F.col("raw_event")).alias("raw_event"),
        F.when(drifted, F.col("contract_key")).alias("contract_key"),
        F.when(drifted, F.col("contract_schema")).alias("canonical_schema"),
        F.when(drifted, F.struct(*[F.col(c) for c in drift.REPORT])).alias("drift_report"),
        "ts_ms", F.current_timestamp().alias("received_at"))
