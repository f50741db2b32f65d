"""The registered queries: every operator over whole tables.

Plans that several queries share are built once per session and data folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import configure
from tidegate.functions import jsonvalue as jv
from tidegate.functions.text import stable_quantity, weight_to_kg
from tidegate.operators import checks, clean, delivery, drift, envelope, observe, proposals, repair, routing
from tidegate.plans import feed
from tidegate.plans.staging import shared_folder, spread, staged, write_shared
from tidegate.sources import catalog as cat, committed
from tidegate.sources.catalog import Catalog
from tidegate.sources.changelog import read_change_log
from tidegate.sources.destinations import DestinationConfig
from tidegate.functions.sqltypes import TypeMatrix
from tidegate.streaming import pipelines
from tidegate.streaming.shapes import ShapeDictionary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SQL_TYPES = ["INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "FLOAT", "DOUBLE", "DECIMAL(10,2)",
             "DECIMAL(12,2)", "VARCHAR(20)", "VARCHAR(255)", "CHAR(10)", "TEXT", "LONGTEXT",
             "INT UNSIGNED", "INT(11)", "GEOMETRY"]
CONNECT_TYPES = ["boolean", "double", "float", "int16", "int32", "int64", "int8", "string"]
UNITS = ["pounds", "ounces", "kg", "g", "lbs", "stone"]
DESTINATIONS = [
    DestinationConfig("errors_only", "json_log", tables=("app.web.error",)),
    DestinationConfig("everything", "json_log", tables=("*",)),
    DestinationConfig("not_views", "json_log", tables=("app.web.[!v]*",)),
    DestinationConfig("off", "json_log", enabled=False),
    DestinationConfig("six_letters", "json_log", tables=("app.*.??????", "crm.*")),
]

#: What every row of a contract would repeat.
_OF_CONTRACT = ["fields", "contract_schema"]


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


@lru_cache(maxsize=1)
def default_catalog() -> Catalog:
    return Catalog.default()


@lru_cache(maxsize=4)
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_changes(feed.part_feed(spark, sf_dir), default_catalog())


@lru_cache(maxsize=4)
def stored_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed messages but tombstones, decoded and compared once for dead letters and clean changes.

    The message as it was sent is not stored again, and what a contract says of all of its rows comes from the catalogue.
    """
    kept = routed(spark, sf_dir).where(~F.col("outcome").startswith("skipped:")).drop("key", "value", "timestamp", *_OF_CONTRACT)
    contracts = default_catalog().contracts_df(spark).select("contract_key", *_OF_CONTRACT)
    return staged(kept, "routes").join(F.broadcast(contracts), "contract_key", "left")


@lru_cache(maxsize=4)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ShapeDictionary(f"{shared_folder(spark)}/shapes-{uuid.uuid4().hex}")
    dead = stored_routes(spark, sf_dir).where(F.col("outcome").startswith("dlq:"))
    return staged(routing.to_dlq(dead, meet=shapes.meet), "dlq")


@lru_cache(maxsize=4)
def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    dlq = dead_letters(spark, sf_dir)
    found = proposals.propose_from_report(proposals.repair_requests(dlq), default_catalog())
    done = repair.repair(repair.pending_dlq(dlq), found, default_catalog())
    return staged(done.drop("column_schema", "canonical_schema", "raw_event"), "decided")  # the dead letters hold these


@lru_cache(maxsize=4)
def clean_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(delivery.to_changes(
        routing.to_validated(stored_routes(spark, sf_dir)), repair.to_repaired(decided(spark, sf_dir)),
        default_catalog()), "changes")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(array: Column) -> Column:
    return F.array_join(array, "; ")


# --- decode, drift, route -----------------------------------------------------------------


@query
def outcome_counts(spark, sf_dir):
    return observe.outcome_counts(routing.with_reports(routed(spark, sf_dir)))


@query
def validated_rows(spark, sf_dir):
    rows = routing.to_validated(routed(spark, sf_dir))
    row = F.from_json("payload", "id bigint, name string, description string, weight double, "
                                 "product_id bigint, quantity bigint")
    return rows.withColumn("r", row).select(
        "offset", "operation", "source_table", "contract_id", "key", "ts_ms",
        F.coalesce("schema_notice.control_event", F.lit("")).alias("control_event"),
        F.col("r.id").alias("id"), F.col("r.name").alias("name"), F.col("r.description").alias("description"),
        F.col("r.weight").alias("weight"), F.col("r.product_id").alias("product_id"),
        F.col("r.quantity").alias("quantity"))


@query
def compatible_widening(spark, sf_dir):
    """Lossless widenings pass with a notice when the setting says so."""
    passed = routing.to_validated(routing.route_changes(
        feed.part_feed(spark, sf_dir), default_catalog(), compatible_type_change_routing="validated"))
    change = F.col("schema_notice.compatible_type_changes")[0]
    return passed.filter("schema_notice.compatible_type_changes IS NOT NULL").select(
        "offset", change["field"].alias("field"), change["expected"].alias("expected"),
        change["actual"].alias("actual"), change["compatibility"].alias("compatibility"))


@query
def dlq_rows(spark, sf_dir):
    return dead_letters(spark, sf_dir).select(
        "offset", "topic", "partition", "correlation_id", "reason", "error", "source_table", "operation",
        F.col("payload").isNotNull().alias("has_payload"), F.col("before").isNotNull().alias("has_before"),
        F.length("raw_event").alias("raw_chars"))


@query
def drift_reports(spark, sf_dir):
    r = F.col("drift_report")
    t = F.transform(r["type_mismatches"], lambda t: F.concat_ws(
        ":", t["field"], t["expected"], t["actual"], t["level"], t["compatibility"]))
    n = F.transform(r["nullability_changes"], lambda n: F.concat_ws(":", n["field"], n["level"], n["detail"]))
    return dead_letters(spark, sf_dir).filter("drift_report IS NOT NULL").select(
        "offset", r["drift_type"].alias("drift_type"), r["ambiguous"].alias("ambiguous"),
        r["confidence"].alias("confidence"), texts(r["missing_fields"]).alias("missing"),
        texts(r["unexpected_fields"]).alias("unexpected"), texts(t).alias("type_changes"),
        texts(n).alias("nullability"), texts(r["validation_errors"]).alias("errors"),
        r["fingerprint"].alias("fingerprint"))


@query
def rename_pairs(spark, sf_dir):
    pair = F.explode("drift_report.possible_renames").alias("r")
    return dead_letters(spark, sf_dir).select("offset", pair).select(
        "offset", "r.missing_field", "r.unexpected_field", "r.confidence", "r.ambiguous",
        texts(F.col("r.evidence")).alias("evidence"))


@query
def fingerprint_groups(spark, sf_dir):
    requests = proposals.repair_requests(dead_letters(spark, sf_dir))
    return requests.select("contract_key", F.col("drift_report.drift_type").alias("drift_type"), "events")


@query
def event_ids(spark, sf_dir):
    return envelope.parse_envelopes(feed.part_feed(spark, sf_dir)).filter(
        ~F.col("is_tombstone")).select("offset", "correlation_id", "event_id")


def _document_log(spark, sf_dir, name, key, text):
    return table(spark, sf_dir, name).select(
        F.lit(None).cast("binary").alias("key"), F.col(text).cast("binary").alias("value"),
        F.lit(name).alias("topic"), F.lit(0).alias("partition"), F.col(key).alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"))


@query
def malformed_documents(spark, sf_dir):
    """Whole documents as messages: none is JSON, each is isolated with all of its text."""
    log = _document_log(spark, sf_dir, "documents", "doc_id", "text")
    return routing.to_dlq(routing.route_changes(log, default_catalog())).select(
        F.col("offset").alias("doc_id"), "reason", "event_id", F.length("raw_event").alias("raw_chars"),
        F.md5("raw_event").alias("raw_hash"))


@query
def malformed_envelopes(spark, sf_dir):
    """JSON that is not a change envelope."""
    log = _document_log(spark, sf_dir, "events", "event_id", "props")
    return routing.to_dlq(routing.route_changes(log, default_catalog())).select(
        F.col("offset").alias("message"), "reason", "error", "raw_event")


@query
def contract_violations(spark, sf_dir):
    """Documents against a contract with a length limit."""
    document = {
        "type": "object", "properties": {
            "doc_id": {"type": "integer", "x-sql-type": "INT"},
            "lang": {"type": ["string", "null"], "maxLength": 2, "x-sql-type": "CHAR(2)"},
            "text": {"type": "string", "maxLength": 255, "x-sql-type": "VARCHAR(255)"}},
        "required": ["doc_id", "lang", "text", "title"], "additionalProperties": False}
    contracts = Catalog.from_documents(
        {"sources": {"docs": {"engine": "mysql", "database": "docs", "tables": [
            {"name": "documents", "primary_key": ["doc_id"], "contract": "d"}]}}}, {"d": document})
    value = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("text"))
    image = F.create_map(
        F.lit("doc_id"), value("integer", F.col("doc_id")), F.lit("lang"), value("string", F.col("lang")),
        F.lit("text"), value("string", F.col("text")), F.lit("source"), value("string", F.col("source")))
    rows = table(spark, sf_dir, "documents").withColumns({"image": image, "one": F.lit("docs.docs.documents")})
    joined = rows.join(contracts.contracts_df(spark).withColumnRenamed("contract_key", "one"), "one")
    checked = checks.check_loadable(drift.validate_contract(joined))
    return checked.select(
        "doc_id", F.size("validation_errors").alias("n_errors"), F.size("load_problems").alias("n_load_problems"),
        F.try_element_at("validation_errors", F.lit(2)).alias("additional"),
        texts(F.col("load_problems")).alias("load_problems"))


@query
def payload_views(spark, sf_dir):
    """Shortened copies of whole documents."""
    value = F.struct(F.lit("string").alias("kind"), F.col("text").alias("text"))
    rows = table(spark, sf_dir, "documents").withColumn("image", F.create_map(F.lit("text"), value))
    view = F.try_element_at("payload_view", F.lit("text"))["text"]
    return envelope.compact_payload(rows).select("doc_id", F.md5(view).alias("view_hash"))


@query
def type_verdicts(spark, sf_dir):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    pk, n, m = F.col("p_partkey"), len(SQL_TYPES), len(CONNECT_TYPES)
    matrix = TypeMatrix()
    rows = table(spark, sf_dir, "part").select(
        pick(SQL_TYPES, pk % n).alias("expected"), pick(SQL_TYPES, F.floor(pk / n) % n).alias("actual"),
        pick(CONNECT_TYPES, pk % m).alias("c_expected"), pick(CONNECT_TYPES, F.floor(pk / m) % m).alias("c_actual"))
    return rows.withColumns({
        "verdict": matrix.verdict(F.col("expected"), F.col("actual")),
        "c_verdict": matrix.connect_verdict(F.col("c_expected"), F.col("c_actual")),
    }).groupBy("expected", "actual", "verdict", "c_expected", "c_actual", "c_verdict").agg(
        F.count("*").alias("parts"))


@query
def narrow_fits(spark, sf_dir):
    kinds = ["TINYINT", "SMALLINT", "INT"]
    fits = drift.fit_narrower_types(table(spark, sf_dir, "lineitem"), dict.fromkeys(("l_orderkey", "l_quantity", "l_suppkey"), kinds))
    return fits.withColumn("max_abs", F.col("max_abs").cast("bigint"))


@query
def drift_summaries(spark, sf_dir):
    """What is told of a drift without values of the row."""
    summary = dead_letters(spark, sf_dir).filter("drift_report IS NOT NULL").select("offset", "drift_report.*").select(
        "offset", drift.drift_summary().alias("s"))
    return summary.select(
        "offset", "s.drift_type", "s.ambiguous", "s.confidence", F.size("s.missing_fields").alias("missing"),
        F.size("s.unexpected_fields").alias("unexpected"), F.size("s.type_mismatches").alias("type_changes"),
        F.size("s.nullability_changes").alias("null_changes"), F.size("s.possible_renames").alias("renames"))


# --- nothing is cut -------------------------------------------------------------------------


def _long_feed(spark, sf_dir):
    """A stock change per document; the key is the whole text and no JSON."""
    docs = table(spark, sf_dir, "documents").withColumns({"p_partkey": F.col("doc_id"), "p_size": F.col("n_chars")})
    row = feed.json_object(product_id=F.col("doc_id"), quantity=F.col("n_chars"))
    columns = {"product_id": ("int32", "INT", None, False), "quantity": ("int32", "INT", None, False)}
    value = feed.envelope(feed.schema_json(columns), "products_on_hand", "c", row)
    key = F.concat(F.lit("{"), "text", F.col("doc_id").cast("string"))
    return docs.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit(feed.TOPIC).alias("topic"),
                       F.lit(0).alias("partition"), F.col("doc_id").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"))


@query
def long_keys(spark, sf_dir):
    """Keys of any length stay apart: one current row for each."""
    validated = routing.to_validated(routing.route_changes(_long_feed(spark, sf_dir), default_catalog()))
    none = validated.filter(F.lit(False)).drop("schema_notice")
    current = delivery.latest_per_key(delivery.to_changes(validated, none, default_catalog()))
    return current.select(F.col("offset").alias("doc_id"), F.md5(F.get_json_object("key", "$.raw_key")).alias("key_hash"),
                          F.get_json_object("payload", "$.quantity").cast("bigint").alias("quantity"))


@query
def long_dead_letters(spark, sf_dir):
    """JSON that is no envelope, of three times the text, comes back whole."""
    docs = table(spark, sf_dir, "documents").withColumn("long", F.to_json(F.struct(F.repeat("text", 3).alias("said"))))
    log = docs.select(F.lit(None).cast("binary").alias("key"), F.col("long").cast("binary").alias("value"), F.lit("d").alias("topic"),
                      F.lit(0).alias("partition"), F.col("doc_id").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"))
    said = F.get_json_object("raw_event", "$.said")
    return routing.to_dlq(routing.route_changes(log, default_catalog())).select(
        F.col("offset").alias("doc_id"), "reason", F.length(said).alias("chars"), F.md5(said).alias("hash"))


@query
def large_positions(spark, sf_dir):
    """Log numbers of 19 digits and positions beyond 63 bits are ordered, not lost."""
    e = F.col("event_id")
    whole = lambda c: c.cast("decimal(38,0)").cast("string")
    meta = F.when(e % 2 == 0, F.create_map(F.lit("lsn"), whole(F.lit("9300000000000000000").cast("decimal(20,0)") + e))).otherwise(
        F.create_map(F.lit("file"), F.lit("log.000002"), F.lit("pos"), whole(F.lit("10000000000000000000").cast("decimal(20,0)") + e)))
    return table(spark, sf_dir, "events").select(
        "event_id", delivery.source_sequence(meta, F.lit(1).cast("bigint")).cast("string").alias("sequence"))


WIDE = [f"measured_value_of_sensor_number_{i:03}" for i in range(130)]
#: Of such rows one takes as long as dozens of narrow ones.
WIDE_PER_TASK = 1_000


@query
def wide_table_repairs(spark, sf_dir):
    """A row of 130 long-named columns and one new one is repaired."""
    document = {"type": "object", "properties": {n: {"type": "integer", "x-sql-type": "BIGINT"} for n in WIDE},
                "required": WIDE, "additionalProperties": False}
    contracts = Catalog.from_documents({"sources": {"wide": {"engine": "mysql", "database": "wide", "topic_prefix": "cdc", "tables": [
        {"name": "sensors", "primary_key": [WIDE[0]], "contract": "d"}]}}}, {"d": document})
    rows = spread(table(spark, sf_dir, "supplier"), WIDE_PER_TASK).withColumn("p_partkey", F.col("s_suppkey"))
    row = feed.json_object(**{n: F.col("s_suppkey") + i for i, n in enumerate(WIDE)}, added=F.col("s_name"))
    value = F.replace(feed.envelope("{}", "sensors", "c", row), F.lit('"db":"inventory"'), F.lit('"db":"wide"'))
    log = rows.select(F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("w").alias("topic"),
                      F.lit(0).alias("partition"), F.col("s_suppkey").alias("offset"), F.lit(None).cast("timestamp").alias("timestamp"))
    shapes = ShapeDictionary(f"{shared_folder(spark)}/shapes-{uuid.uuid4().hex}", contracts.matrix)
    dead = staged(routing.route_changes(log, contracts).where(F.col("outcome").startswith("dlq:")), "wide-dead")
    dlq = staged(routing.to_dlq(dead, contracts.matrix, meet=shapes.meet), "wide")
    found = proposals.propose_from_report(proposals.repair_requests(dlq), contracts)
    done = repair.repair(repair.pending_dlq(dlq), found, contracts)
    return done.select(F.col("offset").alias("s_suppkey"), "status", F.size("chosen.proposal.mapping").alias("mapped"),
                       (F.length(F.to_json("chosen.proposal.mapping")) > 8000).alias("long_mapping"))


@query
def stored_log(spark, sf_dir):
    """The feed as a stored log, read back and routed."""
    path = write_shared(feed.part_feed(spark, sf_dir), "log")
    return routing.route_changes(read_change_log(spark, path), default_catalog()).groupBy("outcome").agg(F.count("*").alias("messages"))


# --- repair ---------------------------------------------------------------------------------


@query
def proposal_test_cases(spark, sf_dir):
    """A proposal's own cases: how many hold under its mapping."""
    pk = F.col("p_partkey")
    case = lambda out: F.struct(
        F.create_map(F.lit("stock"), F.col("p_size").cast("string"), F.lit("other"), F.col("p_name")).alias("input"),
        F.create_map(F.lit("quantity"), out).alias("expected_output"))
    cases = F.array(case(F.col("p_size").cast("string")), case(F.when(pk % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.create_map(F.lit("quantity"), F.lit("stock")).alias("mapping"),
        F.when(pk % 5 == 0, F.slice(cases, 1, 0)).otherwise(cases).alias("test_cases"))
    return checks.check_test_cases(rows).select("p_partkey", F.col("test_result.passed").alias("passed"),
                                                F.col("test_result.total").alias("total"))



@query
def decisions(spark, sf_dir):
    return decided(spark, sf_dir).select(
        "offset", "reason", "status", "risk", texts(F.col("reasons")).alias("reasons"),
        F.coalesce("chosen.proposal.attempt", F.lit(0)).alias("attempt"))


@query
def repaired_rows(spark, sf_dir):
    row = F.from_json("payload", "id bigint, name string, description string, weight double, "
                                 "product_id bigint, quantity bigint")
    return repair.to_repaired(decided(spark, sf_dir)).withColumn("r", row).select(
        "offset", "operation", "source_table", "contract_id", "repair_classification", "repair_source",
        "confidence", F.coalesce("migration_sql", F.lit("")).alias("migration_sql"), "migration_status",
        F.size(F.json_object_keys("payload")).alias("n_fields"),
        F.col("r.id").alias("id"), F.col("r.name").alias("name"), F.col("r.description").alias("description"),
        F.col("r.weight").alias("weight"), F.col("r.product_id").alias("product_id"),
        F.col("r.quantity").alias("quantity"))


@query
def repair_checks(spark, sf_dir):
    """Every check of every decision: which ran and how they ended."""
    return decided(spark, sf_dir).select(
        F.col("drift_report.drift_type").alias("drift_type"), F.posexplode("chosen.checks").alias("position", "c")
    ).groupBy("drift_type", "position", F.col("c.name").alias("check_name"), F.col("c.passed").alias("passed")
              ).agg(F.count("*").alias("rows"))


@query
def audit_rows(spark, sf_dir):
    return repair.to_audit(decided(spark, sf_dir)).groupBy(
        "source_table", "dlq_reason", "drift_type", "classification", "confidence", "risk_level",
        "migration_status", "attempts", "sandbox_result", "validation_result", "repair_result").agg(
            F.count("*").alias("events"))


@query
def repair_reports(spark, sf_dir):
    """The text report of every decision."""
    reports = repair.render_report(repair.to_audit(decided(spark, sf_dir)))
    line = lambda topic: F.regexp_extract("report", f"(?m)^{topic} +(.*)$", 1)
    return reports.groupBy(
        line("drift").alias("drift"), line("pairs").alias("renames"), line("schema").alias("migration"),
        F.regexp_extract("report", r"^\w+", 0).alias("decision")).agg(F.count("*").alias("reports"))


@query
def cached_repairs(spark, sf_dir):
    """Approved repairs are reused by drift shape and checked again."""
    done = decided(spark, sf_dir)
    dlq = dead_letters(spark, sf_dir)
    nothing_new = proposals.propose_from_report(
        proposals.repair_requests(dlq), default_catalog()).filter(F.lit(False))
    again = repair.repair(repair.pending_dlq(dlq), nothing_new, default_catalog(),
                          approved=repair.approve_repairs(done))
    return again.select("offset", "status", F.coalesce("chosen.proposal.origin", F.lit("")).alias("repair_source"))


@query
def deferred_events(spark, sf_dir):
    """Drift without a proposal waits, and says so once."""
    dlq = dead_letters(spark, sf_dir)
    some = proposals.propose_from_report(proposals.repair_requests(dlq), default_catalog()).filter(
        "classification <> 'RENAMED_COLUMN'")
    waiting = repair.repair(repair.pending_dlq(dlq), some, default_catalog())
    return repair.defer(waiting).select("correlation_id", "drift_type", "repair_result")


@query
def deferrals_over_batches(spark, sf_dir):
    """The dead letters through the repair stream: renames find no proposer in its first run and one after its restart."""
    folder = f"{shared_folder(spark)}/repairs-{uuid.uuid4().hex}"
    dead_letters(spark, sf_dir).write.parquet(f"{folder}/dlq")
    schema = dead_letters(spark, sf_dir).schema
    for able in (False, True):
        def propose(requests):
            found = proposals.propose_from_report(requests, default_catalog())
            return found if able else found.filter("classification <> 'RENAMED_COLUMN'")

        pipelines.start_repair(spark.readStream.schema(schema).parquet(f"{folder}/dlq"), propose, default_catalog(), f"{folder}/out",
                               f"{folder}/checkpoint", first_wait_seconds=0, availableNow=True).awaitTermination()
    decided = repair.latest_decisions(pipelines.RepairState(f"{folder}/out").decisions(spark))
    audit = spark.read.parquet(f"{folder}/out/audit").groupBy("event_id").agg(
        F.first("correlation_id").alias("correlation_id"), F.count_if(F.col("repair_result") == "DEFERRED").alias("deferred_audits"),
        F.count("*").alias("audits"))
    return decided.join(audit, "event_id").select("correlation_id", "status", "deferrals", "deferred_audits", "audits")


@query
def retry_feedback(spark, sf_dir):
    """A first attempt that keeps unexpected fields is sent back with directions."""
    dlq = dead_letters(spark, sf_dir)
    extra = F.transform("drift_report.unexpected_fields", lambda f: F.struct(f.alias("key"), f.alias("value")))
    requests = proposals.repair_requests(dlq)
    first = proposals.propose_from_report(requests, default_catalog(), attempts=1)
    keep = first.join(requests.select("fingerprint", F.map_from_entries(extra).alias("more")), "fingerprint")
    clashing = F.map_filter("more", lambda k, _: ~F.map_contains_key("mapping", k))
    tried = keep.withColumn("mapping", F.map_concat("mapping", clashing)).drop("more")
    said = repair.feedback(repair.repair(repair.pending_dlq(dlq), tried, default_catalog()))
    return said.withColumn("line", F.explode("feedback")).groupBy("next_attempt", "line").agg(
        F.count("*").alias("events"))


@query
def pending_events(spark, sf_dir):
    """Redelivered dead letters without those already decided for good."""
    dlq = dead_letters(spark, sf_dir)
    twice = dlq.unionByName(dlq.withColumn("offset", F.col("offset") + 1000000000))
    made = repair.record_decisions(decided(spark, sf_dir)).filter("status <> 'MANUAL_REVIEW'")
    return repair.pending_dlq(twice, made).select("offset", "reason")


@query
def replayed_repairs(spark, sf_dir):
    fixed_rows = repair.to_repaired(decided(spark, sf_dir))
    mapped = checks.apply_mapping(F.col("chosen.proposal.mapping"), jv.image_of_text(F.col("payload")))
    again = decided(spark, sf_dir).filter("status = 'REPAIRED'").select(
        "event_id", jv.image_json(mapped).alias("payload"))
    return repair.replay_check(fixed_rows, again).groupBy("identical").agg(F.count("*").alias("events"))


@query
def proposal_shapes(spark, sf_dir):
    """Answers as JSON text: strict shape, nothing coerced."""
    pk = F.col("p_partkey")
    good = ('{"classification":"RENAMED_COLUMN","confidence":0.9,"reasoning_summary":"r","risk_level":"LOW",'
            '"mapping":{"quantity":"stock"},"actions":%s,"test_cases":[]%s}')
    response = (
        F.when(pk % 6 == 0, good % ("null", "")).when(pk % 6 == 1, good % ('"none;"', ""))
        .when(pk % 6 == 2, good % ("[]", ',"extra":1')).when(pk % 6 == 3, F.col("p_name"))
        .when(pk % 6 == 4, F.lit((good % ("[]", "")).replace("0.9", "1.5").replace("LOW", "EXTREME")))
        .otherwise((good % ("[]", "")).replace('"reasoning_summary":"r",', "")))
    rows = table(spark, sf_dir, "part").select(
        pk.cast("string").alias("fingerprint"), F.lit("k").alias("contract_key"), F.lit(1).alias("attempt"),
        response.alias("response"))
    return proposals.check_proposals(proposals.read_proposals(rows)).select(
        F.col("fingerprint").cast("bigint").alias("p_partkey"), texts(F.col("violations")).alias("violations"),
        F.coalesce(F.size("actions"), F.lit(-1)).alias("n_actions"))


@query
def schema_action_policy(spark, sf_dir):
    pk = F.col("p_partkey")
    case = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (pk % 9 + 1).cast("int"))
    action = F.struct(
        case(*["modify_column"] * 3, "add_column", "add_column", "change_column", "create_index", "add_column",
             "drop_column").alias("kind"),
        F.when(pk % 9 == 7, "orders").otherwise("products").alias("table"),
        case("name", "weight", "name", F.lit("note"), "weight", "weight", "by_name", "note", "name").alias("column"),
        F.when(pk % 9 == 5, "wt").alias("new_column"),
        case("VARCHAR(512)", "INT", "VARCHAR(255)", "VARCHAR(64)", "FLOAT", "FLOAT", "INT", "GEOMETRY", "INT").alias("sql_type"),
        (pk % 9).isin(1, 3, 4, 5, 7).alias("nullable"), F.lit(None).cast("string").alias("default"),
        F.when(pk % 9 == 6, F.array(F.lit("name"), F.lit("size"))).alias("index_columns"))
    rows = table(spark, sf_dir, "part").withColumn("actions", F.array(action)).select(
        "p_partkey", F.lit("inventory.inventory.products").alias("contract_key"), "actions")
    p = F.col("policy")
    return proposals.check_schema_actions(rows, default_catalog()).select(
        "p_partkey", p["allowed"].alias("allowed"), p["destructive"].alias("destructive"),
        p["risk"].alias("risk"), texts(p["violations"]).alias("violations"),
        F.when(p["allowed"], p["statements"][0]).otherwise("").alias("statement"))


@query
def column_diff(spark, sf_dir):
    """Two descriptions of one table per part."""
    pk = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    named = F.concat(F.lit("t"), pk.cast("string"))
    column = lambda name, kind, nullable: F.struct(
        F.lit(name).alias("column_name"), kind.alias("column_type"), nullable.alias("nullable"),
        F.lit(None).cast("string").alias("column_default"))
    def described(columns: Column) -> DataFrame:
        listed = part.select(named.alias("table_name"), F.array_compact(columns).alias("cols"))
        return listed.select("table_name", F.explode("cols").alias("c")).select("table_name", "c.*")
    no, yes = F.lit(False), F.lit(True)
    before = described(F.array(column("a", F.lit("INT"), no), column("b", F.lit("VARCHAR(20)"), yes)))
    after = described(F.array(
        F.when(pk % 5 != 0, column("a", F.when(pk % 5 == 1, "SMALLINT").otherwise("BIGINT"), no)),
        column("b", F.lit("VARCHAR(20)"), pk % 5 != 2),
        F.when(pk % 5 == 3, column("c", F.lit("INT"), no))))
    return checks.diff_columns(before, after)


# --- deliver ----------------------------------------------------------------------------------


@query
def change_records(spark, sf_dir):
    return clean_changes(spark, sf_dir).select(
        "offset", "table_ref", "op", "key", F.col("sequence").cast("bigint").alias("sequence"), "origin",
        F.col("repair_id").isNotNull().alias("has_repair"), "contract_id", "source_ts_ms")


@query
def current_products(spark, sf_dir):
    """Validated and repaired rows as a typed current table."""
    contract = default_catalog().contracts["inventory.inventory.products_on_hand"]
    log = delivery.typed_changes(clean_changes(spark, sf_dir), contract)
    return delivery.latest_row_view(log, ["product_id"]).select(
        "product_id", "quantity", "_op", F.col("_seq").cast("bigint").alias("_seq"), "_origin")


@query
def latest_per_user(spark, sf_dir):
    return delivery.latest_per_key(feed.event_changes(spark, sf_dir)).select(
        "key", "op", F.col("sequence").cast("bigint").alias("sequence"), "origin",
        F.get_json_object("payload", "$.event_type").alias("event_type"))


@query
def current_users(spark, sf_dir):
    return delivery.current_view(delivery.latest_per_key(feed.event_changes(spark, sf_dir))).select(
        "key", F.get_json_object("payload", "$.value").cast("double").alias("value"), "event_id")


@query
def late_arrivals(spark, sf_dir):
    """The history delivered in three batches out of order ends in the same state."""
    changes = feed.event_changes(spark, sf_dir)
    batch = lambda n: changes.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n)
    state = delivery.latest_per_key(batch(2))
    for n in (0, 1):
        state = delivery.upsert_current(state, batch(n))
    return delivery.upsert_current(state, batch(2)).select(
        "key", "op", F.col("sequence").cast("bigint").alias("sequence"), "event_id")


@query
def changelog_rows(spark, sf_dir):
    lines = delivery.json_log_lines(feed.event_changes(spark, sf_dir))
    row = F.from_json("value", "user_id bigint, value double, event_type string, _op string, _seq bigint, "
                               "_event_id string, _repair_id string, _origin string, _key struct<user_id bigint>")
    return lines.select("source", "database", "table", row.alias("r")).select(
        "source", "database", "table", "r.user_id", "r.value", "r.event_type",
        "r._op", "r._seq", "r._event_id", "r._repair_id", "r._origin", F.col("r._key.user_id").alias("key_user_id"))


def _by_type(spark, sf_dir):
    return feed.event_changes(spark, sf_dir).withColumn(
        "table_ref", F.concat(F.lit("app.web."), F.get_json_object("payload", "$.event_type")))


@query
def routed_by_glob(spark, sf_dir):
    return delivery.route_to_destinations(_by_type(spark, sf_dir), DESTINATIONS).groupBy(
        "destination", "table_ref").agg(F.count("*").alias("changes"))


@query
def dedupe_redelivered(spark, sf_dir):
    """Everything delivered twice, minus what the destination holds (the errors)."""
    changes = feed.event_changes(spark, sf_dir)
    again = changes.withColumn("offset", F.col("offset") + 1000000000)
    held = changes.filter("op = 'd'").select(F.col("event_id").alias("_event_id"))
    new = delivery.drop_delivered(delivery.dedupe_batch(changes.unionByName(again)), held)
    return new.select("event_id", "op", "offset")


@query
def live_row_counts(spark, sf_dir):
    state = delivery.latest_per_key(_by_type(spark, sf_dir))
    return delivery.row_counts(state)


@query
def key_lookup(spark, sf_dir):
    found = delivery.lookup_key(feed.event_changes(spark, sf_dir), "app.web.users", '{"user_id":8}')
    return found.select("changes", "latest.op", "latest.event_id",
                        F.col("latest.sequence").cast("bigint").alias("sequence"))


@query
def source_sequences(spark, sf_dir):
    """Orders by log file and position, by log number and by time."""
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    meta = F.when(e % 3 == 0, F.create_map(
        F.lit("file"), F.concat(F.lit("bin."), F.lpad(text(e % 20000), 6, "0")), F.lit("pos"), text(e),
        F.lit("row"), text(F.col("user_id")))).when(
        e % 3 == 1, F.create_map(F.lit("lsn"), text(e * 11))).otherwise(
        F.create_map(F.lit("ts_ms"), text(e + 5)))
    return table(spark, sf_dir, "events").select(
        "event_id", delivery.source_sequence(meta, F.lit(7).cast("bigint")).cast("string").alias("sequence"))


@query
def stored_destinations(spark, sf_dir):
    """What destinations hold after delivery, those of typed tables only under contract."""
    changes = clean_changes(spark, sf_dir)
    folder = f"{shared_folder(spark)}/destinations-{uuid.uuid4().hex}"
    targets = [pipelines.build_destination(DestinationConfig(kind, kind, options={option: f"{folder}/{kind}"}))
               for kind, option in (("current", "path"), ("json_log", "root"), ("table_log", "root"))]
    for target in targets:
        target.write(changes, default_catalog(), "once", 0)
    return pipelines.read_destinations(spark, targets, default_catalog()).groupBy("destination", "table_ref", "op").agg(
        F.count("*").alias("changes"), F.max("sequence").cast("bigint").alias("last"))


@query
def ledger_index(spark, sf_dir):
    """The batch that each event is stored in, after a redelivery of everything and a replay of its batch."""
    events = feed.event_changes(spark, sf_dir)
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    target = pipelines.build_destination(DestinationConfig("log", "json_log", options={"root": folder, "ledger_buckets": 8}))
    batches = [events.where("offset % 3 = 0"), events.where("offset % 3 < 2").unionByName(events.where("offset % 5 = 0"))]
    for run, batch_id, batch in (("a", 0, batches[0]), ("a", 1, batches[1]), ("a", 1, batches[1]), ("b", 0, events), ("b", 1, events)):
        new = target.not_delivered(delivery.dedupe_batch(batch), default_catalog(), run, batch_id)
        target.write(new, default_catalog(), run, batch_id)
        target.after_write(new, default_catalog(), run, batch_id)
    stored = spark.read.text(folder).where("batch is not null")
    return stored.select(F.get_json_object("value", "$._event_id").alias("event_id"), F.get_json_object("value", "$._op").alias("op"),
                         F.get_json_object("value", "$.value").cast("double").alias("value"), "run", F.col("batch").cast("int").alias("batch"))


@query
def current_buckets(spark, sf_dir):
    """Current rows of a bucketed state after late batches and a replay; read without aggregation."""
    events = feed.event_changes(spark, sf_dir)
    folder = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    target = pipelines.build_destination(DestinationConfig("state", "current_buckets", options={"path": folder, "buckets": 8}))
    for batch_id, part in ((0, 2), (1, 0), (2, 1), (2, 1)):
        target.write(events.where(F.col("offset") % 3 == part), default_catalog(), "a", batch_id)
    return target.read(spark).select("key", "op", F.col("sequence").cast("bigint").alias("sequence"), "event_id",
                                     F.get_json_object("payload", "$.value").cast("double").alias("value"), "origin")


@query
def committed_batches(spark, sf_dir):
    """Events through the committed log: by a stream, and by frames of which one comes again with other rows."""
    events = feed.event_changes(spark, sf_dir)
    folder = f"{shared_folder(spark)}/committed-{uuid.uuid4().hex}"
    source = write_shared(events, "events")
    spark.dataSource.register(committed.LogSource)
    log = spark.readStream.schema(events.schema).parquet(source).writeStream.format(committed.FORMAT)
    log.option("checkpointLocation", f"{folder}/checkpoint").option("run", "stream").trigger(availableNow=True).start(
        f"{folder}/log").awaitTermination()
    for batch, part in ((0, "offset % 3 = 0"), (1, "offset % 3 = 1"), (1, "offset % 3 >= 1")):
        committed.append(events.where(part), f"{folder}/log", "frames", batch)
    return committed.read_log(spark, f"{folder}/log", events.schema).select(
        "event_id", "op", "key", "payload", F.col("sequence").cast("bigint").alias("sequence"), "repair_id", "origin", "offset",
        "run", F.col("batch").cast("int").alias("batch"))


@query
def versioned_rows(spark, sf_dir):
    """A column that was an integer, a number and then a string, and one that came later, in one typed table."""
    part, folder = table(spark, sf_dir, "part"), f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    target = pipelines.build_destination(DestinationConfig("lake", "table_log", options={"root": folder}))
    stages = (("integer", F.col("p_size"), {}), ("number", F.col("p_retailprice"), {}),
              ("string", F.col("p_name"), {"brand": F.col("p_brand")}))
    for i, (kind, reading, more) in enumerate(stages):
        fields = {"id": {"type": "integer"}, "reading": {"type": kind}} | {n: {"type": "string"} for n in more}
        contracts = Catalog.from_documents({"sources": {"app": {"engine": "mysql", "database": "shop", "tables": [
            {"name": "readings", "primary_key": ["id"], "contract": "d"}]}}}, {"d": {"type": "object", "properties": fields}})
        pk, ref = F.col("p_partkey"), "app.shop.readings"
        rows = part.where(pk % 3 == i).select(
            F.concat(F.lit("part-"), pk.cast("string")).alias("event_id"), F.lit("app").alias("source"), F.lit("shop").alias("database"),
            F.lit("readings").alias("table"), F.lit(ref).alias("table_ref"), F.lit("c").alias("op"), feed.json_object(id=pk).alias("key"),
            feed.json_object(id=pk, reading=reading, **more).alias("payload"), pk.cast("decimal(38,0)").alias("sequence"),
            F.lit("validated").alias("origin"), F.lit(None).cast("string").alias("repair_id"), F.lit(0).cast("bigint").alias("source_ts_ms"),
            F.lit(0).alias("partition"), pk.cast("bigint").alias("offset"))
        target.write(rows, contracts, "a", i)
    return target.read_table(spark, contracts.contracts[ref]).select("id", "reading", "brand", "_event_id")


# --- observe ------------------------------------------------------------------------------------


@query
def repair_counts(spark, sf_dir):
    return observe.repair_counts(decided(spark, sf_dir))


@query
def decision_stats(spark, sf_dir):
    return observe.decision_stats(repair.latest_decisions(repair.record_decisions(decided(spark, sf_dir))))


@query
def latency_histogram(spark, sf_dir):
    return observe.latency_histogram(table(spark, sf_dir, "events"), "value")


@query
def delivery_stats(spark, sf_dir):
    routed_rows = delivery.route_to_destinations(_by_type(spark, sf_dir), DESTINATIONS)
    result = F.when(F.col("op") == "d", "duplicate").when(F.col("op") == "c", "skipped").otherwise("delivered")
    return observe.delivery_stats(routed_rows.select(
        "destination", result.alias("result"), F.col("source_ts_ms").alias("delivered_at")))


@query
def topic_counts(spark, sf_dir):
    return observe.topic_counts(feed.event_changes(spark, sf_dir))


@query
def peek_last(spark, sf_dir):
    """The last five of the topic, and of each of its partitions."""
    changes = feed.event_changes(spark, sf_dir).withColumn("timestamp", F.timestamp_millis("source_ts_ms"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "topic", "partition", "offset", "event_id")
    return named(observe.peek(changes, 5), "topic").unionByName(named(observe.peek(changes, 5, per_partition=True), "partition"))


@query
def find_repairs(spark, sf_dir):
    return observe.find(feed.event_changes(spark, sf_dir), "origin", "repaired").select("event_id", "repair_id")


@query
def event_traces(spark, sf_dir):
    done = decided(spark, sf_dir)
    landed = delivery.route_to_destinations(clean_changes(spark, sf_dir), DESTINATIONS).select(
        F.col("event_id").alias("_event_id"), "destination")
    return observe.trace(dead_letters(spark, sf_dir), repair.to_repaired(done), repair.to_audit(done), landed).select(
        "dlq_coordinates", "reason", F.coalesce("drift_type", F.lit("")).alias("drift_type"), "repair_result",
        "is_repaired", F.coalesce(F.array_join("destinations", ","), F.lit("")).alias("destinations"))


# --- contracts and loading ----------------------------------------------------------------------


def _brand_columns(spark, sf_dir):
    """A table per brand with a column per part type."""
    part = table(spark, sf_dir, "part")
    size = F.max("p_size").cast("int")
    return part.groupBy("p_brand", "p_type").agg(size.alias("size")).select(
        F.lit("brands").alias("table_schema"), F.col("p_brand").alias("table_name"),
        F.col("p_type").alias("column_name"),
        F.concat(F.lit("varchar("), F.col("size").cast("string"), F.lit(")")).alias("column_type"),
        F.lit("varchar").alias("data_type"), F.when(F.col("size") > 40, "YES").otherwise("NO").alias("is_nullable"),
        F.when(F.col("p_type") == "ECONOMY", "PRI").otherwise("").alias("column_key"),
        F.col("size").alias("character_maximum_length"), F.ascii("p_type").alias("ordinal_position"))


@query
def generated_contracts(spark, sf_dir):
    return cat.generate_contracts(_brand_columns(spark, sf_dir))


@query
def contract_versions(spark, sf_dir):
    """Contracts that a registry does not hold yet get the next version of their subject."""
    made = cat.generate_contracts(_brand_columns(spark, sf_dir)).select(
        F.concat(F.lit("contract.x."), "table_name", F.lit("-value")).alias("subject"),
        F.col("contract_document").alias("schema"))
    held = F.length("schema") % 2 == 0
    registry = made.select(
        "subject", F.lit(1).alias("version"),
        F.when(held, F.substring(F.sha2("schema", 256), 1, 12)).otherwise("older").alias("version_hash"), "schema")
    new = cat.register_contract_versions(made, registry)
    return cat.latest_contract_versions(registry.unionByName(new)).select("subject", "version")


@query
def weight_kg(spark, sf_dir):
    pk = F.col("p_partkey")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (pk % len(UNITS) + 1).cast("int"))
    text = F.concat(F.col("p_size").cast("string"), F.lit(".3 "), unit)
    return table(spark, sf_dir, "part").select(
        "p_partkey", weight_to_kg(F.when(pk % 7 == 0, F.col("p_name")).otherwise(text)).alias("kg"))


@query
def stock_quantities(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", stable_quantity(F.col("p_partkey")).alias("quantity"))


@query
def mapped_rows(spark, sf_dir):
    spec = {"name": {"from": ["missing", "p_name"], "max_length": 8},
            "kind": {"from": ["p_type"]}, "stock": {"from": "p_brand", "transform": "stable_quantity"}}
    return clean.map_columns(table(spark, sf_dir, "part"), spec, keep=["p_partkey"])


@query
def loaded_products(spark, sf_dir):
    """Part names that no small part has, loaded as new products with fresh ids."""
    part = table(spark, sf_dir, "part")
    parent = part.filter("p_size <= 2").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("quantity"),
                       F.col("p_brand").alias("brand"))
    parents, children = clean.load_new(
        rows, parent, ["quantity", "brand"], part.select(F.col("p_size").alias("quantity")), "product_id",
        order="p_partkey")
    return parents.join(children, parents["id"] == children["product_id"]).select("id", "name", "quantity")
