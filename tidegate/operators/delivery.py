"""Delivery of clean changes: one shape, routing, de-duplication, current state.

A change log that only grows is the truth; current state is the newest change
per key.  Order comes from the source sequence, never from arrival, so late and
repeated deliveries are harmless.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate import fixed_values as fixed
from tidegate.functions import jsonvalue as jv
from tidegate.functions.binding import fence, seal
from tidegate.functions.text import safe_name
from tidegate.operators.drift import resolve_source
from tidegate.operators.joins import first_per, log_order
from tidegate.sources.catalog import Catalog, Contract
from tidegate.sources.changelog import read_clean_topics
from tidegate.sources.destinations import DestinationConfig

META = ["_op", "_seq", "_event_id", "_repair_id", "_origin", "_source_ts_ms", "_partition", "_offset", "_ingested_at"]
_TYPES = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(),
          "string": T.StringType()}
_META_TYPES = {"_op": T.StringType(), "_seq": T.DecimalType(38, 0), "_event_id": T.StringType(),
               "_repair_id": T.StringType(), "_origin": T.StringType(), "_source_ts_ms": T.LongType(),
               "_partition": T.IntegerType(), "_offset": T.LongType(), "_ingested_at": T.TimestampType()}


# --- changes ------------------------------------------------------------------------------


def source_sequence(metadata: Column, ts_ms: Column) -> Column:
    """Order of a source's changes: log file and position, else log number, else time.

    DECIMAL(38,0), because file numbers from 9224 on exceed 64 bits.
    """
    get = lambda k: F.try_element_at(metadata, F.lit(k))
    number = lambda c: c.try_cast("decimal(20,0)")  # noqa: E731  positions are unsigned 64-bit numbers
    file_no = F.coalesce(number(F.regexp_extract(get("file"), r"(\d+)$", 1)), F.lit(0))
    positioned = (F.coalesce(get("file"), F.lit("")) != "") & get("pos").isNotNull()
    wide = lambda c: c.cast("decimal(38,0)")
    by_file = wide(file_no * F.lit("1000000000000000").cast("decimal(16,0)")) + wide(
        number(get("pos")) * F.lit(1000)) + wide(F.coalesce(number(get("row")), F.lit(0)))
    time = F.coalesce(get("ts_ms").try_cast("bigint"), ts_ms, F.lit(0))
    return wide(F.when(positioned, by_file).when(get("lsn").isNotNull(), wide(number(get("lsn"))))
                .otherwise(wide(time) * F.lit(1000)))


def canonical_source(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``source``: the registry name of a topic prefix, else the name that was sent."""
    sent = F.coalesce(F.nullif(F.col("source_name"), F.lit("")),
                      F.try_element_at("source_metadata", F.lit("name")), F.lit("unknown"))
    return resolve_source(df, catalog).withColumn(
        "source", F.coalesce("registry_name", sent)).drop("registry_name")


def to_changes(validated: DataFrame, repaired: DataFrame, catalog: Catalog) -> DataFrame:
    """Validated and repaired rows as change records.

    Control events and rows without an event id are left out.  A row without a
    message key takes the contract's primary key from its payload; one that has
    neither is left out, since it cannot be addressed (see ``unkeyed``), and so is
    one whose position in the log cannot be read (see ``unordered``).
    """
    return _changes(validated, repaired, catalog).filter("key IS NOT NULL AND sequence IS NOT NULL")


def unkeyed(validated: DataFrame, repaired: DataFrame, catalog: Catalog) -> DataFrame:
    """Row changes that have no key, neither in the message nor by contract."""
    return _changes(validated, repaired, catalog).filter("key IS NULL")


def unordered(validated: DataFrame, repaired: DataFrame, catalog: Catalog) -> DataFrame:
    """Row changes whose position in the source's log is not a number."""
    return _changes(validated, repaired, catalog).filter("key IS NOT NULL AND sequence IS NULL")


def _changes(validated: DataFrame, repaired: DataFrame, catalog: Catalog) -> DataFrame:
    clean = read_clean_topics(validated, repaired)
    is_row = F.col("operation").isin(*fixed.ROW_OPS) & (F.coalesce("event_id", F.lit("")) != "")
    rows = clean.select("*", fence(is_row).alias("_is_row")).filter("_is_row").drop("_is_row")
    if "repair_id" not in rows.columns:
        rows = rows.withColumn("repair_id", F.lit(None).cast("string"))
    meta = lambda k: F.try_element_at("source_metadata", F.lit(k))
    named = canonical_source(rows, catalog).withColumns({
        "database": F.coalesce(F.nullif("source_database", F.lit("")), meta("db"), F.lit("")),
        "table": F.coalesce(F.nullif("source_table", F.lit("")), meta("table"), F.lit("")),
    }).withColumn("table_ref", F.concat_ws(".", "source", "database", "table"))
    keys = catalog.contracts_df(rows.sparkSession).select(
        F.col("contract_key").alias("table_ref"), "primary_key")
    image = jv.image_of_text(F.col("payload"))
    entries = F.transform("primary_key", lambda k: F.struct(
        k.alias("key"), F.try_element_at("_image", k).alias("value")))
    complete = (F.size("primary_key") > 0) & F.forall(
        "primary_key", lambda k: F.coalesce(F.try_element_at("_image", k)["kind"] != "null", F.lit(False)))
    no_key = F.coalesce("key", F.lit("{}")) == "{}"
    return named.join(keys, "table_ref", "left").withColumn(
        "_image", F.when(no_key, image)).select(
            "event_id", "source", "database", "table", "table_ref", F.col("operation").alias("op"),
            F.when(~no_key, F.col("key")).when(complete, jv.image_json(F.map_from_entries(entries))).alias("key"),
            "payload", source_sequence(F.col("source_metadata"), F.col("ts_ms")).alias("sequence"),
            "origin", "repair_id", "correlation_id", "contract_id",
            F.coalesce(meta("ts_ms").try_cast("bigint"), F.col("ts_ms")).alias("source_ts_ms"),
            "topic", "partition", "offset").transform(lambda df: seal(df, ["key", "sequence"]).select(*df.columns))


def dedupe_batch(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each event once, the first in log order."""
    return first_per(changes, [*(by or []), "event_id"], log_order(changes))


def drop_delivered(changes: DataFrame, delivered: DataFrame, column: str = "_event_id") -> DataFrame:
    """Changes that a destination does not hold yet; its own ids are the ledger."""
    return changes.join(delivered.select(F.col(column).alias("event_id")), "event_id", "left_anti")


def _matches(patterns: list[str]) -> Column:
    matched = F.lit(False)
    for p in patterns:
        matched = matched | F.col("table_ref").rlike(p)
    return matched


def route_to_destinations(changes: DataFrame, destinations: list[DestinationConfig]) -> DataFrame:
    """One row per change and enabled destination with a glob for ``<source>.<database>.<table>``.

    Globs are configuration, so they become literal patterns of one expression;
    routing needs neither a join nor a shuffle, however hot a table is.
    """
    names = F.array(*[F.when(_matches(d.patterns), d.name) for d in destinations if d.enabled])
    return changes.withColumn("destination", F.explode(F.array_compact(names)))


def route_to(changes: DataFrame, destination: DestinationConfig) -> DataFrame:
    """The changes of one destination."""
    return changes.filter(_matches(destination.patterns))


# --- current state --------------------------------------------------------------------------


def _order(df: DataFrame, generation: Column) -> Column:
    """Newest by sequence; ties go to the later delivery."""
    tie = [F.col(c) for c in ("partition", "offset") if c in df.columns]
    return F.struct(F.col("sequence"), generation.alias("generation"), *tie, F.col("event_id"))


def latest_per_key(changes: DataFrame) -> DataFrame:
    """The newest change of each (table, key).

    ``max_by`` is combined before the shuffle, so a hot key sends one row per task.
    """
    keys = ["table_ref", "key"]
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), _order(changes, F.lit(0))).alias("newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*changes.columns)


def upsert_current(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Last writer wins: an older change never replaces a newer one, deletes stay as tombstones."""
    columns = [c for c in state.columns if c in changes.columns]
    both = state.select(*columns).withColumn("_gen", F.lit(0)).unionByName(
        changes.select(*columns).withColumn("_gen", F.lit(1)))
    keys = ["table_ref", "key"]
    rest = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*rest), _order(both, F.col("_gen"))).alias("newest")
    return both.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*columns)


def current_view(state: DataFrame) -> DataFrame:
    """Current rows without tombstones."""
    return state.filter(F.col("_op" if "_op" in state.columns else "op") != "d")


def latest_row_view(changelog: DataFrame, primary_key: list[str]) -> DataFrame:
    """Latest row per primary key of a typed change log, deletes removed.

    Ties end as in ``latest_per_key``.  Filters on the key reach the scan below the window.
    """
    tie = [F.desc(c) for c in ("_partition", "_offset") if c in changelog.columns]
    newest = Window.partitionBy(*primary_key).orderBy(F.desc("_seq"), *tie, F.desc("_event_id"))
    return changelog.withColumn("_rn", F.row_number().over(newest)).filter(
        (F.col("_rn") == 1) & (F.col("_op") != "d")).drop("_rn")


def merge_current(spark, table: str, changes: DataFrame) -> None:
    """The same upsert as MERGE, for catalogs whose tables support it."""
    latest_per_key(changes).createOrReplaceTempView("tidegate_changes")
    spark.sql(f"""
        MERGE INTO {table} t USING tidegate_changes c
        ON t.table_ref = c.table_ref AND t.key = c.key
        WHEN MATCHED AND c.sequence >= t.sequence THEN UPDATE SET *
        WHEN NOT MATCHED THEN INSERT *""")


# --- shapes of destinations -------------------------------------------------------------------


def meta_columns(changes: DataFrame) -> list[Column]:
    """Bookkeeping columns that every delivered row carries."""
    place = {"partition": "int", "offset": "bigint"}
    return [
        F.col("op").alias("_op"), F.col("sequence").alias("_seq"), F.col("event_id").alias("_event_id"),
        F.col("repair_id").alias("_repair_id"), F.col("origin").alias("_origin"),
        F.col("source_ts_ms").alias("_source_ts_ms"),
        *[(F.col(c) if c in changes.columns else F.lit(None)).cast(t).alias(f"_{c}") for c, t in place.items()],
        F.current_timestamp().alias("_ingested_at")]


def column_family(contract: Contract, name: str) -> str:
    """integer, number, boolean or string."""
    return next((t for t in contract.columns()[name]["json_types"] if t in _TYPES), "string")


def contract_to_schema(contract: Contract, meta: bool = True) -> T.StructType:
    """Column types of a destination table."""
    schema = T.StructType([T.StructField(n, _TYPES[column_family(contract, n)]) for n in contract.columns()])
    for name in META if meta else []:
        schema = schema.add(name, _META_TYPES[name])
    return schema


def common_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """Per column the narrowest type that holds all of its types, in the order columns first appear; names differ by more than case."""
    out, names = {}, {}
    for field in (f for schema in schemas for f in schema):
        name = names.setdefault(field.name.lower(), field.name)
        known = out.get(name, field.dataType)
        if known != field.dataType:
            numbers = {known, field.dataType} == {T.LongType(), T.DoubleType()}
            known = T.DoubleType() if numbers else T.StringType()
        out[name] = known
    return out


def contract_ddl(contract: Contract, table: str) -> str:
    """CREATE TABLE with the contract's own SQL types."""
    q = lambda n: f"`{n.replace('`', '``')}`"
    columns = []
    for name, spec in contract.columns().items():
        if not spec["sql_type"]:
            raise ValueError(f"contract field {name} has no x-sql-type")
        columns.append(f"{q(name)} {spec['sql_type']} {'NULL' if spec['nullable'] else 'NOT NULL'}")
    if contract.primary_key:
        columns.append(f"PRIMARY KEY ({', '.join(q(c) for c in contract.primary_key)})")
    return f"CREATE TABLE {table} ({', '.join(columns)})"


def destination_table_name() -> Column:
    return safe_name(F.col("source"), F.col("database"), F.col("table"))


def table_folder(*parts: str) -> str:
    """The folder of a table: its parts joined as they are, else made safe and told apart by a hash."""
    plain = "__".join(parts)
    safe = re.sub(r"[^a-z0-9_]+", "_", plain.lower())
    return safe if safe == plain else f"{safe}_{hashlib.sha256(plain.encode()).hexdigest()[:8]}"


def typed_changes(changes: DataFrame, contract: Contract) -> DataFrame:
    """The changes of one table with the contract's columns; key columns come from the key."""
    fields = contract_to_schema(contract, meta=False)
    mine = changes.filter(F.col("table_ref") == contract.key)
    row, key = F.from_json("payload", fields), F.from_json("key", fields)
    return mine.withColumns({"_row": row, "_keyed": key}).select(
        *[F.coalesce(F.col("_keyed")[n], F.col("_row")[n]).alias(n) if n in contract.primary_key
          else F.col("_row")[n].alias(n) for n in fields.names],
        *meta_columns(mine))


def json_log_lines(changes: DataFrame) -> DataFrame:
    """JSON lines (row, bookkeeping, key) with the columns a JSON log is partitioned by."""
    stamped = changes.withColumn("_ingested_at", F.current_timestamp())
    meta = F.to_json(F.struct(*meta_columns(changes)[:-1], "_ingested_at"), {"ignoreNullFields": "false"})
    row = F.coalesce("payload", F.lit("{}"))
    head = F.when(row == "{}", "{").otherwise(F.concat(F.substring(row, 1, F.length(row) - 1), F.lit(",")))
    line = F.concat(head, F.substring(meta, 2, F.length(meta) - 2), F.lit(',"_key":'), F.col("key"), F.lit("}"))
    return stamped.select(line.alias("value"), "source", "database", "table",
                          F.to_date("_ingested_at").alias("dt"))


def append_changelog_json(changes: DataFrame, path: str, mode: str = "append") -> None:
    """Append JSON lines under ``source=/database=/table=/dt=`` (day of ingestion, UTC)."""
    json_log_lines(changes).write.mode(mode).partitionBy("source", "database", "table", "dt").text(path)


def append_changelog_table(changes: DataFrame, contract: Contract, path: str, mode: str = "append") -> None:
    """Append one table's typed changes, partitioned by day of ingestion."""
    typed_changes(changes, contract).withColumn("dt", F.to_date("_ingested_at")).write.mode(
        mode).partitionBy("dt").parquet(path)


# --- lookups ----------------------------------------------------------------------------------


def lookup_key(changes: DataFrame, table_ref: str, key: str) -> DataFrame:
    """Per destination: number of changes of a key and its latest row."""
    per = ["destination"] if "destination" in changes.columns else []
    hit = changes.filter((F.col("table_ref") == table_ref) & (F.col("key") == key))
    return hit.groupBy(*per).agg(
        F.count("*").alias("changes"),
        F.max_by(F.struct("op", "payload", "sequence", "event_id", "repair_id", "origin"),
                 _order(changes, F.lit(0))).alias("latest"))


def row_counts(state: DataFrame) -> DataFrame:
    """Live rows per table (and destination)."""
    per = [c for c in ("destination", "table_ref") if c in state.columns]
    op = F.col("_op" if "_op" in state.columns else "op")
    return state.groupBy(*per).agg(F.count_if(op != "d").alias("live_rows"))
