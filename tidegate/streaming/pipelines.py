"""Streaming pipelines: the batch operators inside ``foreachBatch``.

Output is keyed by ``run=<query id>/batch=<batch id>`` and written with
overwrite: a batch that is replayed after a failure rewrites itself, and a query
that starts with a new checkpoint (and counts its batches from 0 again) cannot
overwrite the history of another.  The delivered rows are their own ledger: each
carries its event id, and what other runs and batches hold is left out by it.
There is no second write that a stop could separate from the first.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegate import fixed_values as fixed
from tidegate.functions.names import RenameHints
from tidegate.operators import delivery, observe, proposals, repair, routing
from tidegate.operators.joins import first_per
from tidegate.plans.staging import drop_shared, make_folder
from tidegate.sources import committed
from tidegate.sources.catalog import Catalog, Contract
from tidegate.sources.destinations import DestinationConfig, DestinationError, import_class
from tidegate.streaming.ledger import BUCKETS, DeliveredIndex, children
from tidegate.streaming.shapes import ShapeDictionary
from tidegate.streaming.waiting import OUTCOME, as_letter, due_events, first_tries

RUN_COLUMNS = ("run", "batch")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint; it survives restarts."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def _read(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame | None:
    """A table with its ``run`` and ``batch``; None while nothing was written."""
    try:
        return spark.read.format(kind).option("basePath", path).schema(f"{schema}, run string, batch bigint").load(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def start_validation(log: DataFrame, catalog: Catalog, out: str, checkpoint: str,
                     hints: RenameHints | None = None, compatible_type_change_routing: str = "dlq",
                     **trigger: Any) -> StreamingQuery:
    """Route a change log stream into ``out/validated``, ``out/dlq`` and ``out/counts``; renames are kept by shape in ``out/shapes``."""
    shapes = ShapeDictionary(f"{out}/shapes", catalog.matrix, hints)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark, checkpoint)
        routed = routing.route_changes(batch, catalog, compatible_type_change_routing).persist()
        try:
            outputs = {"validated": routing.to_validated(routed), "dlq": routing.to_dlq(routed, catalog.matrix, hints, shapes.meet),
                       "counts": observe.outcome_counts(routing.with_reports(routed, catalog.matrix, hints, shapes.meet))}
            for name, frame in outputs.items():
                frame.write.mode("overwrite").parquet(f"{out}/{name}/run={run}/batch={batch_id}")
        finally:
            routed.unpersist()

    return _start(log, run_batch, checkpoint, trigger)


class Destination(ABC):
    """Where changes are delivered.  ``write`` may run again for the same batch."""

    def __init__(self, name: str, options: dict[str, Any]):
        self.name, self.options = name, options

    @abstractmethod
    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        """Store a batch; raising makes the query retry it as a whole."""

    def delivered(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame | None:
        """``_event_id`` of everything stored by other batches, or None when ids do not matter."""
        return None

    def not_delivered(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> DataFrame:
        """The changes that no other batch has stored."""
        held = self.delivered(changes.sparkSession, run, batch_id)
        return changes if held is None else delivery.drop_delivered(changes, held)

    def after_write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        """Called after a batch is stored; may run again for the same batch."""


_CHANGE = ["table_ref", "op", "key", "payload", "sequence", "event_id", "repair_id", "origin", "partition", "offset"]
_LINE = "_op string, _seq decimal(38,0), _event_id string, _repair_id string, _origin string, _partition int, _offset bigint"


class _FileDestination(Destination):
    """Delivered rows below a folder.

    Logs know redelivered events by an index of ids in ``ledger_buckets`` hash buckets. ``look_back_days``
    does without it: then the rows of so many days are read for each batch.
    """

    option = "root"

    def __init__(self, name: str, options: dict[str, Any]):
        super().__init__(name, options)
        if not options.get(self.option):
            raise DestinationError(f"{name}: options.{self.option} is missing")
        self.root = options[self.option]
        self.look_back_days = options.get("look_back_days")
        self.ledger = DeliveredIndex(f"{self.root}/_ledger", int(options.get("ledger_buckets", BUCKETS)))

    def read(self, spark: SparkSession, catalog: Catalog) -> DataFrame | None:
        """Everything stored, as change records; None while there is nothing."""
        raise NotImplementedError

    def _others(self, stored: DataFrame | None, run: str, batch_id: int) -> DataFrame | None:
        """What other batches hold within the look-back; files of other days and of this batch are not read."""
        if stored is None:
            return None
        others = stored.filter(~((F.col("run") == run) & (F.col("batch") == batch_id)))
        if self.look_back_days is None:
            return others
        return others.filter(F.col("dt") >= F.date_sub(F.current_date(), int(self.look_back_days)))


class _Log(_FileDestination):
    """An append-only log; its rows are the truth about what is delivered, its ledger an index of their ids."""

    #: The folders that hold ``run=``, below the root.
    _above_runs = ""

    def not_delivered(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> DataFrame:
        if self.look_back_days is not None:
            return super().not_delivered(changes, catalog, run, batch_id)
        spark = changes.sparkSession

        def ids_of(batches: list[tuple[str, int]]) -> DataFrame:
            mine = F.lit(False)
            for own, batch in batches:
                mine = mine | ((F.col("run") == own) & (F.col("batch") == batch))
            return self._stored_ids(spark).where(mine).select(F.col("_event_id").alias("event_id"))

        self.ledger.heal(spark, f"{self.root}{self._above_runs}", ids_of, run, batch_id)
        return self.ledger.drop_held(changes, run, batch_id)

    def after_write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        self.ledger.add(changes.select("event_id"), run, batch_id)

    def _stored_ids(self, spark: SparkSession) -> DataFrame | None:
        """``_event_id``, ``run``, ``batch`` and ``dt`` of everything stored."""
        raise NotImplementedError

    def delivered(self, spark: SparkSession, run: str, batch_id: int) -> DataFrame | None:
        others = self._others(self._stored_ids(spark), run, batch_id)
        return None if others is None else others.select("_event_id")


class JsonLog(_Log):
    """Append-only JSON lines per source, database, table and day."""

    _columns = "value string, source string, database string, `table` string, dt date"

    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        delivery.append_changelog_json(changes, f"{self.root}/run={run}/batch={batch_id}", "overwrite")

    def _stored_ids(self, spark: SparkSession) -> DataFrame | None:
        lines = _read(spark, self.root, self._columns, "text")
        return None if lines is None else lines.select(
            F.get_json_object("value", "$._event_id").alias("_event_id"), *RUN_COLUMNS, "dt")

    def read(self, spark: SparkSession, catalog: Catalog) -> DataFrame | None:
        lines = _read(spark, self.root, self._columns, "text")
        if lines is None:
            return None
        return lines.withColumn("m", F.from_json("value", _LINE)).select(
            F.concat_ws(".", "source", "database", "table").alias("table_ref"), F.col("m._op").alias("op"),
            F.get_json_object("value", "$._key").alias("key"), F.col("value").alias("payload"), F.col("m._seq").alias("sequence"),
            F.col("m._event_id").alias("event_id"), F.col("m._repair_id").alias("repair_id"),
            F.col("m._origin").alias("origin"), F.col("m._partition").alias("partition"), F.col("m._offset").alias("offset"))


class TableLog(_Log):
    """Append-only typed tables, one for each contract, partitioned by day.

    Files lie below the version of the contract that they were typed by, so each is read with the types it was
    written with: ``read`` gives the stored values, ``read_table`` promotes the columns of all versions to common
    types. Changes of a table without a contract have no columns to be stored in; they are kept in ``_unrouted``,
    not counted as delivered, and delivered when they come again after the contract (``unrouted`` reads them).
    """

    #: Tables of before versions were kept hold their runs directly.
    _above_runs = "/{table=*,table=*/contract=*}"

    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        spark, place = changes.sparkSession, f"run={run}/batch={batch_id}"
        contracts = catalog.contracts_df(spark).select(F.col("contract_key").alias("table_ref"))
        # at most as many rows as the catalogue has contracts
        touched = changes.join(contracts, "table_ref", "left_semi").select("table_ref").distinct().collect()
        for ref in sorted(row.table_ref for row in touched):
            contract, folder = catalog.contracts[ref], f"{self.root}/table={delivery.table_folder(*ref.split('.', 2))}"
            own = f"contract={contract.version}/{place}"
            delivery.append_changelog_table(changes, contract, f"{folder}/{own}", "overwrite")
            for other in children(spark, f"{folder}/contract=*/{place}"):
                if not other.endswith(f"/{own}"):  # the contract changed between a batch and its replay
                    drop_shared(spark, other)
        changes.join(contracts, "table_ref", "left_anti").write.mode("overwrite").parquet(f"{self.root}/_unrouted/{place}")

    def after_write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        contracts = catalog.contracts_df(changes.sparkSession).select(F.col("contract_key").alias("table_ref"))
        super().after_write(changes.join(contracts, "table_ref", "left_semi"), catalog, run, batch_id)

    def _stored_ids(self, spark: SparkSession) -> DataFrame | None:
        out = None
        for below, more in (("contract=*", ", contract string"), ("run=*", "")):
            if children(spark, f"{self.root}/table=*/{below}"):
                ids = spark.read.option("basePath", self.root).schema(
                    f"_event_id string, `table` string, dt date, run string, batch bigint{more}").parquet(
                    f"{self.root}/table=*/{below}").select("_event_id", *RUN_COLUMNS, "dt")
                out = ids if out is None else out.unionByName(ids)
        return out

    def unrouted(self, spark: SparkSession) -> DataFrame:
        """Changes of tables without a contract."""
        return spark.read.parquet(f"{self.root}/_unrouted")

    def versions(self, spark: SparkSession, contract: Contract) -> Iterator[DataFrame]:
        """The stored rows of a table per version of its contract, each with the types of its time."""
        folder = f"{self.root}/table={delivery.table_folder(*contract.key.split('.', 2))}"
        paths = children(spark, f"{folder}/contract=*") + ([folder] if children(spark, f"{folder}/run=*") else [])
        for path in paths:
            files = f"{path}/run=*/batch=*/dt=*"
            if children(spark, files):  # the schema of another version is that of its files
                own = path.endswith(f"/contract={contract.version}")
                yield (spark.read.schema(delivery.contract_to_schema(contract)) if own else spark.read).parquet(files)

    def read_table(self, spark: SparkSession, contract: Contract) -> DataFrame | None:
        """The typed rows of a table over all versions of its contract; None while there is none.

        A column has the narrowest type that holds what every version and the contract declare (integer, number,
        string; anything else beside another type becomes a string), and null where a version lacks it. Integers
        beyond 2^53 are rounded in a column of numbers, as they are when written under such a contract.
        """
        stored = list(self.versions(spark, contract))
        if not stored:
            return None
        types = delivery.common_types([delivery.contract_to_schema(contract), *(rows.schema for rows in stored)])
        names = [n for n in types if n not in delivery.META] + delivery.META
        held = [{n.lower(): n for n in rows.columns} for rows in stored]
        out = None
        for rows, known in zip(stored, held):
            one = rows.select(*[
                (F.col(f"`{known[n.lower()]}`") if n.lower() in known else F.lit(None)).cast(types[n]).alias(n) for n in names])
            out = one if out is None else out.unionByName(one)
        return out

    def read(self, spark: SparkSession, catalog: Catalog) -> DataFrame | None:
        out = None
        for ref, contract in sorted(catalog.contracts.items()):
            for rows in self.versions(spark, contract):
                stored = [n for n in rows.columns if n not in delivery.META]
                lacking = [F.lit(None).cast("string").alias(n) for n in contract.columns() if n not in stored]
                keyed = [F.col(f"`{n}`") if n in stored else F.lit(None).cast("string").alias(n) for n in contract.primary_key]
                text = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
                one = rows.select(
                    F.lit(ref).alias("table_ref"), F.col("_op").alias("op"), text(keyed).alias("key"),
                    text([F.col(f"`{n}`") for n in stored] + lacking).alias("payload"), F.col("_seq").alias("sequence"),
                    *[F.col(f"_{c}").alias(c) for c in _CHANGE[5:]])
                out = one if out is None else out.unionByName(one)
        return out


class CommittedLog(_Log):
    """An append-only log of change records whose batches become visible whole (``sources.committed``)."""

    _above_runs = "/commits"
    _columns = ("table_ref string, op string, key string, payload string, sequence decimal(38,0), event_id string, "
                "repair_id string, origin string, partition int, offset bigint, dt date")

    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        committed.append(changes.select(*_CHANGE, F.current_date().alias("dt")), self.root, run, batch_id)

    def _stored_ids(self, spark: SparkSession) -> DataFrame:
        rows = self.read(spark)
        if rows is None:  # batches without rows are batches, too
            return spark.createDataFrame([], "_event_id string, run string, batch bigint, dt date")
        return rows.select(F.col("event_id").alias("_event_id"), *RUN_COLUMNS, "dt")

    def read(self, spark: SparkSession, catalog: Catalog | None = None) -> DataFrame | None:
        return committed.read_log(spark, self.root, self._columns)


class CurrentState(_FileDestination):
    """Current rows per key, kept as a log of each batch's newest changes.

    Repeated and late changes do not alter the newest row, so no ledger is needed.
    """

    option = "path"

    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        delivery.latest_per_key(changes).write.mode("overwrite").parquet(f"{self.root}/log/run={run}/batch={batch_id}")

    def read(self, spark: SparkSession, catalog: Catalog | None = None, with_deleted: bool = False) -> DataFrame:
        """Newest change per key over all batches."""
        log = spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log").drop(*RUN_COLUMNS)
        state = delivery.latest_per_key(log)
        return state if with_deleted else delivery.current_view(state)

    def compact(self, spark: SparkSession) -> None:
        """Replace the batches of the log by one that holds the newest change per key.

        The new batch is written before the old ones go, and both together mean the same, so a
        stop in between does no harm.  Batches that arrive meanwhile stay.
        """
        log = spark.read.option("basePath", f"{self.root}/log").parquet(f"{self.root}/log")
        held = log.select(*RUN_COLUMNS).distinct().collect()  # one row per batch since the last time
        delivery.latest_per_key(log.drop(*RUN_COLUMNS)).write.parquet(f"{self.root}/log/run=compact-{uuid.uuid4().hex}/batch=0")
        for row in held:
            drop_shared(spark, f"{self.root}/log/run={row.run}/batch={row.batch}")


class CurrentBuckets(_FileDestination):
    """Current rows per key as a table in ``buckets`` hash buckets of the key; a read needs no aggregation.

    A batch merges the buckets that its keys fall into and no others. Their new content is first written
    whole to ``pending``; Spark's dynamic partition overwrite then puts it in place. A stop in between leaves
    the pending copy, which the next batch (or ``recover``) puts in place again, so no bucket is lost halfway.
    Last writer wins, hence a replay changes nothing. Deleted rows stay as tombstones.
    """

    option = "path"

    def __init__(self, name: str, options: dict[str, Any]):
        super().__init__(name, options)
        self.buckets = int(options.get("buckets", 64))

    def write(self, changes: DataFrame, catalog: Catalog, run: str, batch_id: int) -> None:
        spark = changes.sparkSession
        self.recover(spark)
        bucket = F.pmod(F.xxhash64("table_ref", "key"), F.lit(self.buckets)).cast("int")
        placed = changes.withColumn("bucket", bucket)
        # at most as many rows as there are buckets
        touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        if not touched:
            return
        paths = [p for b in touched for p in children(spark, f"{self.root}/state/bucket={b}")]
        if paths:
            held = spark.read.option("basePath", f"{self.root}/state").parquet(*paths)
            merged = delivery.upsert_current(held, placed)
        else:
            merged = delivery.latest_per_key(placed)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/pending/run={run}/batch={batch_id}")
        self.recover(spark)

    def recover(self, spark: SparkSession) -> None:
        """Put pending buckets in place; what was not written to its end goes, as its batch runs again."""
        for path in children(spark, f"{self.root}/pending/run=*/batch=*"):
            if children(spark, f"{path}/_SUCCESS"):
                spark.read.parquet(path).repartition("bucket").write.mode("overwrite").option(
                    "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/state")
            drop_shared(spark, path)

    def read(self, spark: SparkSession, catalog: Catalog | None = None, with_deleted: bool = False) -> DataFrame | None:
        """The current rows; None while nothing was delivered."""
        if not children(spark, f"{self.root}/state/bucket=*"):
            return None
        state = spark.read.parquet(f"{self.root}/state").drop("bucket")
        return state if with_deleted else delivery.current_view(state)


DESTINATION_TYPES: dict[str, type[Destination]] = {
    "current": CurrentState, "current_buckets": CurrentBuckets, "json_log": JsonLog,
    "table_log": TableLog, "committed_log": CommittedLog}


def build_destination(config: DestinationConfig) -> Destination:
    """A built-in type or your own ``package.module:ClassName``."""
    found = DESTINATION_TYPES.get(config.type) or import_class(config.type, Destination)
    return found(config.name, config.options)


def start_delivery(changes: DataFrame, config: DestinationConfig, catalog: Catalog, checkpoint: str,
                   destination: Destination | None = None, attempts: str | None = None, **trigger: Any) -> StreamingQuery:
    """Deliver a change stream to one destination.

    Each destination is its own query with its own checkpoint, so a failing one
    neither blocks nor loses data of the others.  ``attempts`` names a folder for the
    counts that ``observe.delivery_stats`` reads.
    """
    target = destination or build_destination(config)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark, checkpoint)
        mine = delivery.route_to(batch, config).persist()
        new = target.not_delivered(delivery.dedupe_batch(mine), catalog, run, batch_id).persist()
        try:
            target.write(new, catalog, run, batch_id)
            target.after_write(new, catalog, run, batch_id)
            if attempts:
                n, n_new = mine.count(), new.count()
                _attempted(spark, config.name, {"delivered": n_new, "duplicate": n - n_new}, f"{attempts}/run={run}/batch={batch_id}")
        except Exception:
            if attempts:
                _attempted(spark, config.name, {"failed_batch": 1}, f"{attempts}/run={run}-{uuid.uuid4().hex}/batch={batch_id}")
            raise
        finally:
            new.unpersist()
            mine.unpersist()

    if not trigger:
        trigger = {"processingTime": f"{config.max_batch_wait_seconds} seconds"}
    return _start(changes, run_batch, checkpoint, trigger, name=f"deliver-{config.name}")


def _attempted(spark: SparkSession, destination: str, results: dict[str, int], path: str) -> None:
    rows = [(destination, result, n) for result, n in results.items()]
    spark.createDataFrame(rows, "destination string, result string, changes bigint").withColumn(
        "delivered_at", F.unix_millis(F.current_timestamp())).coalesce(1).write.mode("overwrite").parquet(path)


def read_destinations(spark: SparkSession, destinations: list[Destination], catalog: Catalog) -> DataFrame | None:
    """Change records of all stored destinations, with ``destination``; for ``lookup_key`` and ``row_counts``."""
    out = None
    for target in destinations:
        stored = target.read(spark, catalog)
        if stored is not None:
            one = stored.select(F.lit(target.name).alias("destination"), *_CHANGE)
            out = one if out is None else out.unionByName(one)
    return out


# --- repair ---------------------------------------------------------------------------------


class RepairState:
    """What a repair stream has written: decisions, outcomes and approved repairs, as tables below a folder."""

    def __init__(self, root: str):
        self.root = root

    def _table(self, spark: SparkSession, name: str, before: tuple[str, int] | None) -> DataFrame | None:
        try:
            found = spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise
        if before is not None:  # a replayed batch does not see what it wrote itself
            found = found.filter(~((F.col("run") == before[0]) & (F.col("batch").cast("bigint") == before[1])))
        return found.drop(*RUN_COLUMNS)

    def decisions(self, spark: SparkSession, before: tuple[str, int] | None = None) -> DataFrame | None:
        return self._table(spark, "decisions", before)

    def approved(self, spark: SparkSession, before: tuple[str, int] | None = None) -> DataFrame | None:
        """The approved repair of each shape; of several the first approved one."""
        found = self._table(spark, "approved", before)
        return None if found is None else first_per(found, ["fingerprint"], [F.col("approved_repair_id")])

    def waiting(self, spark: SparkSession) -> DataFrame | None:
        """Events that wait for another attempt (``event_id``, ``status``, ``feedback``, ``next_attempt``); for people, batches do not read it."""
        outcomes = self._table(spark, "outcomes", None)
        if outcomes is None:
            return None
        last = outcomes.groupBy("event_id").agg(F.max_by(F.struct("status", "feedback", "next_attempt"), "tried_at").alias("o"))
        return last.select("event_id", "o.*").filter(~F.col("status").isin(*fixed.TERMINAL_STATUSES))


def start_repair(dlq: DataFrame, propose: Callable[[DataFrame], DataFrame], catalog: Catalog, out: str, checkpoint: str,
                 settings: repair.RepairSettings = repair.RepairSettings(), first_wait_seconds: float = 30,
                 longest_wait_seconds: float = 3600, remember_days: float | None = None, **trigger: Any) -> StreamingQuery:
    """Decide a stream of dead letters: ``out/repaired``, ``out/audit``, and the tables of ``RepairState`` below ``out``.

    ``propose`` turns repair requests into proposals. A request carries ``feedback``, what earlier proposals
    for its shape have to do better, and ``next_attempt``. Events without a final decision wait in the query's
    state (``streaming.waiting``) and are tried again after a time that doubles with each deferral; the first
    deferral is audited. Approved repairs serve later events of the same shape.
    """
    state, spark = RepairState(out), dlq.sparkSession
    make_folder(spark, f"{out}/outcomes")
    outcomes = spark.readStream.schema(OUTCOME).parquet(f"{out}/outcomes/*/*")
    owner = first_tries(spark, checkpoint, out, remember_days)
    due = due_events(dlq, outcomes, first_wait_seconds, longest_wait_seconds, remember_days, owner)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        me = (query_id(spark, checkpoint), batch_id)
        if owner is not None:
            batch = _not_decided_elsewhere(batch, out, me[0])
        pending = batch.withColumnsRenamed({"deferrals": "_deferrals", "feedback": "_feedback", "next_attempt": "_next_attempt"}).persist()
        told = pending.groupBy(F.col("drift_report.fingerprint").alias("fingerprint")).agg(
            F.max_by(F.struct(F.col("_feedback").alias("feedback"), F.col("_next_attempt").alias("next_attempt")), "_next_attempt").alias("t"))
        requests = proposals.repair_requests(pending).join(told, "fingerprint", "left").select("*", "t.*").drop("t")
        known = state.approved(spark, me)
        decided = repair.repair(pending, propose(requests), catalog, approved=known, settings=settings).persist()
        approved = repair.approve_repairs(decided)
        waits = ~F.col("status").isin(fixed.TERMINAL_STATUSES)
        first = F.col("_deferrals") == 0
        again = repair.feedback(decided).select("event_id", F.col("next_attempt").cast("int").alias("next_attempt"), "feedback")
        audit = repair.to_audit(decided, settings).unionByName(
            repair.defer(decided.filter(F.col("_deferrals") == 0)), allowMissingColumns=True)
        outputs = {
            "repaired": repair.to_repaired(decided, settings), "audit": audit, "decisions": repair.record_decisions(decided),
            "approved": approved if known is None else approved.join(known.select("fingerprint"), "fingerprint", "left_anti"),
            # the last one: it lets the events of this batch move on
            "outcomes": decided.select(
                "event_id", "status", F.when(waits | ~first, F.lit(owner)).cast("string").alias("owner"),
                F.when(waits & first & F.lit(owner is not None), as_letter(dlq.columns)).alias("letter")).join(again, "event_id", "left").select(
                "event_id", "status", "feedback", "next_attempt", F.current_timestamp().alias("tried_at"), "owner", "letter")}
        try:
            for name, frame in outputs.items():
                frame.write.mode("overwrite").parquet(f"{out}/{name}/run={me[0]}/batch={batch_id}")
        finally:
            decided.unpersist()
            pending.unpersist()

    # for timers Spark would go on with empty batches for ever, also where a query is to end
    with _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false" if trigger.keys() & {"availableNow", "once"} else "true"):
        return _start(due, run_batch, checkpoint, trigger, name="repair")


def _not_decided_elsewhere(due: DataFrame, out: str, run: str) -> DataFrame:
    """Without events that another query with the same output has decided; reads nothing while there is none."""
    spark = due.sparkSession
    others = [p for p in children(spark, f"{out}/outcomes/run=*") if not p.endswith(f"/run={run}")]
    batches = [b for p in others for b in children(spark, f"{p}/batch=*")]
    if not batches:
        return due
    told = spark.read.schema("event_id string, status string").parquet(*batches)
    final = told.where(F.col("status").isin(fixed.TERMINAL_STATUSES)).select(F.col("event_id").alias("_decided"))
    return due.join(final, F.col("event_id").eqNullSafe(F.col("_decided")), "left_anti")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is started inside; queries keep those of their start."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _start(frame: DataFrame, run_batch, checkpoint: str, trigger: dict[str, Any],
           name: str | None = None) -> StreamingQuery:
    writer = frame.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()


__all__ = ["CommittedLog", "CurrentBuckets", "CurrentState", "Destination", "JsonLog", "RepairState", "TableLog", "build_destination",
           "query_id", "read_destinations", "start_delivery", "start_repair", "start_validation"]
