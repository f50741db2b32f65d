"""Waiting dead letters as keyed streaming state, with back-off.

Each event has its own state: the dead letter, how often it was deferred, what the last attempt has to do
better, and whether it is decided. A dead letter is due when it first comes. What a batch decides comes back
as a stream of outcomes: a final one ends the event's state but for a mark, any other makes the event due again
after a time that doubles with each deferral, by a timer if that time has not passed. So a batch holds the
events that are due and no others, and no history is read; an event that comes again, waiting or decided,
is passed over. A query that runs all the time looks at its timers with each trigger; one that is started for
what is available looks at them when there is anything new.

Each event that such state sees costs Python some calls to the state store, and most events are decided when they
first come. So a query that starts with a checkpoint and output of its own and forgets nothing takes events that first
come from Spark's own de-duplication. Only an event that has to wait gets state of its own: its outcome brings the
dead letter along. What is so is written in the checkpoint (``first_tries``) and stays; any other query, also one
whose checkpoint is older, takes every event through the state.

The state lies in Spark's state store under the query's checkpoint and is restored by a restart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidegate import fixed_values as fixed
from tidegate.plans.staging import make_folder
from tidegate.streaming.ledger import children

#: ``owner`` names the query whose state of waiting events has to hear of it, ``letter`` is what then starts to wait.
OUTCOME = ("event_id string, status string, feedback array<string>, next_attempt int, tried_at timestamp, "
           "owner string, letter string")
_DUE = "event_id string, letter string, deferrals int, feedback array<string>, next_attempt int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times and nested values of a dead letter survive as text.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class EventProgress(StatefulProcessor):
    """One event: from its dead letter over its deferrals to its decision."""

    def __init__(self, first_wait_ms: int, longest_wait_ms: int, remember_ms: int | None):
        self.first_wait_ms, self.longest_wait_ms, self.remember_ms = first_wait_ms, longest_wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "letter string, deferrals int, feedback array<string>, next_attempt int")
        self.decided = handle.getValueState("decided", "status string", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        letter, outcome = None, None
        for row in rows:
            if row.status is None:
                letter = letter or row.letter
            else:
                outcome = row
        begins = outcome is not None and outcome.letter is not None
        if self.decided.exists():
            return
        if outcome is not None and outcome.status in fixed.TERMINAL_STATUSES:
            self.waiting.clear()
            self.decided.update((outcome.status,))
        elif (known := self.waiting.exists()) or begins:
            if outcome is not None:
                held, deferrals, feedback, attempt = self.waiting.get() if known else (outcome.letter, 0, [], 1)
                now = (held, deferrals + 1, outcome.feedback or feedback, outcome.next_attempt or attempt)
                self.waiting.update(now)
                due = outcome.tried_ms + min(self.first_wait_ms * 2 ** min(deferrals, 30), self.longest_wait_ms)
                if due <= timerValues.getCurrentProcessingTimeInMs():
                    yield self._due(key, now)
                else:
                    self.handle.registerTimer(due)
        elif letter is not None:
            now = (letter, 0, [], 1)
            self.waiting.update(now)
            yield self._due(key, now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            yield self._due(key, self.waiting.get())

    def _due(self, key, waiting: tuple) -> Row:
        letter, deferrals, feedback, attempt = waiting
        return Row(event_id=key[0], letter=letter, deferrals=deferrals, feedback=feedback, next_attempt=attempt)


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    if spark.conf.get(_PROVIDER, None) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def first_tries(spark: SparkSession, checkpoint: str, out: str, remember_days: float | None) -> str | None:
    """The name under which a query keeps only events that wait in its state; None for one that keeps every event there.

    Such a query begins with a new checkpoint, without outcomes of others and with no time after which it forgets.
    """
    marks = f"{checkpoint}/first_tries"
    if not children(spark, f"{marks}/*"):
        if remember_days is not None or children(spark, f"{checkpoint}/metadata") or children(spark, f"{out}/outcomes/run=*"):
            return None
        make_folder(spark, f"{marks}/{uuid.uuid4().hex}")
    return children(spark, f"{marks}/*")[0].rsplit("/", 1)[-1]


def as_letter(columns: list[str]) -> Column:
    """A dead letter as it waits."""
    return F.to_json(F.struct(*columns), _JSON)


def due_events(dead: DataFrame, outcomes: DataFrame, first_wait_seconds: float, longest_wait_seconds: float,
               remember_days: float | None = None, owner: str | None = None) -> DataFrame:
    """The dead letters (a stream) that are due, with ``deferrals``, ``feedback`` and ``next_attempt``.

    ``outcomes`` (a stream of ``OUTCOME``) tells what became of those that were due before. Decided events are
    known for ``remember_days``, without a number of days for good. With an ``owner`` (``first_tries``) an event is
    due without state when it first comes, and the state hears of the owner's outcomes only.
    """
    use_state_store(dead.sparkSession)
    none = {name: F.lit(None).cast(kind) for name, kind in (
        ("status", "string"), ("feedback", "array<string>"), ("next_attempt", "int"), ("tried_ms", "long"))}
    heard = outcomes.withColumn("letter", F.lit(None).cast("string")) if owner is None else outcomes.where(F.col("owner") == owner)
    told = heard.select("event_id", "letter", "status", "feedback", "next_attempt", F.unix_millis("tried_at").alias("tried_ms"))
    if owner is None:
        told = dead.select("event_id", as_letter(dead.columns).alias("letter"), *(c.alias(n) for n, c in none.items())).unionByName(told)
    processor = EventProgress(int(first_wait_seconds * 1000), int(longest_wait_seconds * 1000),
                              None if remember_days is None else int(remember_days * 86_400_000))
    due = told.groupBy("event_id").transformWithState(processor, _DUE, "append", "processingTime")
    again = due.withColumn("d", F.from_json("letter", dead.schema, _JSON)).select("d.*", "deferrals", "feedback", "next_attempt")
    if owner is None:
        return again
    new = dead.dropDuplicates(["event_id"]).withColumns({
        "deferrals": F.lit(0), "feedback": F.array().cast("array<string>"), "next_attempt": F.lit(1)})
    # both have as many partitions as there are of state: a pair of them is one task
    return new.unionByName(again).coalesce(int(dead.sparkSession.conf.get("spark.sql.shuffle.partitions")))
