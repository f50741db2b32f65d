"""The repair stream: deferrals, feedback and approved repairs over restarts, and the state of one event."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.helpers import ON_HAND, envelope, log
from tests.test_delivery import CATALOG, run
from tidegate.operators import proposals, repair
from tidegate.operators.routing import route_changes, to_dlq
from tidegate.streaming import pipelines as sp
from tidegate.streaming.waiting import EventProgress


@pytest.fixture(scope="module")
def letters(spark, tmp_path_factory):
    """Dead letters 1 to 4 with a renamed column, 5 with one too many."""
    renamed = {"product_id": ON_HAND["product_id"], "stock_quantity": ("int32", "INT", False)}
    wide = dict(ON_HAND, note=("string", "VARCHAR(9)", True))
    images = [{"product_id": i, "stock_quantity": i} for i in range(1, 5)] + [{"product_id": 5, "quantity": 2, "note": "x"}]
    values = [envelope("products_on_hand", im, columns=renamed if "stock_quantity" in im else wide, pos=im["product_id"]) for im in images]
    path = str(tmp_path_factory.mktemp("letters") / "all")
    to_dlq(route_changes(log(spark, values, [{"product_id": im["product_id"]} for im in images]), CATALOG)).write.parquet(path)
    return lambda *numbers: spark.read.parquet(path).filter(F.col("offset").isin([n - 1 for n in numbers]))


def stream(spark, tmp_path, letters, propose):
    """A function that appends dead letters and runs the query over what there is."""
    p = lambda name: str(tmp_path / name)

    def go(*numbers):
        if numbers:
            letters(*numbers).write.mode("append").parquet(p("dlq"))
        source = spark.readStream.schema(letters(1).schema).parquet(p("dlq"))
        run(lambda: sp.start_repair(source, propose, CATALOG, p("out"), p("c"), first_wait_seconds=0, availableNow=True))

    return go, sp.RepairState(p("out")), lambda name: spark.read.parquet(p(f"out/{name}"))


def test_repair_stream_remembers(spark, tmp_path, letters):
    """Deferred events are tried again and audited once, final ones are not, approved repairs serve later events."""
    able = []

    def propose(requests):
        found = proposals.propose_from_report(requests, CATALOG)
        return found if able else found.filter(F.lit(False))

    go, state, written = stream(spark, tmp_path, letters, propose)
    go(1, 2)
    assert state.waiting(spark).count() == 2 and written("repaired").count() == 0
    go(1, 2)  # a restart: both are tried again, and that they come again changes nothing
    assert [r.repair_result for r in written("audit").collect()] == ["DEFERRED"] * 2
    assert {r.deferrals for r in repair.latest_decisions(state.decisions(spark)).collect()} == {2}
    able.append(True)
    go(3)  # the deferred events come back besides the new one
    assert written("repaired").count() == 3 and state.approved(spark).count() == 1 and state.waiting(spark).count() == 0
    able.clear()
    go(4)  # no proposal any more, but an approved repair
    assert sorted(r.repair_source for r in written("repaired").collect()) == ["cache", "model", "model", "model"]
    assert {r.status for r in repair.latest_decisions(state.decisions(spark)).collect()} == {"REPAIRED"}
    assert written("audit").groupBy("event_id", "repair_result").count().filter("count > 1").isEmpty()


def test_the_proposer_hears_what_was_wrong(spark, tmp_path, letters):
    """An attempt that is not final leaves its feedback to the next one, over a restart."""
    asked = []

    def propose(requests):
        asked.extend((r.next_attempt, list(r.feedback)) for r in requests.collect())
        found = proposals.propose_from_report(requests, CATALOG, attempts=1)
        if len(asked) == 1:  # keeps what the contract does not have
            return found.withColumn("mapping", F.map_concat("mapping", F.create_map(F.lit("note"), F.lit("note"))))
        return found

    go, _, written = stream(spark, tmp_path, letters, propose)
    go(5)
    go()
    assert asked[0] == (1, []) and asked[1][0] == 2 and "leave these out: unexpected: ['note']" in asked[1][1]
    assert written("repaired").count() == 1


class Value:
    def __init__(self):
        self.held = None

    exists = lambda self: self.held is not None
    get = lambda self: self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


def event(first=1_000, longest=5_000):
    """An event's state outside of Spark, its clock and its timers."""
    timers, clock = [], SimpleNamespace(now=0)
    progress = EventProgress(first, longest, None)
    progress.init(SimpleNamespace(getValueState=lambda *_: Value(), registerTimer=timers.append))
    values = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: clock.now)

    def feed(*rows):
        return [tuple(r) for r in progress.handleInputRows(("e",), iter(rows), values)]

    return progress, feed, timers, clock, values


def dead():
    return SimpleNamespace(letter="{}", status=None)


def outcome(status, at, feedback=None, attempt=None):
    return SimpleNamespace(letter=None, status=status, feedback=feedback, next_attempt=attempt, tried_ms=at)


def test_back_off_doubles_up_to_its_bound():
    progress, feed, timers, clock, values = event()
    assert feed(dead(), dead()) == [("e", "{}", 0, [], 1)]
    assert feed(dead()) == []  # it waits already
    for at in (0, 10_000, 20_000, 30_000):
        clock.now = at + 1
        assert feed(outcome("DEFERRED", at)) == []
    assert timers == [1_000, 12_000, 24_000, 35_000]
    assert [tuple(r) for r in progress.handleExpiredTimer(("e",), values, None)] == [("e", "{}", 4, [], 1)]
    clock.now = 90_000
    assert feed(outcome("RETRY_AI", 30_000, ["mind x"], 2)) == [("e", "{}", 5, ["mind x"], 2)]  # its time has passed
    assert feed(outcome("DEFERRED", 80_000)) == [("e", "{}", 6, ["mind x"], 2)]  # feedback stays until there is other


def test_decided_events_stay_decided():
    progress, feed, timers, _, values = event()
    feed(dead())
    assert feed(outcome("REPAIRED", 0)) == [] and feed(dead()) == [] and feed(outcome("DEFERRED", 0)) == []
    assert list(progress.handleExpiredTimer(("e",), values, None)) == [] and timers == []
    progress, feed, timers, _, _ = event()
    assert feed(outcome("DEFERRED", 0)) == [] and timers == []  # an outcome of an event that is not known


def test_an_outcome_that_brings_its_letter_begins_the_wait():
    _, feed, timers, clock, _ = event()
    first = SimpleNamespace(letter="{}", status="DEFERRED", feedback=["mind x"], next_attempt=2, tried_ms=0)
    assert feed(first) == [] and timers == [1_000]  # it has been tried once, at the time 0
    clock.now = 3_000
    assert feed(outcome("DEFERRED", 500)) == [("e", "{}", 2, ["mind x"], 2)]
    assert feed(outcome("REPAIRED", 3_000)) == [] and feed(first) == []


def test_only_waiting_events_have_state_and_none_is_decided_twice(spark, tmp_path, letters):
    """Two queries take turns on one output: the first keeps what waits in its state, the other, that finds outcomes, everything."""
    p = lambda name: str(tmp_path / name)

    def go(checkpoint, *numbers):
        letters(*numbers).write.mode("append").parquet(p("dlq"))
        query = sp.start_repair(spark.readStream.schema(letters(1).schema).parquet(p("dlq")),
                                lambda requests: proposals.propose_from_report(requests, CATALOG), CATALOG, p("out"), p(checkpoint),
                                first_wait_seconds=0, availableNow=True)
        query.awaitTermination()
        operators = [o for progress in query.recentProgress for o in progress["stateOperators"]]
        return {o["operatorName"]: o["numRowsTotal"] for o in operators}

    first = go("a", 1, 1, 2)
    assert first.pop("dedupe") == 2 and list(first.values()) == [0]
    assert "dedupe" not in go("b", 3)
    go("a", 1)  # the third comes to the first query when the other has decided it
    audit = spark.read.parquet(p("out/audit"))
    assert audit.count() == 3 and audit.select("event_id").distinct().count() == 3
