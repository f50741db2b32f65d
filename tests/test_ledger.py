"""The index of delivered ids and the bucketed current state: what is read, replays and stops halfway."""

import pytest
from pyspark.sql import functions as F

from tests.test_delivery import CATALOG, CHANGE, REF, changes, deliver, quantities, run
from tidegate.operators import delivery as dl
from tidegate.sources.destinations import DestinationConfig
from tidegate.streaming import pipelines as sp
from tidegate.streaming.ledger import DeliveredIndex, children


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "event_id string")


def left(index, spark, names, run_="r", batch=10_000):
    return sorted(r.event_id for r in index.drop_held(ids(spark, *names), run_, batch).collect())


def test_a_batch_reads_its_buckets_of_a_thousand_batches(spark, tmp_path):
    index = DeliveredIndex(str(tmp_path), buckets=16)
    earlier = spark.range(1_000).select(F.concat(F.lit("e-"), "id").alias("event_id"), F.lit("r").alias("run"), F.col("id").alias("batch"))
    earlier.select("event_id", index.bucket().alias("bucket"), "run", "batch").repartition("bucket").write.partitionBy(
        "bucket", "run", "batch").parquet(f"{tmp_path}/ids")
    index._mark(spark, "r", 999)
    batch = ["e-5", "new-1"]
    touched = {r.bucket for r in ids(spark, *batch).select(index.bucket().alias("bucket")).collect()}
    held = index.held(spark, sorted(touched))
    files = held.inputFiles()
    assert files and all(any(f"/bucket={b}/" in f for b in touched) for f in files) and len(files) < 300
    assert left(index, spark, batch) == ["new-1"]
    held.collect()
    scan = held._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == len(files)
    assert left(index, spark, ["e-5"], "r", 5) == ["e-5"]  # a replay does not see its own ids
    index.compact(spark, "merged")
    assert len(children(spark, f"{tmp_path}/ids/bucket=*/run=*")) == 16
    assert left(index, spark, batch) == ["new-1"] and left(index, spark, ["e-5"], "r", 5) == []
    assert [tuple(r)[:2] for r in index.find(spark, ["e-7", "none"]).collect()] == [("e-7", "merged")]
    assert index.find(spark, [f"e-{i}" for i in range(50)]).count() == 50
    assert DeliveredIndex(f"{tmp_path}/none").find(spark, ["x"]) is None


def test_repeated_and_empty_batches(spark, tmp_path):
    index = DeliveredIndex(str(tmp_path), buckets=4)
    assert left(index, spark, ["a"]) == ["a"]
    index.compact(spark, "none")
    index.add(ids(spark, "a", "b"), "r", 0)
    index.add(ids(spark), "r", 1)
    index.add(ids(spark), "r", 2)
    index.add(ids(spark, "c"), "s", 0)
    index.add(ids(spark, "c"), "s", 0)
    assert index.marks(spark) == {"r": 2, "s": 0}
    assert left(index, spark, ["a", "b", "c", "d"]) == ["d"]
    assert index.held(spark, list(range(4))).count() == 3


@pytest.mark.parametrize("kind", ["json_log", "table_log"])
def test_a_stop_between_data_and_ids(spark, tmp_path, kind):
    target = lambda: sp.build_destination(DestinationConfig("d", kind, options={"root": str(tmp_path / "out")}))
    one = changes(spark, (1, 5, 10), (2, 5, 10))
    two = changes(spark, (3, 5, 10), (4, 5, 10))

    def batch(frame, run_, batch_id, ended=True):
        new = target().not_delivered(dl.dedupe_batch(frame), CATALOG, run_, batch_id).persist()
        target().write(new, CATALOG, run_, batch_id)
        if ended:
            target().after_write(new, CATALOG, run_, batch_id)
        return sorted(r.event_id for r in new.collect())

    assert batch(one, "r", 0) == ["e-1-10", "e-2-10"]
    assert batch(two, "r", 1, ended=False) == ["e-3-10", "e-4-10"]  # stopped before its ids were written
    assert batch(two, "r", 1, ended=False) == ["e-3-10", "e-4-10"]  # the replay writes the same again
    assert batch(one.unionByName(two), "s", 0) == []  # another query with a new checkpoint
    assert target().ledger.marks(spark) == {"r": 1, "s": 0}
    assert target().read(spark, CATALOG).count() == 4
    # data from before the index is taken in as a whole
    from tidegate.plans.staging import drop_shared
    drop_shared(spark, f"{tmp_path}/out/_ledger")
    assert batch(one.unionByName(changes(spark, (9, 9, 9))), "t", 0) == ["e-9-9"]
    assert target().ledger.marks(spark).items() >= {"r": 1, "t": 0}.items()


def test_redelivery_through_streams(spark, tmp_path):
    first = changes(spark, (1, 5, 10), (2, 5, 10), (1, 6, 20))
    first.write.parquet(str(tmp_path / "in"))
    config = DestinationConfig("log", "json_log", options={"root": str(tmp_path / "out"), "ledger_buckets": 4})
    frame = lambda: spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):
        run(lambda: sp.start_delivery(frame(), config, CATALOG, str(tmp_path / checkpoint), availableNow=True))
    assert sp.build_destination(config).read(spark, CATALOG).count() == 3


def state_of(tmp_path, buckets=8):
    return sp.build_destination(DestinationConfig("s", "current_buckets", options={"path": str(tmp_path / "state"), "buckets": buckets}))


def test_a_state_of_ten_batches_is_read_without_a_shuffle(spark, tmp_path):
    target, every = state_of(tmp_path), []
    for b in range(10):
        records = [(k, 10 * b + k, 100 * ((b * 7) % 10) + k, "d" if (k + b) % 5 == 0 else "u") for k in range(b, b + 12)]
        every += records
        target.write(changes(spark, *records), CATALOG, "r", b)
    state = target.read(spark, with_deleted=True)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert quantities(state) == quantities(dl.latest_per_key(changes(spark, *every)))
    assert {r.key for r in target.read(spark).collect()} == {r.key for r in dl.current_view(state).collect()}
    assert state.groupBy("table_ref", "key").count().where("count > 1").isEmpty()


def test_a_stop_while_buckets_are_put_in_place(spark, tmp_path):
    target = state_of(tmp_path, buckets=2)
    assert target.read(spark) is None
    target.write(changes(spark, (1, 1, 10), (2, 1, 10), (3, 1, 10)), CATALOG, "r", 0)
    want = {1: (1, "u"), 2: (7, "u"), 3: (1, "u"), 4: (7, "u")}
    late = changes(spark, (2, 7, 20), (4, 7, 20), (3, 0, 5))
    # the pending copy is there, a bucket of the state is gone
    recover, target.recover = target.recover, lambda spark: None
    target.write(late, CATALOG, "r", 1)
    from tidegate.plans.staging import drop_shared
    drop_shared(spark, children(spark, f"{tmp_path}/state/pending/run=r/batch=1/bucket=*")[0].replace("/pending/run=r/batch=1", "/state"))
    target.recover = recover
    target.write(late, CATALOG, "r", 1)
    assert quantities(target.read(spark, with_deleted=True)) == want
    # what was not written to its end is not put in place
    late.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/state/pending/run=x/batch=0")
    drop_shared(spark, f"{tmp_path}/state/pending/run=x/batch=0/_SUCCESS")
    target.recover(spark)
    assert quantities(target.read(spark, with_deleted=True)) == want and children(spark, f"{tmp_path}/state/pending/run=*/batch=*") == []
    target.write(changes(spark).limit(0), CATALOG, "r", 2)
    assert quantities(target.read(spark, with_deleted=True)) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    target = state_of(tmp_path, buckets=16)
    target.write(changes(spark, *[(k, k, 10) for k in range(60)]), CATALOG, "r", 0)
    before = set(children(spark, f"{tmp_path}/state/state/bucket=*/part-*"))
    target.write(changes(spark, (3, 99, 20)), CATALOG, "r", 1)
    assert len(before - set(children(spark, f"{tmp_path}/state/state/bucket=*/part-*"))) == 1


def test_bucketed_state_through_a_stream(spark, tmp_path):
    config = DestinationConfig("s", "current_buckets", options={"path": str(tmp_path / "out")})
    deliver(spark, tmp_path, changes(spark, (1, 5, 10), (2, 5, 10), (1, 6, 20)), config, "c")
    assert quantities(sp.build_destination(config).read(spark)) == {1: (6, "u"), 2: (5, "u")}
    assert REF in {r.table_ref for r in sp.build_destination(config).read(spark).collect()}
