"""The log whose batches become visible whole, and typed tables over versions of a contract."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tests.test_delivery import CATALOG, changes
from tidegate.operators import delivery as dl
from tidegate.sources import committed
from tidegate.sources.catalog import Catalog
from tidegate.sources.destinations import DestinationConfig
from tidegate.streaming import pipelines as sp


def numbers(spark, path):
    rows = committed.read_log(spark, path)
    return [] if rows is None else sorted((r.id, r.run, r.batch) for r in rows.collect())


def data_files(path):
    return sorted(f.name for f in (path / "data").glob("*.parquet"))


def failing_at(frame, bad, after=3):
    """The frame; the task that meets an id fails when the others have long ended."""
    def tasks(batches):
        for batch in batches:
            if bad in batch.column("id").to_pylist():
                time.sleep(after)
                raise ValueError("this row fails")
            yield batch

    return frame.mapInArrow(tasks, "id bigint")


def test_a_committed_batch_is_final(spark, tmp_path):
    path = str(tmp_path / "log")
    assert numbers(spark, path) == []
    committed.append(spark.range(4).repartition(3), path, "a", 0)
    held = data_files(tmp_path / "log")
    committed.append(spark.range(9), path, "a", 0)
    assert numbers(spark, path) == [(i, "a", 0) for i in range(4)]
    assert data_files(tmp_path / "log") == held  # the files of the second time are gone
    committed.append(spark.range(0), path, "a", 1)
    committed.append(spark.range(7, 8), f"file:{path}", "b", 0)
    assert numbers(spark, path) == [(i, "a", 0) for i in range(4)] + [(7, "b", 0)]
    assert committed.manifests(spark, path).agg(F.sum("n_rows")).first()[0] == 5
    assert committed.sweep(spark, path) == 0


def test_columns_of_all_batches(spark, tmp_path):
    path = str(tmp_path)
    committed.append(spark.range(1), path, "a", 0)
    committed.append(spark.range(1, 2).withColumn("more", F.lit("x")), path, "a", 1)
    assert sorted((r.id, r.more) for r in committed.read_log(spark, path).collect()) == [(0, None), (1, "x")]
    pruned = committed.read_log(spark, path, "id bigint, more string").where("id = 1").select("more")
    assert [r.more for r in pruned.collect()] == ["x"]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,1)" in plan


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(Exception, match="this row fails"):
        committed.append(failing_at(spark.range(0, 4_000, 1, 4), 3_999), path, "a", 0)
    assert numbers(spark, path) == [] and data_files(tmp_path / "log") == []
    committed.append(spark.range(2), path, "a", 0)
    (tmp_path / "log" / "data" / "lost.parquet").write_bytes(b"half a file of a lost executor")
    assert [n for n, *_ in numbers(spark, path)] == [0, 1]
    assert committed.sweep(spark, path) == 1 and [n for n, *_ in numbers(spark, path)] == [0, 1]


def test_a_stream_fails_and_goes_on(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    spark.range(0, 50, 1, 4).write.parquet(source)
    spark.dataSource.register(committed.LogSource)

    def run(bad):
        rows = failing_at(spark.readStream.schema("id bigint").parquet(source), bad)
        rows.writeStream.format(committed.FORMAT).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start(path).awaitTermination()

    with pytest.raises(Exception):
        run(33)
    assert numbers(spark, path) == [] and data_files(tmp_path / "log") == []
    run(-1)
    own = sp.query_id(spark, checkpoint)
    assert numbers(spark, path) == [(i, own, 0) for i in range(50)]
    spark.range(50, 60).write.mode("append").parquet(source)
    run(-1)
    assert numbers(spark, path)[50:] == [(i, own, 1) for i in range(50, 60)]


def test_what_a_log_refuses(spark, tmp_path):
    with pytest.raises(Exception, match="run"):
        committed.append(spark.range(1).withColumn("run", F.lit(1)), str(tmp_path), "a", 0)
    with pytest.raises(Exception, match="letters"):
        committed.append(spark.range(1), str(tmp_path), "a/b", 0)
    with pytest.raises(Exception, match="appended"):
        spark.range(1).write.format(committed.FORMAT).mode("overwrite").options(run="a", batch=0).save(str(tmp_path))
    assert numbers(spark, str(tmp_path)) == []


def test_committed_log_as_a_destination(spark, tmp_path):
    target = lambda: sp.build_destination(DestinationConfig("d", "committed_log", options={"root": str(tmp_path)}))

    def batch(frame, run, batch_id, ended=True):
        new = target().not_delivered(dl.dedupe_batch(frame), CATALOG, run, batch_id).persist()
        target().write(new, CATALOG, run, batch_id)
        if ended:
            target().after_write(new, CATALOG, run, batch_id)
        return sorted(r.event_id for r in new.collect())

    assert batch(changes(spark, (1, 1, 1)).limit(0), "r", 0, ended=False) == []
    assert batch(changes(spark, (1, 1, 1), (2, 1, 1)), "r", 1, ended=False) == ["e-1-1", "e-2-1"]
    assert batch(changes(spark, (1, 1, 1), (3, 1, 1)), "s", 0) == ["e-3-1"]  # ids of the stopped batch are taken from its data
    assert batch(changes(spark, (1, 1, 1), (2, 1, 1)), "r", 1) == ["e-1-1", "e-2-1"]
    stored = target().read(spark)
    assert sorted((r.event_id, r.run, r.batch) for r in stored.collect()) == [("e-1-1", "r", 1), ("e-2-1", "r", 1), ("e-3-1", "s", 0)]
    assert json.loads(stored.where("event_id = 'e-2-1'").first().payload) == {"product_id": 2, "quantity": 1}
    assert sp.read_destinations(spark, [target()], CATALOG).count() == 3


REF = "app.shop.readings"


def version(kind, **more):
    fields = {"product_id": {"type": "integer"}, "quantity": {"type": kind}} | {n: {"type": k} for n, k in more.items()}
    return Catalog.from_documents({"sources": {"app": {"engine": "mysql", "database": "shop", "tables": [
        {"name": "readings", "primary_key": ["product_id"], "contract": "d"}]}}}, {"d": {"type": "object", "properties": fields}})


def test_versions_of_a_contract_are_read_whole(spark, tmp_path):
    target = sp.TableLog("lake", {"root": str(tmp_path)})
    large = 2 ** 53 + 1
    target.write(changes(spark, (1, large, 1), ref=REF), version("integer"), "r", 0)
    target.write(changes(spark, (2, 2.5, 1), ref=REF), version("number"), "r", 1)
    rows = target.read_table(spark, version("number").contracts[REF])
    assert dict(rows.dtypes)["quantity"] == "double"
    assert sorted((r.product_id, r.quantity) for r in rows.collect()) == [(1, float(large)), (2, 2.5)]
    last = version("string", note="string")
    target.write(changes(spark, (3, "many", 1), ref=REF), last, "r", 2)
    rows = target.read_table(spark, last.contracts[REF])
    assert sorted((r.product_id, r.quantity, r.note) for r in rows.collect()) == [(1, str(large), None), (2, "2.5", None), (3, "many", None)]
    # the change records keep the stored values
    payloads = {json.loads(r.key)["product_id"]: json.loads(r.payload) for r in target.read(spark, last).collect()}
    assert payloads[1] == {"product_id": 1, "quantity": large, "note": None} and payloads[2]["quantity"] == 2.5
    # an older contract reads later rows, too: what it lacks is kept
    assert dict(target.read_table(spark, version("integer").contracts[REF]).dtypes)["note"] == "string"
    assert target.read_table(spark, CATALOG.contracts["inventory.inventory.products"]) is None


def test_a_contract_that_changes_before_a_replay(spark, tmp_path):
    target = sp.TableLog("lake", {"root": str(tmp_path)})
    batch = changes(spark, (1, 1, 1), (2, 2, 1), ref=REF)
    target.write(batch, version("integer"), "r", 0)
    target.write(batch, version("string"), "r", 0)
    rows = target.read_table(spark, version("string").contracts[REF])
    assert sorted((r.product_id, r.quantity) for r in rows.collect()) == [(1, "1"), (2, "2")]


def test_tables_from_before_versions(spark, tmp_path):
    target, contract = sp.TableLog("lake", {"root": str(tmp_path)}), version("integer").contracts[REF]
    folder = f"{tmp_path}/table={dl.table_folder(*REF.split('.', 2))}/run=old/batch=0"
    dl.append_changelog_table(changes(spark, (1, 1, 1), ref=REF), contract, folder, "overwrite")
    again = changes(spark, (1, 1, 1), (2, 2, 1), ref=REF)
    new = target.not_delivered(again, version("integer"), "r", 0).persist()
    target.write(new, version("integer"), "r", 0)
    target.after_write(new, version("integer"), "r", 0)
    assert sorted(r.product_id for r in target.read_table(spark, contract).collect()) == [1, 2]
    assert sorted((r.run, r._event_id) for r in target._stored_ids(spark).collect()) == [("old", "e-1-1"), ("r", "e-2-1")]
