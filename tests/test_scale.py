"""Work is spread by rows, whatever the bytes and row groups of a file and however few drift shapes there are."""

import contextlib
import io

from pyspark.sql import functions as F

from tests.helpers import ON_HAND, envelope, log
from tidegate.operators import proposals as pr
from tidegate.operators import repair as rp
from tidegate.operators.checks import load_problems
from tidegate.operators.drift import contract_errors
from tidegate.operators.routing import route_changes, to_dlq
from tidegate.functions import jsonvalue as jv
from tidegate.plans import feed, queries
from tidegate.plans.staging import spread, staged
from tidegate.sources.catalog import Catalog

CATALOG = Catalog.default()
RENAMED = {"product_id": ON_HAND["product_id"], "stock_quantity": ("int32", "INT", False)}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_row_group_is_dealt_out_by_rows(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10_000).withColumn("n", F.when(F.col("id") % 2 == 0, F.col("id"))).coalesce(1).write.parquet(path)
    rows = spread(spark.read.parquet(path), 1_000)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1_100 and sum(sizes) == 10_000
    assert spread(spark.read.parquet(path).where("id < 0"), 1_000).count() == 0


def test_rows_of_one_drift_shape_are_not_gathered(spark):
    changes = [envelope("products_on_hand", {"product_id": i, "stock_quantity": i}, op="c", columns=RENAMED, pos=i) for i in range(40)]
    dlq = staged(to_dlq(route_changes(log(spark, changes), CATALOG)), "dlq")
    decided = rp.repair(rp.pending_dlq(dlq), pr.propose_from_report(pr.repair_requests(dlq), CATALOG), CATALOG)
    assert "hashpartitioning(fingerprint" not in plan(decided)
    assert [r.status for r in decided.select("status").distinct().collect()] == ["REPAIRED"]
    assert {r.a for r in decided.select(F.col("chosen.proposal.attempt").alias("a")).collect()} == {1}


def test_absent_fields_have_neither_type_errors_nor_values(spark):
    fields = CATALOG.contracts_df(spark).where("contract_key = 'inventory.inventory.products_on_hand'")
    row = fields.withColumn("image", jv.image_of_text(F.lit('{"product_id":"x"}')))
    found = row.select(
        contract_errors(F.col("image"), F.col("fields"), F.col("field_names"), F.col("required"), F.col("allows_additional")).alias("e"),
        load_problems(F.col("image"), F.col("fields"), F.array().cast(f"array<{pr.ACTION}>"), CATALOG.matrix).alias("p")).first()
    assert found.e == ["$: 'quantity' is a required property", "$.product_id: 'x' is not of type 'integer'"]
    assert found.p == ["incorrect integer value for column 'product_id'", "column 'quantity' cannot be null"]


def test_the_feed_of_one_row_group_is_several_tasks(spark, tmp_path):
    text = F.lit("x")
    parts = spark.range(feed.MESSAGES_PER_TASK * 2 + 40).select(
        F.when(F.col("id") > 5, F.col("id")).alias("p_partkey"), text.alias("p_name"), text.alias("p_brand"), text.alias("p_type"),
        F.lit(1).alias("p_size"), F.lit(1.5).alias("p_retailprice"))
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = feed.part_feed(spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == feed.MESSAGES_PER_TASK * 2 + 40
    assert found.select("offset").distinct().count() == sum(sizes) - 5


def test_an_attempt_that_repeats_another_is_not_checked_again(spark):
    one = {"fingerprint": "f", "contract_key": "inventory.inventory.products_on_hand", "classification": "REMOVED_COLUMN", "confidence": 0.5,
           "reasoning_summary": "", "actions": [], "test_cases": [], "risk_level": "LOW", "model": ""}
    mappings = [{"quantity": "a"}, {"quantity": "a"}, {"quantity": "b"}]
    tried = spark.createDataFrame([{**one, "attempt": i + 1, "mapping": m} for i, m in enumerate(mappings)], pr.PROPOSAL_SCHEMA)
    assert rp.prepare_attempts(tried, CATALOG).first().repeats == [False, True, False]


def test_a_repeated_attempt_is_decided_as_the_first_was(spark):
    changes = [envelope("products_on_hand", {"product_id": 7, "stock_quantity": 7}, op="c", columns=RENAMED, pos=1)]
    dlq = staged(to_dlq(route_changes(log(spark, changes), CATALOG)), "dlq")
    found = staged(pr.propose_from_report(pr.repair_requests(dlq), CATALOG), "found")
    lost = F.when(F.col("attempt") < 3, F.create_map(F.lit("product_id"), F.lit("product_id"))).otherwise(F.col("mapping"))
    last = rp.repair(rp.pending_dlq(dlq), found.withColumn("mapping", lost), CATALOG)
    again = rp.repair(rp.pending_dlq(dlq), found.withColumn("mapping", lost).where("attempt < 3"), CATALOG)
    get = lambda d: d.select("status", "chosen.proposal.attempt", F.size("chosen.output").alias("n"),
                             F.filter("chosen.checks", lambda c: ~c["passed"])["name"].alias("failed")).first()
    assert tuple(get(last)) == ("REPAIRED", 3, 2, [])
    assert tuple(get(again)) == ("RETRY_AI", 2, 1, ["schema_validation", "required_fields"])


def test_routes_are_stored_once_without_the_message(spark):
    sf = "/root/testdata/sf0.001"
    routes = queries.stored_routes(spark, sf)
    assert queries.stored_routes(spark, sf) is routes and "value" not in routes.columns
    assert {f.split("/")[-2].split("-")[0] for f in routes.inputFiles()} == {"routes"}
    assert routes.where("contract_key IS NOT NULL AND has_contract AND fields IS NULL").isEmpty()
