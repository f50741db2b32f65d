"""Renames from a stored table of drift shapes."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import ON_HAND, envelope, log
from tidegate.functions.names import RenameHints
from tidegate.operators.routing import route_changes, to_dlq
from tidegate.plans.staging import staged
from tidegate.sources.catalog import Catalog
from tidegate.streaming import shapes as sh

CATALOG = Catalog.default()
WIDTHS = {"stock_quantity": "INT", "qty_on_hand": "INT", "zzz": "VARCHAR(9)", "quantity": "BIGINT"}


@pytest.fixture(scope="module")
def routed(spark):
    """Rows of three shapes with renames, one retyped, one broken."""
    values = []
    for i, name in enumerate([*WIDTHS, "stock_quantity", "stock_quantity"]):
        columns = {"product_id": ON_HAND["product_id"], name: ("string" if name == "zzz" else "int32", WIDTHS[name], False)}
        values.append(envelope("products_on_hand", {"product_id": i, name: "x" if name == "zzz" else i}, columns=columns, pos=i))
    return staged(route_changes(log(spark, [*values, b"{broken"], [{"product_id": i} for i in range(len(values) + 1)]), CATALOG), "routed")


def plain(df):
    return sorted((r.offset, r.reason, None if r.drift_report is None else (
        r.drift_report.fingerprint, r.drift_report.drift_type, [tuple(x) for x in r.drift_report.possible_renames])) for r in df.collect())


def test_the_table_gives_what_scoring_gives_and_grows_by_unseen_shapes(spark, tmp_path, routed, monkeypatch):
    shapes = sh.ShapeDictionary(str(tmp_path))
    want = plain(to_dlq(routed))
    some = routed.where(F.col("offset").isin(0, 6))
    assert plain(to_dlq(some, meet=shapes.meet)) == [w for w in want if w[0] in (0, 6)]
    assert shapes.known(spark).count() == 1
    assert plain(to_dlq(routed, meet=shapes.meet)) == want and shapes.known(spark).count() == 3
    files = shapes.known(spark).inputFiles()

    def no_scoring(*_):
        raise AssertionError("known shapes are not scored")

    monkeypatch.setattr("tidegate.operators.drift.rename_candidates", no_scoring)
    again = to_dlq(routed, meet=shapes.meet)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    assert plain(again) == want and shapes.known(spark).inputFiles() == files
    # a shape that a replay added twice is met once
    shapes.known(spark).write.mode("append").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(shapes.path)
    assert plain(to_dlq(routed, meet=shapes.meet)) == want


def test_no_shapes_and_other_rules(spark, tmp_path, routed):
    shapes = sh.ShapeDictionary(str(tmp_path))
    broken = routed.where("outcome = 'dlq:MALFORMED_JSON'")
    assert len(plain(to_dlq(broken, meet=shapes.meet))) == 1 and shapes.known(spark) is None
    assert to_dlq(routed.limit(0), meet=shapes.meet).count() == 0
    assert sh.ShapeDictionary(str(tmp_path), hints=RenameHints(decorators=["a"])).path != shapes.path
    assert sh.ShapeDictionary(str(tmp_path), hints=RenameHints()).path == shapes.path
