"""Drift: comparison with contracts, renames, classification, type verdicts, names."""

import difflib
import hashlib
import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import LAMP, ON_HAND, PRODUCTS, columns_of, envelope, log
from tidegate.functions.names import RenameHints, lexical, similarity_ratios, tokens
from tidegate.functions.numbers import round_exact
from tidegate.functions.sqltypes import TypeMatrix
from tidegate.operators.drift import fit_narrower_types
from tidegate.operators.routing import route_changes, to_dlq, to_validated, with_reports
from tidegate.sources.catalog import Catalog

# Tables of our own: columns, and what a contract says of them.
BERTHS = columns_of("berth_no int32 INT; ship_name string VARCHAR(40); draught double DOUBLE?; amount int32 INT")


def contract(name, columns, **more):
    json_kind = {"int32": "integer", "int64": "integer", "string": "string", "double": "number", "boolean": "boolean"}
    properties = {}
    for column, (kind, sql, optional) in columns.items():
        types = [json_kind[kind], "null"] if optional else json_kind[kind]
        properties[column] = {"type": types, "x-sql-type": sql, "x-connect-type": kind, "x-nullable": optional}
        if sql.startswith("VARCHAR("):
            properties[column]["maxLength"] = int(sql[8:-1])
    return {"$id": f"urn:{name}", "type": "object", "properties": properties, "required": list(columns), "additionalProperties": False} | more


def harbour(columns=BERTHS):
    table = {"name": "berths", "primary_key": ["berth_no"], "contract": "b"}
    return Catalog.from_documents({"sources": {"port": {"engine": "mysql", "database": "harbour", "topic_prefix": "cdc", "tables": [table]}}},
                                  {"b": contract("berths", columns)})


ROW = {"berth_no": 4, "ship_name": "Alma", "draught": 3.5, "amount": 2}


def berth(row, columns=BERTHS, **more):
    return envelope("berths", row, columns=columns, db="harbour", **more)


def without(mapping, *names):
    return {k: v for k, v in mapping.items() if k not in names}


def reports(spark, values, catalog=None, **settings):
    return with_reports(route_changes(log(spark, values), catalog or harbour(), **settings)).orderBy("offset").collect()


def test_added_removed_and_plain_rows(spark):
    same, more, less, both = reports(spark, [
        berth(ROW), berth(ROW | {"flag": "NO"}, BERTHS | columns_of("flag string CHAR(2)?")),
        berth(without(ROW, "draught"), without(BERTHS, "draught")),
        berth(without(ROW, "draught") | {"qqq": True}, without(BERTHS, "draught") | columns_of("qqq boolean BOOLEAN"))])
    assert same.outcome == "validated" and not same.drift_detected and same.drift_type == "NONE"
    assert (more.drift_type, more.unexpected_fields, more.ambiguous) == ("ADDED_COLUMN", ["flag"], False)
    assert (less.drift_type, less.missing_fields, less.ambiguous) == ("REMOVED_COLUMN", ["draught"], False)
    assert both.drift_type == "MULTIPLE_CHANGES" and both.ambiguous and both.confidence <= 0.5


def renamed(*new, kind="int32 INT", value=2):
    columns = without(BERTHS, "amount")
    for name in new:
        columns |= columns_of(f"{name} {kind}")
    return berth(without(ROW, "amount") | dict.fromkeys(new, value), columns)


def test_renames_and_rivals(spark):
    clear, retyped, rivals = reports(spark, [renamed("total_amount"), renamed("total_amount", kind="string VARCHAR(9)", value="2"),
                                             renamed("new_amount", "old_amount")])
    (pair,) = clear.possible_renames
    assert (pair.missing_field, pair.unexpected_field, pair.ambiguous) == ("amount", "total_amount", False)
    assert clear.drift_type == "RENAMED_COLUMN" and pair.confidence > 0.8
    assert all(p.confidence < pair.confidence for p in retyped.possible_renames)
    assert rivals.ambiguous and all(p.ambiguous for p in rivals.possible_renames)


def test_a_stock_rename_has_the_published_confidence(spark):
    """0.956 for quantity and stock_quantity of equal type."""
    columns = without(ON_HAND, "quantity") | columns_of("stock_quantity int32 INT")
    row = reports(spark, [envelope("products_on_hand", {"product_id": 1, "stock_quantity": 3}, columns=columns)], Catalog.default())[0]
    assert [p.confidence for p in row.possible_renames] == [0.956]


def test_levels_of_types_and_nulls(spark):
    wide = BERTHS | columns_of("amount int64 BIGINT")
    only_kind = {n: (k, None, o) for n, (k, _, o) in (BERTHS | columns_of("amount int64 X")).items()}
    rows = reports(spark, [
        berth(ROW, wide), berth(ROW, only_kind), berth(ROW | {"amount": "two"}, None), berth(ROW | {"amount": 2.5}, None),
        berth(ROW, BERTHS | columns_of("ship_name string VARCHAR(40)?")), berth(ROW | {"ship_name": None}),
        berth(ROW | {"draught": None}), berth(ROW | {"ship_name": "x" * 41})])
    assert [[(t.field, t.level, t.compatibility) for t in r.type_mismatches] for r in rows] == [
        [("amount", "sql", "compatible")], [("amount", "connect", "compatible")], [("amount", "json", "risky")],
        [("amount", "json", "risky")], [], [], [], []]
    assert [[(n.field, n.level) for n in r.nullability_changes] for r in rows] == [
        [], [], [], [], [("ship_name", "schema")], [("ship_name", "value")], [], []]
    assert [r.drift_type for r in rows] == ["TYPE_CHANGE"] * 4 + ["NULLABILITY_CHANGE"] * 2 + ["NONE", "UNKNOWN"]
    assert rows[-1].confidence == 0.5 and rows[-1].validation_errors[0].endswith("is too long")


def test_fingerprint_is_the_shape(spark):
    one, other, plain = reports(spark, [renamed("total_amount", value=1), renamed("total_amount", value=9), berth(ROW)])
    known = harbour().contracts["port.harbour.berths"]
    material = {"contract": known.key, "contract_version": known.version, "missing": ["amount"], "unexpected": ["total_amount"],
                "types": [], "nullability": []}
    assert one.fingerprint == hashlib.sha256(json.dumps(material, sort_keys=True).encode()).hexdigest()[:24]
    assert one.fingerprint == other.fingerprint != plain.fingerprint


def test_every_message_has_one_outcome(spark):
    wide = berth(ROW, BERTHS | columns_of("amount int64 BIGINT"))
    values = {"dlq:MALFORMED_JSON": b"%", "dlq:MALFORMED_ENVELOPE": {"op": "c"}, "dlq:UNKNOWN_SCHEMA": envelope("elsewhere", {"a": 1}),
              "skipped:tombstone": None, "validated:control": envelope("berths", None, op="t"), "validated": berth(ROW),
              "dlq:SCHEMA_DRIFT": wide}
    routed = route_changes(log(spark, list(values.values())), harbour())
    assert [r.outcome for r in routed.orderBy("offset").collect()] == list(values)
    assert to_validated(routed).count() + to_dlq(routed).count() + 1 == len(values)
    loose = reports(spark, [wide], compatible_type_change_routing="validated")[0]
    assert loose.outcome == "validated:compatible_widening"
    with pytest.raises(ValueError):
        route_changes(log(spark, [wide]), harbour(), compatible_type_change_routing="drop")


def test_clean_rows_need_no_python_and_wide_renames_end(spark):
    routed = route_changes(log(spark, [berth(ROW)]), harbour())
    assert "Python" not in (plan := to_validated(routed)._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan
    old = columns_of(";".join(f"col_{i} int32 INT" for i in range(300)))
    new = columns_of(";".join(f"new_col_{i} int32 INT" for i in range(300)))
    value = berth(dict.fromkeys(new, 1), new)
    start = time.time()
    rows = to_dlq(route_changes(log(spark, [value] * 40), harbour(old))).collect()
    assert len(rows) == 40 and len(rows[0].drift_report.possible_renames) == 300 and time.time() - start < 120


def test_contract_is_found_by_database_only_when_one_source_has_it(spark):
    row = envelope("products", LAMP, columns=PRODUCTS, name="unknown_prefix")
    assert reports(spark, [row], Catalog.default())[0].outcome == "validated"
    doc = Catalog.default().contracts["inventory.inventory.products"].document
    table = {"name": "products", "primary_key": ["id"], "contract": "p"}
    two = Catalog.from_documents({"sources": {
        n: {"engine": "mysql", "database": "inventory", "topic_prefix": n, "tables": [table]} for n in ("a", "b")}},
        {"p": doc})
    assert route_changes(log(spark, [row]), two).first().outcome == "dlq:UNKNOWN_SCHEMA"
    named = envelope("products", LAMP, columns=PRODUCTS, name="b")
    assert route_changes(log(spark, [named]), two).first().contract_key == "b.inventory.products"


def test_type_verdicts(spark):
    """Integers by width, texts by length, and the pairs that a matrix names."""
    whole = ["INT", "BIGINT"]
    cases = [(a, b, "identical" if i == j else "compatible" if i < j else "destructive")
             for (i, a), (j, b) in itertools.product(enumerate(whole), repeat=2)]
    cases += [(f"{t}({a})", f"{t}({b})", "identical" if a == b else "compatible" if a < b else "destructive")
              for t in ("VARCHAR", "CHAR") for a in (3, 60) for b in (3, 60)]
    cases += [("INTEGER", "int", "identical"), ("INT", "INT(9)", "identical"), ("INT", "INT UNSIGNED", "risky"), ("POLYGON", "INT", "risky")]
    frame = spark.createDataFrame(cases, "expected string, actual string, verdict string")
    got = frame.select("expected", "actual", TypeMatrix().verdict(F.col("expected"), F.col("actual"))).collect()
    assert [tuple(r) for r in got] == cases
    own = TypeMatrix(rules={("INT", "BIGINT"): "risky"}, default="destructive")
    pick = frame.limit(1).select(own.verdict(F.lit("INT"), F.lit("BIGINT")), own.verdict(F.lit("INT"), F.lit("TEXT")))
    assert tuple(pick.first()) == ("risky", "destructive")
    wire = frame.limit(1).select(*[TypeMatrix().connect_verdict(F.lit(a), F.lit(b)) for a, b in (
        ("int16", "int64"), ("int64", "int32"), ("string", "string"), ("bytes", "int32"))])
    assert tuple(wire.first()) == ("compatible", "destructive", "identical", "risky")


def test_names(spark):
    pairs = [("quantity", "stock_quantity"), ("name", "title"), ("unitPrice", "unit_price_new"), ("a", "zzz"),
             ("first_name", "last_name")]
    frame = spark.createDataFrame(pairs, "m string, u string").withColumn(
        "ratio", similarity_ratios(F.array("m"), F.array("u"))[0])
    hints = RenameHints()
    got = frame.select("ratio", lexical(F.col("m"), F.col("u"), F.col("ratio"), tokens(F.col("m")),
                                        tokens(F.col("u")), hints)["score"].alias("score")).collect()
    ratios = [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in pairs]
    assert [r.ratio for r in got] == ratios
    assert [r.score for r in got] == [0.92, 0.92, 0.9, ratios[3], max(ratios[4], 0.8 / 3)]


def test_rounding_equals_python(spark):
    values = [0.8775, 0.8125, 0.8545, 0.0005, 0.0015, 0.9555, 1.0, 0.0] + [
        0.55 * a / 97 + 0.3 * b / 10 + 0.1125 for a in range(97) for b in (2, 9)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in frame.select(round_exact(F.col("x"), 3)).collect()] == [round(v, 3) for v in values]


def test_narrower_types_in_one_pass(spark):
    frame = spark.createDataFrame([(-129, 5), (5, None)], "n bigint, m bigint")
    kinds = ["TINYINT", "SMALLINT", "JSON"]
    got = {(r.column_name, r.sql_type): r.fits for r in fit_narrower_types(frame, {"n": kinds, "m": kinds}).collect()}
    assert got == {("n", "TINYINT"): False, ("n", "SMALLINT"): True, ("n", "JSON"): True} | {("m", k): True for k in kinds}
    assert all(r.fits for r in fit_narrower_types(frame.filter("n > 9"), {"n": kinds}).collect())
