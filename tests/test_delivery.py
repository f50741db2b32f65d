import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.helpers import ON_HAND, PRODUCTS, LAMP, envelope, log
from tidegate.operators import clean, delivery as dl, observe, proposals, repair
from tidegate.operators.routing import route_changes, to_dlq, to_validated, with_reports
from tidegate.sources import catalog as cat
from tidegate.sources.catalog import Catalog, ContractError
from tidegate.sources.changelog import LOG_SCHEMA, read_change_log
from tidegate.sources.destinations import (
    DestinationConfig, DestinationError, load_destinations)
from tidegate.streaming import pipelines as sp

CATALOG = Catalog.default()
REF = "inventory.inventory.products_on_hand"
CHANGE = ("event_id string, source string, database string, table string, table_ref string, op string, key string, "
          "payload string, sequence decimal(38,0), origin string, repair_id string, correlation_id string, "
          "contract_id string, source_ts_ms bigint, topic string, partition int, offset bigint")


def changes(spark, *records, ref=REF):
    rows = []
    for i, (pid, quantity, seq, *rest) in enumerate(records):
        op, origin = (rest + ["u", "validated"][len(rest):])[:2]
        source, database, table = ref.split(".")
        rows.append((f"e-{pid}-{seq}", source, database, table, ref, op, json.dumps({"product_id": pid}),
                     json.dumps({"product_id": pid, "quantity": quantity}), seq, origin, None, "c", "", 1, "t", 0, i))
    from decimal import Decimal
    return spark.createDataFrame([r[:8] + (Decimal(r[8]),) + r[9:] for r in rows], CHANGE)


def quantities(state):
    return {json.loads(r.key)["product_id"]: (json.loads(r.payload)["quantity"], r.op) for r in state.collect()}


def test_last_writer_wins_and_tombstones(spark):
    state = changes(spark, (1, 10, 200, "u", "repaired"))
    state = dl.upsert_current(state, changes(spark, (1, 5, 100)))
    assert quantities(state) == {1: (10, "u")}
    state = dl.upsert_current(state, changes(spark, (1, 10, 300, "d")))
    state = dl.upsert_current(state, changes(spark, (1, 99, 250)))
    assert quantities(state) == {1: (10, "d")} and dl.current_view(state).count() == 0
    assert dl.row_counts(state).first().live_rows == 0
    # an equal sequence that comes later wins
    assert quantities(dl.upsert_current(state, changes(spark, (1, 7, 300)))) == {1: (7, "u")}


def test_state_does_not_depend_on_the_order_of_batches(spark):
    records = [(k, v, 100 * v + k, random.Random(v).choice("ud")) for k in range(6) for v in range(5)]
    want = quantities(dl.latest_per_key(changes(spark, *records)))
    for seed in range(2):
        random.Random(seed).shuffle(records)
        state = dl.latest_per_key(changes(spark, *records[:10]))
        for part in (records[10:20], records[20:], records[5:15]):
            state = dl.upsert_current(state, changes(spark, *part))
        assert quantities(state) == want


def test_sequences(spark):
    metas = [{"file": "bin.000003", "pos": "900", "row": "0"}, {"file": "bin.000003", "pos": "1200"},
             {"file": "bin.000004", "pos": "4"}, {"file": "bin.999999", "pos": "999999999999"}, {"lsn": "77"},
             {"ts_ms": "5"}, {}]
    frame = spark.createDataFrame([(m, 9) for m in metas], "meta map<string,string>, ts bigint")
    got = [int(r[0]) for r in frame.select(dl.source_sequence(F.col("meta"), F.col("ts"))).collect()]
    assert got == [3 * 10**15 + 900_000, 3 * 10**15 + 1_200_000, 4 * 10**15 + 4000,
                   999999 * 10**15 + 999999999999000, 77, 5000, 9000]


def test_changes_from_both_topics(spark):
    routed = route_changes(log(spark, [
        envelope("products", LAMP, columns=PRODUCTS, pos=10), envelope("products", None, op="t"),
        envelope("products_on_hand", {"product_id": 5, "quantity": 2}, columns=ON_HAND, pos=20)],
        [{"id": 101}, None, None]), CATALOG)
    validated = to_validated(routed)
    repaired = validated.filter("offset = 0").select(
        F.lit("other").alias("event_id"), F.lit("r1").alias("repair_id"), *validated.columns[1:]).drop("schema_notice")
    got = {r.event_id: r for r in dl.to_changes(validated, repaired, CATALOG).collect()}
    assert len(got) == 3 and got["other"].origin == "repaired" and got["other"].repair_id == "r1"
    by_table = {r.table: r for r in got.values() if r.origin == "validated"}
    assert by_table["products"].table_ref == "inventory.inventory.products"
    assert by_table["products_on_hand"].key == '{"product_id":5}'  # no message key: taken by contract
    unlisted = validated.withColumns({"source_table": F.lit("unknown"), "key": F.lit(None).cast("string")})
    assert dl.unkeyed(unlisted, repaired.limit(0), CATALOG).count() == 2


def test_dedupe_ledger_and_routing(spark):
    c = changes(spark, (1, 1, 1), (2, 2, 2))
    twice = c.unionByName(c.withColumn("offset", F.col("offset") + 100))
    once = dl.dedupe_batch(twice)
    assert once.count() == 2 and once.agg(F.max("offset")).first()[0] == 1
    held = spark.createDataFrame([("e-1-1",)], "_event_id string")
    assert [r.event_id for r in dl.drop_delivered(once, held).collect()] == ["e-2-2"]
    crm = changes(spark, (3, 3, 3), ref="crm.sales.orders")
    both = once.unionByName(crm)
    a = DestinationConfig("a", "json_log", tables=("inventory.*.products", "crm.*"))
    b = DestinationConfig("b", "json_log", tables=("inventory.inventory.products_on_han?",))
    off = DestinationConfig("off", "json_log", enabled=False)
    got = sorted((r.destination, r.table_ref) for r in dl.route_to_destinations(both, [a, b, off]).collect())
    assert got == [("a", "crm.sales.orders"), ("b", REF), ("b", REF)]
    assert dl.route_to(both, a).count() == 1
    assert "Exchange" not in dl.route_to_destinations(c, [a, b])._jdf.queryExecution().executedPlan().toString()


def test_typed_log_and_views(spark, tmp_path):
    contract = CATALOG.contracts[REF]
    c = changes(spark, (1, 10, 100), (1, 11, 200), (2, 0, 300, "d"))
    dl.append_changelog_table(c, contract, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {"dt", "_op", "_seq", "_event_id", "_origin"} <= set(back.columns) and back.count() == 3
    current = dl.latest_row_view(back, ["product_id"]).collect()
    assert [(r.product_id, r.quantity) for r in current] == [(1, 11)]
    plan = dl.latest_row_view(back, ["product_id"]).filter("product_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product_id,1)" in plan and "WindowGroupLimit" in plan
    assert dl.contract_ddl(contract, "t") == (
        "CREATE TABLE t (`product_id` INT NOT NULL, `quantity` INT NOT NULL, PRIMARY KEY (`product_id`))")
    hit = dl.lookup_key(c, REF, '{"product_id": 1}').first()
    assert hit.changes == 2 and hit.latest.sequence == 200
    name = c.select(dl.destination_table_name()).first()[0]
    assert name == "inventory__inventory__products_on_hand"


def test_json_log_layout(spark, tmp_path):
    dl.append_changelog_json(changes(spark, (1, 10, 1), (2, 20, 2, "u", "repaired")), str(tmp_path))
    files = list(tmp_path.glob("source=inventory/database=inventory/table=products_on_hand/dt=*/part-*"))
    lines = sorted((json.loads(x) for f in files for x in f.read_text().splitlines()), key=lambda r: r["product_id"])
    assert [x["quantity"] for x in lines] == [10, 20] and lines[1]["_origin"] == "repaired"
    assert lines[0]["_key"] == {"product_id": 1} and lines[0]["_seq"] == 1 and lines[0]["_repair_id"] is None


def test_destination_registry():
    doc = {"destinations": {"a": {"type": "json_log", "enabled": "${ON:-false}", "options": {"root": "${R}/x"}},
                            "b": {"type": "json_log", "batch_size": 5}}}
    a, b = load_destinations(doc, {"R": "/data"})
    assert (a.enabled, a.options["root"], b.enabled, b.batch_size) == (False, "/data/x", True, 5)
    assert load_destinations(doc, {"ON": "yes"}, only={"a"})[0].enabled
    assert b.read_options == {"maxOffsetsPerTrigger": "5"} and a.read_options == {}
    (c,) = load_destinations({"destinations": {"c": {"type": "x", "options": {"a": ["x-${M}", 3, "${N:-d}", "$5 {M}"]}}}}, {})
    assert c.options == {"a": ["x-", 3, "d", "$5 {M}"]}
    for bad in ({}, {"bad name!": {"type": "x"}}, {"a": {}}, {"a": {"type": "x", "colour": 1}}, {"a": {"type": "x", "batch_size": "many"}}):
        with pytest.raises(DestinationError):
            load_destinations({"destinations": bad}, {})
    for kind in ("nosuch", "json:dumps", "tests.test_delivery:NotADestination", "nowhere:X"):
        with pytest.raises(DestinationError):
            sp.build_destination(DestinationConfig("x", kind))
    with pytest.raises(DestinationError):
        sp.build_destination(DestinationConfig("x", "json_log"))
    assert isinstance(sp.build_destination(DestinationConfig("x", "tests.test_delivery:Flaky")), Flaky)


class NotADestination:
    pass


class Flaky(sp.Destination):
    fail, written = 0, 0

    def write(self, changes, catalog, run, batch_id):
        if self.fail:
            self.fail -= 1
            raise ConnectionError("down")
        self.written += changes.count()


def run(start):
    query = start()
    query.awaitTermination(300)
    assert query.exception() is None, query.exception()


def test_stream_of_a_log_to_destinations(spark, tmp_path):
    """Routing and delivery as streams; restarts and new checkpoints neither lose nor repeat."""
    p = lambda name: str(tmp_path / name)
    values = [envelope("products_on_hand", {"product_id": i, "quantity": i}, columns=ON_HAND, pos=i) for i in range(3)]
    log(spark, [*values, b"oops"]).write.parquet(p("log"))
    stream = lambda: read_change_log(spark, p("log"), stream=True)
    run(lambda: sp.start_validation(stream(), CATALOG, p("out"), p("c1"), availableNow=True))
    validated, dlq = spark.read.parquet(p("out/validated")), spark.read.parquet(p("out/dlq"))
    assert validated.count() == 3 and dlq.count() == 1
    none = validated.limit(0).drop("schema_notice")
    log(spark, [envelope("products_on_hand", {"product_id": 0, "quantity": 9}, op="u", columns=ON_HAND, pos=50)]
        ).withColumn("offset", F.lit(9).cast("bigint")).write.mode("append").parquet(p("log"))
    run(lambda: sp.start_validation(stream(), CATALOG, p("out"), p("c1"), availableNow=True))
    clean_rows = dl.to_changes(spark.read.parquet(p("out/validated")), none, CATALOG)
    assert clean_rows.count() == 4
    clean_rows.write.parquet(p("changes"))
    source = lambda: spark.readStream.schema(clean_rows.schema).parquet(p("changes"))
    wh = DestinationConfig("warehouse", "current", options={"path": p("wh")})
    lake = DestinationConfig("lake", "table_log", options={"root": p("lake")})
    jl = DestinationConfig("landing", "json_log", options={"root": p("jl")})
    for config in (wh, lake, jl):
        for checkpoint in ("a", "a", "b"):  # first run, restart, everything again under a new checkpoint
            run(lambda: sp.start_delivery(source(), config, CATALOG, p(f"c-{config.name}-{checkpoint}"), availableNow=True))
    current = sp.CurrentState("w", {"path": p("wh")}).read(spark)
    assert quantities(current) == {0: (9, "u"), 1: (1, "c"), 2: (2, "c")}
    table = spark.read.parquet(p("lake/table=inventory__inventory__products_on_hand"))
    assert table.count() == 4
    lines = [x for f in (tmp_path / "jl").rglob("part-*.txt") for x in f.read_text().splitlines()]
    assert len(lines) == 4


def deliver(spark, tmp_path, frame, config, checkpoint, catalog=CATALOG, **more):
    """One delivery of a frame under a checkpoint of its own."""
    folder = str(tmp_path / f"in-{checkpoint}")
    frame.write.parquet(folder)
    source = spark.readStream.schema(frame.schema).parquet(folder)
    run(lambda: sp.start_delivery(source, config, catalog, str(tmp_path / f"c-{checkpoint}"), availableNow=True, **more))


def test_written_rows_are_the_ledger(spark, tmp_path):
    """Data that a stopped batch left, without any mark, is not written again by another query."""
    c = changes(spark, (1, 1, 1), (2, 2, 2))
    for kind in ("json_log", "table_log"):
        config = DestinationConfig(kind, kind, options={"root": str(tmp_path / kind), "look_back_days": 3})
        target = sp.build_destination(config)
        target.write(c, CATALOG, "stopped", 0)
        deliver(spark, tmp_path, c.unionByName(changes(spark, (3, 3, 3))), config, kind, attempts=str(tmp_path / f"n-{kind}"))
        assert sorted(r.event_id for r in target.read(spark, CATALOG).collect()) == ["e-1-1", "e-2-2", "e-3-3"]
        stats = observe.delivery_stats(spark.read.parquet(str(tmp_path / f"n-{kind}"))).first()
        assert (stats.delivered, stats.duplicates, stats.failed_batches) == (1, 2, 0) and stats.last_delivery > 0


def test_tables_without_contract_are_kept_and_delivered_later(spark, tmp_path):
    config = DestinationConfig("t", "table_log", options={"root": str(tmp_path / "t")})
    c = changes(spark, (1, 1, 1)).unionByName(changes(spark, (3, 3, 3), ref="crm.sales.orders"))
    deliver(spark, tmp_path, c, config, "a")
    target = sp.build_destination(config)
    assert [r.table_ref for r in target.unrouted(spark).collect()] == ["crm.sales.orders"]
    assert [r._event_id for r in target.delivered(spark, "x", 0).collect()] == ["e-1-1"]
    own = Catalog.from_documents({"sources": {"crm": {"engine": "mysql", "database": "sales", "tables": [
        {"name": "orders", "primary_key": ["product_id"], "contract": "c"}]}}},
        {"c": {k: v for k, v in CATALOG.contracts[REF].document.items() if k != "x-source"}})
    deliver(spark, tmp_path, c, config, "b", own)
    assert sorted(r._event_id for r in target.delivered(spark, "x", 0).collect()) == ["e-1-1", "e-3-3"]
    assert dl.table_folder("a", "b", "c-d") != dl.table_folder("a", "b", "c_d") == "a__b__c_d"


def test_state_is_compacted_and_destinations_are_read(spark, tmp_path):
    targets = [sp.build_destination(DestinationConfig(n, n, options={k: str(tmp_path / n)}))
               for n, k in (("current", "path"), ("json_log", "root"), ("table_log", "root"))]
    for i, batch in enumerate([changes(spark, (1, 1, 10), (2, 2, 20)), changes(spark, (1, 5, 30)), changes(spark, (2, 9, 5))]):
        for target in targets:
            target.write(batch, CATALOG, "r", i)
    before = quantities(targets[0].read(spark))
    targets[0].compact(spark)
    assert quantities(targets[0].read(spark)) == before == {1: (5, "u"), 2: (2, "u")}
    assert len(list((tmp_path / "current" / "log").glob("run=*/batch=*"))) == 1
    stored = sp.read_destinations(spark, targets, CATALOG)
    hits = {r.destination: (r.changes, int(r.latest.sequence)) for r in dl.lookup_key(
        stored.withColumn("key", F.regexp_replace("key", " ", "")), REF, '{"product_id":1}').collect()}
    assert hits == {"current": (1, 30), "json_log": (2, 30), "table_log": (2, 30)}


def test_both_views_break_ties_alike(spark, tmp_path):
    c = changes(spark, (1, 1, 7)).withColumns({"event_id": F.lit("z"), "partition": F.lit(0), "offset": F.lit(1).cast("bigint")}).unionByName(
        changes(spark, (1, 2, 7)).withColumns({"event_id": F.lit("a"), "partition": F.lit(0), "offset": F.lit(2).cast("bigint")}))
    assert quantities(dl.latest_per_key(c)) == {1: (2, "u")}
    log_ = dl.typed_changes(c, CATALOG.contracts[REF])
    assert [r.quantity for r in dl.latest_row_view(log_, ["product_id"]).collect()] == [2]


def test_large_and_unreadable_positions(spark):
    metas = [{"lsn": "9300000000000000000"}, {"file": "b.000001", "pos": "18446744073709551615"}, {"lsn": "0/16B"}]
    frame = spark.createDataFrame([(m,) for m in metas], "meta map<string,string>")
    got = [r[0] for r in frame.select(dl.source_sequence(F.col("meta"), F.lit(1).cast("bigint"))).collect()]
    assert got[0] == 9300000000000000000 and got[1] == 10**15 + 18446744073709551615 * 1000 and got[2] is None
    routed = route_changes(log(spark, [envelope("products_on_hand", {"product_id": 5, "quantity": 2}, columns=ON_HAND, pos="x")]), CATALOG)
    validated = to_validated(routed)
    none = validated.limit(0).drop("schema_notice")
    assert dl.to_changes(validated, none, CATALOG).count() == 0 and dl.unordered(validated, none, CATALOG).count() == 1


def test_failed_batch_is_retried_as_a_whole(spark, tmp_path):
    changes(spark, (1, 5, 10)).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
    config, target = DestinationConfig("flaky", "x"), Flaky("flaky", {})
    target.fail = 1
    query = sp.start_delivery(source(), config, CATALOG, str(tmp_path / "c"), target, availableNow=True)
    with pytest.raises(Exception):
        query.awaitTermination(120)
    run(lambda: sp.start_delivery(source(), config, CATALOG, str(tmp_path / "c"), target, availableNow=True))
    assert target.written == 1


# --- sources, counts, loading -----------------------------------------------------------


def test_catalogue_checks(spark, tmp_path):
    doc = CATALOG.contracts[REF].document
    table = {"name": "products_on_hand", "primary_key": ["product_id"], "contract": "c.json"}
    source = {"engine": "mysql", "database": "inventory", "tables": [table]}
    ok = Catalog.from_documents({"sources": {"a": dict(source, topic_prefix="p")}}, {"c.json": doc})
    assert ok.contracts["a.inventory.products_on_hand"].version == CATALOG.contracts[REF].version
    bad = [
        ({}, {}), ({"a": source, "b": dict(source, topic_prefix="a")}, {"c.json": doc}),
        ({"a": dict(source, server_id=1), "b": dict(source, server_id=1)}, {"c.json": doc}),
        ({"a": source}, {}), ({"a": dict(source, database="x")}, {"c.json": doc}),
        ({"a": source}, {"c.json": dict(doc, anyOf=[])}), ({"a": {"database": "x"}}, {})]
    for sources, documents in bad:
        with pytest.raises(ContractError):
            Catalog.from_documents({"sources": sources}, documents)
    (tmp_path / "contracts").mkdir()
    (tmp_path / "contracts" / "c.json").write_text(json.dumps(doc))
    (tmp_path / "sources.json").write_text(json.dumps({"sources": {"a": source}}))
    loaded = cat.load_contracts(spark, str(tmp_path / "sources.json"), str(tmp_path / "contracts"))
    assert set(loaded.contracts) == {"a.inventory.products_on_hand"}
    assert loaded.fields_df(spark).count() == 2


def test_described_tables_and_generated_contracts(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    spark.range(3).select("id", F.col("id").cast("string").alias("s")).createOrReplaceTempView(name)
    rows = cat.describe_tables(spark, "default", name).collect()
    assert {(r.column_name, r.row_count) for r in rows} == {("id", 3), ("s", 3)}
    columns = spark.createDataFrame(
        [("d", "t", "id", "int(11)", "int", "NO", "PRI", None, 1), ("d", "t", "n", "varchar(9)", "varchar", "YES", "", 9, 2),
         ("d", "t", "p", "decimal(10,2)", "decimal", "NO", "", None, 3), ("d", "t", "at", "date", "date", "YES", "", None, 4)],
        "table_schema string, table_name string, column_name string, column_type string, data_type string, "
        "is_nullable string, column_key string, character_maximum_length int, ordinal_position int")
    doc = json.loads(cat.generate_contracts(columns).first().contract_document)
    assert doc["properties"]["id"] == {"type": "integer", "x-sql-type": "INT", "x-nullable": False, "x-connect-type": "int32"}
    assert doc["properties"]["n"]["maxLength"] == 9 and doc["properties"]["p"]["type"] == "string"
    assert doc["properties"]["at"]["type"] == ["integer", "null"] and "x-connect-type" not in doc["properties"]["at"]
    assert doc["required"] == ["id", "n", "p", "at"] and doc["x-source"]["primary_key"] == ["id"]
    Catalog.from_documents({"sources": {"s": {"engine": "mysql", "database": "d", "tables": [
        {"name": "t", "contract": "x"}]}}}, {"x": doc})


def test_contract_versions(spark):
    registry = spark.createDataFrame([], "subject string, version int, version_hash string, schema string")
    first = spark.createDataFrame([("a", "{1}"), ("b", "{1}")], "subject string, schema string")
    registry = cat.register_contract_versions(first, registry)
    assert cat.register_contract_versions(first, registry).count() == 0
    second = spark.createDataFrame([("a", "{2}"), ("b", "{1}")], "subject string, schema string")
    registry = registry.unionByName(cat.register_contract_versions(second, registry))
    assert {(r.subject, r.version, r.schema) for r in cat.latest_contract_versions(registry).collect()} == {
        ("a", 2, "{2}"), ("b", 1, "{1}")}
    assert cat.contract_subject("s", "d", "t") == "contract.s.d.t-value"


def test_counts_and_lineage(spark):
    values = [envelope("products", LAMP, columns=PRODUCTS, pos=1), b"oops", None]
    routed = route_changes(log(spark, values), CATALOG)
    counts = {(r.source, r.outcome): r.messages for r in observe.outcome_counts(with_reports(routed)).collect()}
    assert counts == {("cdc:inventory.products", "validated"): 1, ("unknown", "dlq:MALFORMED_JSON"): 1,
                      ("unknown", "skipped:tombstone"): 1}
    assert observe.observed(routed).count() == 3
    topic = observe.topic_counts(log(spark, values)).first()
    assert (topic.low, topic.high, topic.messages) == (0, 2, 3)
    assert [r.offset for r in observe.peek(log(spark, values), 1).collect()] == [2]
    parts = log(spark, values).unionByName(log(spark, values[:1]).withColumn("partition", F.lit(1)))
    assert observe.peek(parts, 1).count() == 1 and observe.peek(parts, 1, per_partition=True).count() == 2
    histogram = observe.latency_histogram(spark.createDataFrame([(0.05,), (7.0,), (400.0,)], "s double"), "s")
    assert [r.observations for r in histogram.orderBy("le").collect()] == [1] * 5 + [2] * 6 + [3]
    dlq = to_dlq(routed)
    audit = dlq.select("event_id", F.lit("MANUAL_REVIEW").alias("repair_result"), F.lit("MEDIUM").alias("risk_level"))
    nothing = dlq.limit(0).select("event_id", F.lit("r").alias("repair_id"))
    landed = dlq.select(F.col("event_id").alias("_event_id"), F.lit("lake").alias("destination"))
    row = observe.trace(dlq, nothing, audit, landed).first()
    assert (row.dlq_coordinates, row.repair_result, row.is_repaired, row.destinations) == (
        "cdc.mutations/0/1", "MANUAL_REVIEW", False, ["lake"])
    assert LOG_SCHEMA.startswith("key binary")


def test_loading_new_rows(spark):
    texts = ["1.5 pounds", "2 kg", "1,000 g", "3 Ounces", "5 stone", "no", None, "1.2.3 kg"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    from tidegate.functions.text import stable_quantity, weight_to_kg
    got = [r[0] for r in frame.select(weight_to_kg(F.col("t"))).collect()]
    assert got == [0.68, 2.0, 1.0, 0.085, None, None, None, None]
    assert frame.limit(1).select(stable_quantity(F.lit("abc"))).first()[0] == 165
    raw = spark.createDataFrame(
        [(1, "Old  Bike", None, "about"), (2, "", "x", "d"), (3, "Kite", "", "second"), (4, "Kite", "k", "d"), (5, "Lamp", "l", "d")],
        "row bigint, `Product Name` string, first string, second string")
    spec = {"name": {"from": "Product Name", "max_length": 255}, "text": {"from": ["first", "second"], "max_length": 4},
            "quantity": {"from": "Product Name", "transform": "stable_quantity"}}
    mapped = clean.map_columns(raw, spec, keep=["row"])
    assert [r.text for r in mapped.orderBy("row").collect()] == ["abou", "x", "seco", "k", "l"]
    parent = spark.createDataFrame([(7, "Old Bike", "t")], "id bigint, name string, text string")
    child = spark.createDataFrame([], "product_id bigint, quantity bigint")
    parents, children = clean.load_new(mapped, parent, ["quantity", "gone"], child, "product_id", order="row")
    assert sorted(map(tuple, parents.select("id", "name", "text").collect())) == [(8, "Kite", "seco"), (9, "Lamp", "l")]
    assert children.columns == ["product_id", "quantity"] and children.count() == 2
    numbered = clean.number_rows(spark.range(5000).select((F.col("id") * 3).alias("k")), "k")
    assert numbered.filter(F.col("_position") != F.col("k") / 3 + 1).count() == 0
