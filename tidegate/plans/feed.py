"""Change feeds derived from the standard tables, with labels known by construction.

``part_feed`` turns every part into one change message whose class is
``p_partkey % 10``; ``event_changes`` turns every event into one change of its
user.  Both are projections, so a feed grows with its table.  Parts are spread over
tasks by their number, as a message costs far more than the bytes of its part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.plans.staging import spread

TOPIC = "cdc.mutations"
TS_MS = 1_700_000_000_000
#: A message takes up to half a millisecond to decode and compare, the plan of a task a few seconds to compile.
MESSAGES_PER_TASK = 25_000

# name -> (connect type, SQL base type, length, optional)
_PRODUCTS = {
    "id": ("int32", "INT", None, False),
    "name": ("string", "VARCHAR", 255, False),
    "description": ("string", "VARCHAR", 512, True),
    "weight": ("float", "FLOAT", None, True),
}
_ON_HAND = {
    "product_id": ("int32", "INT", None, False),
    "quantity": ("int32", "INT", None, False),
}


def schema_json(columns: dict[str, tuple]) -> str:
    """The schema block of an envelope whose images have these columns."""
    fields = []
    for name, (connect, sql, length, optional) in columns.items():
        parameters = {"__debezium.source.column.type": sql}
        if length:
            parameters["__debezium.source.column.length"] = str(length)
        fields.append({"type": connect, "optional": optional, "field": name, "parameters": parameters})
    image = {"type": "struct", "optional": True, "fields": fields}
    return json.dumps({"type": "struct", "name": "Envelope", "fields": [
        {**image, "field": "before"}, {**image, "field": "after"},
        {"type": "struct", "field": "source", "fields": []}, {"type": "string", "field": "op"}]})


def json_object(**members: Column) -> Column:
    """The members as JSON text, nulls included."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]), {"ignoreNullFields": "false"})


def envelope(schema: str, table: str, op: str, after: Column, before: Column | None = None) -> Column:
    """A change message about the row with ``p_partkey``, as JSON text."""
    source = json_object(
        version=F.lit("3.0"), connector=F.lit("mysql"), name=F.lit("cdc"), ts_ms=F.lit(TS_MS),
        snapshot=F.lit("false"), db=F.lit("inventory"), table=F.lit(table),
        file=F.lit("mysql-bin.000003"), pos=F.col("p_partkey"), row=F.lit(0), gtid=F.lit(None).cast("string"))
    return F.concat(
        F.lit(f'{{"schema":{schema},"payload":{{"before":'), before if before is not None else F.lit("null"),
        F.lit(',"after":'), after, F.lit(',"source":'), source,
        F.lit(f',"op":"{op}","ts_ms":'), (F.lit(TS_MS) + F.col("p_partkey")).cast("string"), F.lit("}}"))


def part_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change message per part; the class of drift is ``p_partkey % 10``."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"), MESSAGES_PER_TASK)
    pk, size = F.col("p_partkey"), F.col("p_size")
    product = dict(id=pk, name=F.col("p_name"), description=F.col("p_type"), weight=F.col("p_retailprice"))
    no_weight = {k: v for k, v in product.items() if k != "weight"}
    on_hand = dict(product_id=pk, quantity=size)
    renamed = lambda n: json_object(product_id=pk, stock_quantity=n)
    wide = dict(_ON_HAND, quantity=("int64", "BIGINT", None, False))
    p_schema, h_schema = schema_json(_PRODUCTS), schema_json(_ON_HAND)
    value = (
        F.when(pk % 20 == 0, envelope(p_schema, "products", "c", json_object(**product)))
        .when(pk % 20 == 10, envelope(h_schema, "products_on_hand", "c", json_object(**on_hand)))
        .when(pk % 10 == 1, envelope(
            schema_json({"product_id": _ON_HAND["product_id"], "stock_quantity": _ON_HAND["quantity"]}),
            "products_on_hand", "u", renamed(size), renamed(size + 1)))
        .when(pk % 10 == 2, envelope(
            schema_json(dict(_PRODUCTS, supplier_code=("string", "VARCHAR", 64, True))),
            "products", "c", json_object(**product, supplier_code=F.col("p_brand"))))
        .when(pk % 10 == 3, envelope(schema_json(wide), "products_on_hand", "c", json_object(**on_hand)))
        .when(pk % 10 == 4, envelope(
            schema_json({k: v for k, v in _PRODUCTS.items() if k != "weight"}),
            "products", "c", json_object(**no_weight)))
        .when(pk % 10 == 5, envelope(
            p_schema, "products", "c", json_object(**dict(product, name=F.lit(None).cast("string")))))
        .when(pk % 10 == 6, F.concat(F.lit('{"payload": '), pk.cast("string"), F.lit(" broken")))
        .when(pk % 10 == 7, envelope(p_schema, "unlisted", "c", json_object(**product)))
        .when(pk % 10 == 8, envelope(p_schema, "products", "t", F.lit("null")))
    )
    key = F.when(pk % 10 == 8, F.lit(None).cast("string")).when(
        (pk % 10).isin(1, 3) | (pk % 20 == 10), json_object(product_id=pk)
    ).otherwise(json_object(id=pk))
    return part.select(
        key.cast("binary").alias("key"), value.cast("binary").alias("value"),
        F.lit(TOPIC).alias("topic"), (pk % 3).cast("int").alias("partition"), pk.alias("offset"),
        F.timestamp_millis(F.lit(TS_MS) + pk).alias("timestamp"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change record per event: the user is the key, the event id the sequence."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = (F.when(F.col("event_type") == "signup", "c")
          .when(F.col("event_type") == "error", "d").otherwise("u"))
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("event_id"),
        F.lit("app").alias("source"), F.lit("web").alias("database"), F.lit("users").alias("table"),
        F.lit("app.web.users").alias("table_ref"), op.alias("op"),
        json_object(user_id=F.col("user_id")).alias("key"),
        json_object(user_id=F.col("user_id"), value=F.col("value"), event_type=F.col("event_type")).alias("payload"),
        F.col("event_id").cast("decimal(38,0)").alias("sequence"),
        F.when(F.col("event_id") % 7 == 0, "repaired").otherwise("validated").alias("origin"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("rep-"), F.col("event_id").cast("string"))).alias("repair_id"),
        F.concat(F.lit("app.events/"), (F.col("event_id") % 4).cast("string"), F.lit("/"),
                 F.col("event_id").cast("string")).alias("correlation_id"),
        F.lit("urn:app:users:v1").alias("contract_id"),
        F.unix_millis(F.to_timestamp("ts")).alias("source_ts_ms"),
        F.lit("app.events").alias("topic"), (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"))
