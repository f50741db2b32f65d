"""Decoding of change envelopes.

One strict, typed JSON pass reads a message; only row images stay VARIANT.  The
few messages it does not settle (no JSON object, unknown operation, a schema or
payload alone) are parsed a second time as they are.  Nothing here can fail the
job: every step is a permissive expression whose NULL leads to an error column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions import jsonvalue as jv
from tidegate.functions.binding import let, seal
from tidegate.functions.sqltypes import lookup

_PARAMETER = "__debezium.source.column."
_COLUMN_TYPE = ("array<struct<field string, type string, name string, optional boolean, parameters "
                f"struct<`{_PARAMETER}type` string, `{_PARAMETER}length` string, `{_PARAMETER}scale` string>>>")
_SCHEMA_TYPE = f"struct<fields array<struct<field string, type string, fields {_COLUMN_TYPE}>>>"
_SOURCE_KEYS = ["connector", "db", "file", "gtid", "lsn", "name", "pos", "row", "snapshot",
                "table", "ts_ms", "version"]
_SOURCE_TYPE = f"struct<{', '.join(f'`{k}` string' for k in _SOURCE_KEYS)}>"
_PAYLOAD = ["op string", f"source {_SOURCE_TYPE}", "before variant", "after variant", "ts_ms bigint"]
_ENVELOPE_TYPE = f"schema {_SCHEMA_TYPE}, payload struct<{', '.join(_PAYLOAD)}>, {', '.join(_PAYLOAD)}"
# names of JSON families in error texts
_PYTHON_NAMES = {"array": "list", "boolean": "bool", "integer": "int", "null": "NoneType",
                 "number": "float", "string": "str", "whole": "float"}
# SQL types whose text carries a length
_SIZED_TYPES = ["BINARY", "BIT", "CHAR", "DECIMAL", "NUMERIC", "VARBINARY", "VARCHAR"]
_COLUMN_SCHEMA = ("array<struct<name:string,connect_type:string,logical_type:string,"
                  "optional:boolean,sql_type:string>>")


def decode_json(log: DataFrame) -> DataFrame:
    """Parse value and key; ``json_error`` says why a value is not JSON.

    ``body`` holds the typed members of a JSON object.  ``document`` is the whole
    value as VARIANT, for the few rows that ``body`` does not settle.
    """
    as_text = lambda c: F.when(F.is_valid_utf8(F.col(c)), F.col(c).cast("string"))
    text, body = F.col("_text"), F.col("body")
    read = log.withColumns({
        "_text": as_text("value"), "_key_text": as_text("key"),
        "correlation_id": F.concat_ws("/", "topic", F.col("partition").cast("string"),
                                      F.col("offset").cast("string")),
    }).withColumns({
        "_members": jv.object_members(text, _ENVELOPE_TYPE),
        "key_document": jv.wrap_document(F.col("_key_text")),
    }).withColumn("body", jv.whole_members(F.col("_members"), text))
    op = F.coalesce(body["payload"]["op"], body["op"])
    settled = op.isin(*fixed.ROW_OPS, *fixed.CONTROL_OPS) & (
        body["payload"].isNull() == body["schema"].isNull())
    parsed = read.withColumn(
        "document", F.when(~F.coalesce(settled, F.lit(False)), jv.wrap_document(text)))
    return parsed.withColumns({
        "json_error": F.when(
            F.col("value").isNotNull() & body.isNull() & ~jv.is_whole_document(F.col("document")),
            F.when(text.isNotNull(), "not a valid JSON document").otherwise("not valid UTF-8")),
        "key_is_json": jv.is_whole_document(F.col("key_document")),
    }).drop("_members", "_key_text", "_text")


def unwrap(decoded: DataFrame) -> DataFrame:
    """Find the payload: ``{schema, payload}`` or the bare payload (``is_wrapped``)."""
    has = lambda name: F.try_variant_get("document", f"$[0].{name}", "variant").isNotNull()
    return decoded.withColumn("is_wrapped", F.coalesce(
        F.when(F.col("document").isNull(), F.col("body")["payload"].isNotNull())
        .otherwise(has("payload") & has("schema")), F.lit(False)))


def _field(name: str) -> Column:
    body = F.col("body")
    return F.when(F.col("is_wrapped"), body["payload"][name]).otherwise(body[name])


def _image(name: str) -> Column:
    return F.transform_values(
        F.try_variant_get(_field(name), "$", "map<string,variant>"), lambda _, v: jv.value_of(v))


def _again(name: str) -> Column:
    """A member of the payload as it was sent."""
    get = lambda path: F.try_variant_get("document", path, "variant")
    return F.when(F.col("is_wrapped"), get(f"$[0].payload.{name}")).otherwise(get(f"$[0].{name}"))


def read_fields(unwrapped: DataFrame) -> DataFrame:
    """Operation, source block, images and time of the payload."""
    return unwrapped.withColumns({
        # an op of another JSON type reads as text, so rows with an unknown op are looked at again
        "operation": F.when(
            F.col("document").isNull() | (F.schema_of_variant(_again("op")) == "STRING"), _field("op")),
        "source_block": _field("source"),
        "before_image": _image("before"),
        "after_image": _image("after"),
        "ts_ms": _field("ts_ms"),
    }).withColumns({
        "source_name": F.coalesce("source_block.name", F.lit("")),
        "source_database": F.coalesce("source_block.db", F.lit("")),
        "source_table": F.coalesce("source_block.table", F.lit("")),
    })


def is_tombstone() -> Column:
    """No value, JSON ``null``, an empty payload, or ``payload: null`` with a schema."""
    no_op = F.col("operation").isNull()  # a payload with an op is neither null nor empty
    path = lambda p, t: F.try_variant_get("document", p, t)
    nothing = lambda p: F.is_variant_null(path(p, "variant")) | (
        F.size(path(p, "map<string,string>")) == 0)
    return F.col("value").isNull() | (F.col("json_error").isNull() & no_op & F.coalesce(
        F.when(F.col("is_wrapped"), nothing("$[0].payload")).otherwise(nothing("$[0]")), F.lit(False)))


def envelope_error() -> Column:
    """The first thing wrong with an envelope; NULL when it is usable."""
    op = F.col("operation")
    row_op, known = op.isin(*fixed.ROW_OPS), op.isin(*fixed.ROW_OPS, *fixed.CONTROL_OPS)
    root_kind = lookup(_PYTHON_NAMES, jv.kind_of(F.try_variant_get("document", "$[0]", "variant")))
    bad_payload = F.col("is_wrapped") & op.isNull() & (
        jv.kind_of(F.try_variant_get("document", "$[0].payload", "variant")) != "object")

    def wrong_image(name: str, image: str) -> Column:
        # only images that are not objects are looked at again
        value = _field(name)
        return F.col(image).isNull() & value.isNotNull() & ~F.is_variant_null(value)

    return (
        F.when(F.col("body").isNull(),
               F.concat(F.lit("envelope must be a JSON object, got "), root_kind))
        .when(bad_payload, "envelope 'payload' must be an object")
        .when(op.isNull() | (op == ""), "missing 'op' field")
        .when(~known, F.concat(F.lit("unsupported operation '"), op, F.lit("'")))
        .when(F.col("source_block").isNull(), "missing 'source' block")
        .when(row_op & (F.col("source_table") == ""), "source block has no table")
        .when(wrong_image("before", "before_image"), "'before' must be an object or null")
        .when(wrong_image("after", "after_image"), "'after' must be an object or null")
        .when(op.isin("c", "r", "u") & F.col("after_image").isNull(),
              F.concat(F.lit("op '"), op, F.lit("' without 'after' image")))
        .when((op == "d") & F.col("before_image").isNull(), "delete without 'before' image")
    )


def check_envelope(fields: DataFrame) -> DataFrame:
    """Adds ``is_tombstone`` and ``envelope_error``."""
    return fields.withColumns({
        "is_tombstone": is_tombstone(),
        "envelope_error": F.when(F.col("json_error").isNull(), envelope_error()),
    })


def key_image() -> Column:
    """The message key as an image: unwrapped, scalars under ``key``, junk under ``raw_key``."""
    doc = F.col("key_document")
    path = lambda p, t: F.try_variant_get(doc, p, t)
    wrapped = path("$[0].payload", "variant").isNotNull() & path("$[0].schema", "variant").isNotNull()
    body = F.when(wrapped, path("$[0].payload", "variant")).otherwise(path("$[0]", "variant"))
    as_object = F.when(wrapped, jv.image_at(doc, "$[0].payload")).otherwise(jv.image_at(doc, "$[0]"))
    scalar = F.create_map(F.lit("key"), jv.value_of(body))
    raw = F.create_map(F.lit("raw_key"), F.struct(
        F.lit("string").alias("kind"),
        F.make_valid_utf8(F.col("key").cast("string")).alias("text")))
    # a wrapped key keeps its JSON null as {"key": null}; a bare JSON null is no key
    return (
        F.when(F.col("key").isNull(), F.lit(None).cast(jv.IMAGE_TYPE))
        .when(~F.col("key_is_json"), raw)
        .when(as_object.isNotNull(), as_object)
        .when(~wrapped & F.is_variant_null(body), F.lit(None).cast(jv.IMAGE_TYPE))
        .otherwise(scalar)
    )


def sql_type_of(parameters: Column) -> Column:
    """SQL type from the propagated type, length, scale and UNSIGNED."""
    raw, length, scale = (parameters[_PARAMETER + n] for n in ("type", "length", "scale"))
    sign = " UNSIGNED"

    def written(full: Column) -> Column:
        unsigned = full.endswith(sign)
        base = F.when(unsigned, F.substring(full, 1, F.length(full) - len(sign))).otherwise(full)
        scaled = (scale != "") & base.isin("DECIMAL", "NUMERIC")
        size = F.when((length != "") & base.isin(*_SIZED_TYPES), F.concat(
            F.lit("("), length, F.when(scaled, F.concat(F.lit(","), scale)).otherwise(""), F.lit(")")))
        return F.concat(base, F.coalesce(size, F.lit("")), F.when(unsigned, sign).otherwise(""))

    return F.when(raw != "", let(F.trim(F.upper(raw)), written))


def column_schema() -> Column:
    """Per-column types the envelope sends for the image that is validated."""
    image = F.when(F.col("operation") == "d", "before").otherwise("after")
    sent = F.col("body")["schema"]["fields"]
    found = F.filter(sent, lambda f: (f["field"] == image) & (f["type"] == "struct"))
    described = F.transform(
        F.filter(F.try_element_at(found, F.lit(1))["fields"], lambda c: c["field"].isNotNull()),
        lambda c: F.struct(
            c["field"].alias("name"),
            c["type"].alias("connect_type"),
            c["name"].alias("logical_type"),
            F.coalesce(c["optional"], F.lit(False)).alias("optional"),
            sql_type_of(c["parameters"]).alias("sql_type")))
    return F.coalesce(F.when(F.col("is_wrapped"), described), F.array().cast(_COLUMN_SCHEMA))


def find_column(columns: Column, name: Column) -> Column:
    """The last description of a column; NULL when there is none."""
    return F.try_element_at(F.filter(columns, lambda c: c["name"] == name), F.lit(-1))


def event_id() -> Column:
    """``<table>-<op>-<hash>`` from the change's coordinates and key.

    The same change always gets the same id.  Rows of a snapshot share one
    position, so the key takes part; the time only where there is no position.
    """
    source = lambda name: F.col("source_block")[name]
    placed = F.coalesce(source("file"), F.lit("")) != ""
    logged = ~F.coalesce(source("lsn"), F.lit("0")).isin("0", "")
    texts = {"db": source("db"), "file": source("file"), "gtid": source("gtid"), "op": F.col("operation"),
             "server": source("name"), "table": source("table")}
    numbers = {name: source(name) for name in ("lsn", "pos", "row")}
    no_position = F.when(~placed & ~logged, F.coalesce(F.col("ts_ms").cast("string"), F.lit("null")))

    def material(quoted: Callable[[Column], Column]) -> Column:
        known = {n: F.coalesce(quoted(c), F.lit("null")) for n, c in texts.items()}
        known |= {n: F.when(c.isNull(), "null").when(c.rlike(r"^-?\d+$"), c).otherwise(quoted(c))
                  for n, c in numbers.items()}
        known["key"] = F.coalesce(F.col("key_spaced"), F.lit("null"))
        parts = [F.concat(F.lit(f'"{n}": '), known[n]) for n in sorted(known)]
        return F.concat(F.lit("{"), F.concat_ws(
            ", ", *parts, F.concat(F.lit('"ts_ms": '), no_position)), F.lit("}"))

    # names and positions hardly ever need escapes, so that is asked once for all of them
    plain = F.concat_ws("", *texts.values(), *numbers.values()).rlike(jv.PLAIN_TEXT)
    whole = F.when(plain, material(lambda c: F.concat(F.lit('"'), c, F.lit('"')))).otherwise(
        material(jv.ascii_quote))
    table = F.when(F.col("source_table") == "", "unknown").otherwise(F.col("source_table"))
    return F.concat_ws("-", table, "operation", F.substring(F.sha2(whole, 256), 1, 20))


def select_image(fields: DataFrame) -> DataFrame:
    """The image to validate: before for deletes, else after; before is kept for updates."""
    op = F.col("operation")
    empty = F.create_map().cast(jv.IMAGE_TYPE)
    return fields.withColumns({
        "image": F.coalesce(F.when(op == "d", F.col("before_image")).otherwise(F.col("after_image")), empty),
        "before": F.when(op == "u", F.col("before_image")),
    })


def source_metadata() -> Column:
    """The source block reduced to the keys that later steps use."""
    pairs = [x for k in _SOURCE_KEYS for x in (F.lit(k), F.col("source_block")[k])]
    return F.when(F.col("source_block").isNotNull(), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def raw_text() -> Column:
    """The whole value as text: a dead letter is the only copy once the log has expired."""
    return F.make_valid_utf8(F.col("value").cast("string"))


def malformed_id() -> Column:
    return F.concat(F.lit("malformed-"), F.substring(F.sha2(F.col("correlation_id"), 256), 1, 20))


def parse_envelopes(log: DataFrame) -> DataFrame:
    """Decode a change log; one row out per row in, errors in columns."""
    checked = check_envelope(read_fields(unwrap(decode_json(log))))
    keyed = select_image(checked).withColumn("key_image", key_image())
    spaced = keyed.withColumns({
        "key_spaced": jv.spaced_json(F.col("key_image")),
        "key_json": jv.image_json(F.col("key_image")),
        "column_schema": column_schema(),
        "source_metadata": source_metadata(),
    })
    usable = F.col("json_error").isNull() & F.col("envelope_error").isNull()
    identified = spaced.withColumns({
        "event_id": F.when(usable, event_id()).otherwise(malformed_id()),
        "raw_event": F.when(~usable, raw_text()),
    }).drop("body", "document", "key_document", "key_is_json", "key_image", "key_spaced", "source_block",
            "before_image", "after_image", "is_wrapped")
    return seal(identified, ["event_id", "operation", "source_name", "source_database", "source_table",
                             "is_tombstone", "json_error", "envelope_error"])


def skip_tombstones(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("is_tombstone"))


def control_events(parsed: DataFrame) -> DataFrame:
    """Truncate and message events, which are recorded but never delivered."""
    return parsed.filter(F.col("operation").isin(*fixed.CONTROL_OPS) & F.col("envelope_error").isNull())


def compact_payload(df: DataFrame, column: str = "image", max_chars: int = 120, max_fields: int = 50,
                    max_list: int = 20) -> DataFrame:
    """``payload_view``: a shortened copy of a row image for reviewers."""
    from tidegate.functions.text import shorten

    def short(value: Column) -> Column:
        items = F.from_json(value["text"], "array<string>")
        listed = F.concat(F.lit("["), F.array_join(F.slice(items, 1, max_list), ","), F.lit("]"))
        long_list = (value["kind"] == "array") & (F.size(items) > max_list)
        return F.struct(
            value["kind"].alias("kind"),
            F.when(value["kind"] == "string", shorten(value["text"], max_chars))
            .when(long_list, listed).otherwise(value["text"]).alias("text"))

    view = F.transform_values(
        F.map_from_entries(F.slice(jv.sorted_entries(F.col(column)), 1, max_fields)),
        lambda _, v: let(v, short))
    return df.withColumn("payload_view", view)
