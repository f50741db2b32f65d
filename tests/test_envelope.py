"""Decoding of change messages: images, columns, keys, ids, and what makes a message unusable."""

import hashlib
import json

import pytest

from tests.helpers import LAMP, PRODUCTS, columns_of, envelope, log
from tidegate.operators.envelope import compact_payload, parse_envelopes
from tidegate.operators.routing import route_changes, to_dlq
from tidegate.sources.catalog import Catalog


def parsed(spark, values, keys=None):
    return parse_envelopes(log(spark, values, keys)).orderBy("offset").collect()


def plain(image):
    return None if image is None else {k: (v.kind, v.text) for k, v in image.items()}


def test_the_image_depends_on_the_operation(spark):
    old, new = {"id": 1, "weight": 2.5}, {"id": 1, "weight": None}
    rows = {r.operation: r for r in parsed(spark, [
        envelope("t", new, op="c"), envelope("t", new, op="r"), envelope("t", new, old, "u"), envelope("t", None, old, "d")])}
    first, second = {"id": ("integer", "1"), "weight": ("number", "2.5")}, {"id": ("integer", "1"), "weight": ("null", None)}
    assert {op: plain(r.image) for op, r in rows.items()} == {"c": second, "r": second, "u": second, "d": first}
    assert {op: plain(r.before) for op, r in rows.items()} == {"c": None, "r": None, "u": first, "d": None}


def test_columns_come_with_wrapped_messages_only(spark):
    kinds = columns_of("a string DECIMAL(10,2); b int32 INT UNSIGNED; c string TEXT(65535)?; d string; e int64 BIGINT?")
    wrapped, bare, gone = parsed(spark, [envelope("t", {"a": "1"}, columns=kinds), envelope("t", {"a": "1"}),
                                         envelope("t", None, {"a": "1"}, "d", kinds)])
    got = {c.name: (c.connect_type, c.sql_type, c.optional) for c in wrapped.column_schema}
    assert got == kinds | {"c": ("string", "TEXT", True)}  # text types have no length
    assert bare.column_schema == [] and gone.column_schema == wrapped.column_schema
    assert plain(wrapped.image) == plain(bare.image) == {"a": ("string", "1")}


# Each rule with the fragment of its message and values that break it and no earlier rule.
SOURCE = {"table": "t"}
RULES = {
    "must be a JSON object": [[1, 2], "text", 5, True],
    "'payload' must be an object": [{"payload": "x", "schema": {}}, {"payload": [], "schema": {}}],
    "missing 'op'": [{"source": SOURCE}, {"op": None, "source": SOURCE}, {"op": 1}, {"payload": {"after": {}}, "schema": {}}],
    "unsupported operation": [{"op": "x", "source": SOURCE}, {"op": "C", "source": SOURCE, "after": {}}],
    "missing 'source'": [{"op": "c", "after": {}}, {"op": "d", "before": {}, "source": None}],
    "source block has no table": [{"op": "r", "after": {}, "source": {"db": "d"}}],
    "'before' must be an object or null": [{"op": "u", "after": {}, "before": [], "source": SOURCE}],
    "'after' must be an object or null": [{"op": "r", "after": "row", "source": SOURCE}],
    "without 'after' image": [{"op": op, "source": SOURCE, "before": {}} for op in "cru"],
    "delete without 'before' image": [{"op": "d", "source": SOURCE, "after": {}}],
}


def test_every_rule_of_envelopes(spark):
    values = [(rule, v) for rule, broken in RULES.items() for v in broken]
    for row, (rule, value) in zip(parsed(spark, [v for _, v in values]), values):
        assert rule in (row.envelope_error or ""), value
        assert row.event_id.startswith("malformed-") and json.loads(row.raw_event) == value


def test_nothing_to_say(spark):
    silent = [None, b"null", {}, {"schema": None, "payload": None}, {"schema": {}, "payload": {}}]
    assert all(r.is_tombstone for r in parsed(spark, silent))
    assert not parsed(spark, [{"payload": {"op": "c"}, "schema": {}}])[0].is_tombstone


def test_text_that_is_not_one_json_value(spark):
    texts = [b"<xml/>", b" ", b'{"a":1} and more', b'{"a":1}]', b'{"a":1} {"b":2}', b"[1", b"{'a':1}", b"NaN", b"\xfe{}"]
    rows = parsed(spark, texts)
    assert all(r.json_error for r in rows)
    assert rows[-1].json_error == "not valid UTF-8"


def test_dead_letters_keep_whole_messages(spark):
    long = {"op": "?", "text": "é" * 90_000}
    broken = b"{" + b"x" * 70_000
    rows = to_dlq(route_changes(log(spark, [long, broken]), Catalog.default())).orderBy("offset").collect()
    assert json.loads(rows[0].raw_event) == long and rows[1].raw_event == broken.decode()


def test_repeated_key_keeps_the_last_value(spark):
    text = b'{"op":"z","op":"c","source":{"table":"t","table":"u"},"after":{"a":1,"a":2}}'
    row = parsed(spark, [text])[0]
    assert row.source_table == "u" and row.image["a"].text == "2"


def test_message_keys(spark):
    v = envelope("products", LAMP)
    long = b"{" + b"k" * 900
    rows = parsed(spark, [v] * 8, [{"id": 1}, {"schema": {}, "payload": {"id": 2}}, 7, b"{oops", None, b"null", long + b"1", long + b"2"])
    assert [r.key_json for r in rows[:6]] == ['{"id":1}', '{"id":2}', '{"key":7}', '{"raw_key":"{oops"}', None, None]
    assert rows[6].key_json != rows[7].key_json and rows[6].event_id != rows[7].event_id


def test_event_id_is_the_hash_of_the_coordinates(spark):
    key = {"name": "Zoë \U0001f6f4", "id": 5}
    row = parsed(spark, [envelope("products", LAMP)], [key])[0]
    material = {"server": "cdc", "db": "inventory", "table": "products", "op": "c", "file": "log.000003",
                "pos": 400, "row": 0, "gtid": None, "lsn": None, "key": key}
    digest = hashlib.sha256(json.dumps(material, sort_keys=True).encode()).hexdigest()[:20]
    assert row.event_id == f"products-c-{digest}"


def test_event_id_is_stable_and_separates_rows_of_a_snapshot(spark):
    a = envelope("products", LAMP, op="r")
    later, other = a | {"ts_ms": 5}, envelope("products", LAMP, op="r", name="crm")
    ids = [r.event_id for r in parsed(spark, [a, later, a, other], [{"id": 1}, {"id": 1}, {"id": 2}, {"id": 1}])]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_compact_payload(spark):
    row = {"long": "x" * 200, "list": list(range(30)), "n": 1}
    frame = compact_payload(parse_envelopes(log(spark, [envelope("t", row)])), max_chars=10, max_list=3)
    view = frame.first().payload_view
    assert view["long"].text == "x" * 10 + "...[truncated]" and view["list"].text == "[0,1,2]"
    assert view["n"].text == "1"


@pytest.mark.parametrize("op", ["t", "m"])
def test_control_events_have_no_images(spark, op):
    row = parsed(spark, [envelope("products", None, op=op, columns=PRODUCTS)])[0]
    assert row.envelope_error is None and row.image == {}
