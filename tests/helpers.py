"""Change envelopes and logs, built from short descriptions of columns.

A column is written ``name kind sql[?]``: the kind of the wire format, the SQL type, and ``?`` where
NULL is allowed.
"""

from __future__ import annotations

import json
import re

LOG = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
#: Wire names that have to match the change feed's.
WIRE_TYPE = "__debezium.source.column."


def columns_of(text: str) -> dict[str, tuple[str, str | None, bool]]:
    """``a int32 INT; b string VARCHAR(9)?`` as {name: (kind, SQL type, optional)}."""
    out = {}
    for part in filter(None, map(str.strip, text.split(";"))):
        name, kind, sql = (part.split(" ", 2) + [""])[:3]
        out[name] = (kind, sql.rstrip("?") or None, sql.endswith("?"))
    return out


PRODUCTS = columns_of("id int32 INT; name string VARCHAR(255); description string VARCHAR(512)?; weight float FLOAT?")
ON_HAND = columns_of("product_id int32 INT; quantity int32 INT")
#: A row of the first table.
LAMP = {"id": 7, "name": "reading lamp", "description": "brass, with a green shade", "weight": 1.25}


def wire_column(name: str, kind: str, sql: str | None, optional: bool) -> dict:
    words = dict(zip(("type", "length", "scale"), re.findall(r"[A-Z]+(?: UNSIGNED)?|\d+", sql or "")))
    described = {"parameters": {WIRE_TYPE + k: v for k, v in words.items()}} if words else {}
    return {"field": name, "type": kind, "optional": optional} | described


def envelope(table, after, before=None, op="c", columns=None, pos=400, **source):
    """One change; with columns it is wrapped together with their schema."""
    origin = dict(db="inventory", name="cdc", table=table, file="log.000003", pos=pos, row=0, gtid=None, ts_ms=12, connector="mysql")
    change = dict(op=op, before=before, after=after, source=origin | source, ts_ms=1_650_000_000_000)
    if columns is None:
        return change
    fields = [wire_column(name, *about) for name, about in columns.items()]
    images = [dict(field=side, type="struct", optional=True, fields=fields) for side in ("before", "after")]
    return dict(payload=change, schema=dict(type="struct", fields=images))


def log(spark, values, keys=None):
    """A change log of JSON-able values; bytes and None are taken as they are."""
    wire = lambda v: v if isinstance(v, bytes | None) else json.dumps(v).encode()
    keys = keys or [None] * len(values)
    return spark.createDataFrame([(wire(k), wire(v), "cdc.mutations", 0, i, None) for i, (k, v) in enumerate(zip(keys, values))], LOG)
