"""Strict JSON on top of VARIANT, and the row image used by every operator.

A row image is ``map<string, struct<kind, text>>``: ``kind`` is the JSON family
(``null boolean integer whole number string array object``, where ``whole`` is a
decimal such as ``3.0`` that has no fraction) and ``text`` the value as text.
Unlike VARIANT it can be compared, shuffled, stored and grouped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.functions.binding import let

IMAGE_TYPE = "map<string,struct<kind:string,text:string>>"

# Unguessable element put behind the document, so that text which closes the
# wrapper early or adds elements is recognised.
_MARK = uuid.uuid4().hex

# printable ASCII without quote and backslash: text that needs no escaping
PLAIN_TEXT = r"^[ !#-\[\]-~]*$"


def wrap_document(text: Column) -> Column:
    """Parse ``[text, mark]``; NULL when the text is not JSON."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))


def is_whole_document(wrapped: Column) -> Column:
    """True when the text was exactly one JSON value."""
    return F.coalesce(
        (F.try_variant_get(wrapped, "$[1]", "string") == _MARK)
        & F.try_variant_get(wrapped, "$[2]", "variant").isNull(),
        F.lit(False),
    )


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def object_members(text: Column, members: str) -> Column:
    """Named members of a JSON object, with the mark behind it (see ``whole_members``)."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{_MARK}":1}}]')),
                       f"array<struct<{members}, `{_MARK}` int>>", _STRICT)


def whole_members(parsed: Column, text: Column) -> Column:
    """The members when the text was exactly one JSON object, else NULL."""
    whole = ((F.size(parsed) == 2) & (F.try_element_at(parsed, F.lit(2))[_MARK] == 1)
             & F.ltrim(text, F.lit(" \t\r\n")).startswith("{"))
    return F.when(whole, F.try_element_at(parsed, F.lit(1)))


def kind_of(value: Column) -> Column:
    """JSON family of a VARIANT value."""

    def from_schema(t: Column) -> Column:
        double = F.try_variant_get(value, "$", "double")
        digits = F.regexp_extract(t, r"\((\d+),", 1).cast("int")
        return (
            F.when(t.isNull() | (t == "VOID"), "null")
            .when(t == "STRING", "string")
            .when(t == "BIGINT", "integer")
            .when(t == "BOOLEAN", "boolean")
            .when(
                t.startswith("DECIMAL"),
                F.when(~t.endswith(",0)"), "number")
                .when(digits >= 19, "integer")
                .otherwise("whole"),
            )
            .when(t.isin("DOUBLE", "FLOAT"),
                  F.when(double == F.floor(double), "whole").otherwise("number"))
            .when(t.startswith("ARRAY"), "array")
            .otherwise("object")
        )

    return let(F.schema_of_variant(value), from_schema)


def value_of(value: Column) -> Column:
    """A VARIANT as the pair (kind, text)."""
    return F.struct(
        kind_of(value).alias("kind"),
        F.try_variant_get(value, "$", "string").alias("text"),
    )


def image_at(document: Column, path: str) -> Column:
    """The object at a path as a row image; NULL when it is not an object."""
    return F.transform_values(
        F.try_variant_get(document, path, "map<string,variant>"), lambda _, v: value_of(v)
    )


def image_of_text(json_text: Column) -> Column:
    """A stored JSON object as a row image."""
    return image_at(F.try_parse_json(json_text), "$")


def quote(text: Column) -> Column:
    """Text as a JSON string; NULL stays NULL."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return (
        F.when(text.rlike(PLAIN_TEXT), F.concat(F.lit('"'), text, F.lit('"')))
        .when(text.isNotNull(), F.substring(wrapped, 6, F.length(wrapped) - 6))
    )


def value_json(value: Column, text_json: Callable[[Column], Column] = quote) -> Column:
    """(kind, text) as JSON; ``text_json`` writes the strings."""
    return (
        F.when(value.isNull() | (value["kind"] == "null"), "null")
        .when(value["kind"] == "string", text_json(value["text"]))
        .otherwise(value["text"])
    )


def sorted_entries(image: Column) -> Column:
    """Entries by key; keys are unique, so the natural order of entries is that of the keys."""
    return F.array_sort(F.map_entries(image))


def image_json(image: Column) -> Column:
    """A row image as compact JSON with sorted keys."""
    members = F.transform(
        sorted_entries(image),
        lambda e: F.concat(quote(e["key"]), F.lit(":"), value_json(e["value"])))
    return F.when(image.isNotNull(),
                  F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))


def spaced_json(image: Column) -> Column:
    """A row image as JSON with sorted keys, spaces and ASCII escapes (id material)."""
    members = F.transform(
        sorted_entries(image),
        lambda e: F.concat(ascii_quote(e["key"]), F.lit(": "), value_json(e["value"], ascii_quote)))
    return F.when(image.isNotNull(),
                  F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")))


def ascii_quote(text: Column) -> Column:
    """Text as a JSON string with every non-ASCII character written as ``\\uXXXX``."""

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        low = code - 65536
        pair = F.format_string("\\u%04x\\u%04x", F.shiftright(low, 10) + 55296, low % 1024 + 56320)
        return (F.when(code < 127, ch)
                .when(code < 65536, F.format_string("\\u%04x", code))
                .otherwise(pair))

    return F.when(text.rlike(PLAIN_TEXT), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.array_join(F.transform(F.split(quote(text), ""), escape), ""))


def same_value(a: Column, b: Column) -> Column:
    """Equal up to a change of type: same value, number, trimmed text or parsed number."""
    numeric = ["integer", "whole", "number"]
    na, nb = a["text"].try_cast("double"), b["text"].try_cast("double")
    kinds = (a["kind"], b["kind"])
    both_numbers = kinds[0].isin(numeric) & kinds[1].isin(numeric)
    return F.coalesce(
        ((kinds[0] == kinds[1]) & a["text"].eqNullSafe(b["text"]))
        | (~(kinds[0] == "boolean") & ~(kinds[1] == "boolean")
           & F.when(both_numbers, na == nb)
           .otherwise((F.trim(a["text"]) == F.trim(b["text"])) | (na == nb))),
        F.lit(False),
    )


def repr_value(value: Column) -> Column:
    """(kind, text) the way messages show it."""
    return (
        F.when(value.isNull() | (value["kind"] == "null"), "None")
        .when(value["kind"] == "string", F.concat(F.lit("'"), value["text"], F.lit("'")))
        .when(value["kind"] == "boolean", F.initcap(value["text"]))
        .when(value["kind"] == "whole",
              F.when(value["text"].contains("."), value["text"])
              .otherwise(F.concat(value["text"], F.lit(".0"))))
        .otherwise(value["text"])
    )


def repr_names(names: Column) -> Column:
    """A list of names the way messages show it: ``['a', 'b']``."""
    return F.concat(
        F.lit("["),
        F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "),
        F.lit("]"),
    )
