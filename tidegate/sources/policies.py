"""Type verdicts and rename hints from files.

Both are small JSON documents on any file system that Spark reads. What a document leaves out keeps its
default; what it names and cannot be used is an error, so no setting is silently ignored. Examples:

    {"default_verdict": "risky", "aliases": {"INTEGER": "INT"},
     "rules": [{"from": "INT", "to": "BIGINT", "verdict": "compatible"}],
     "length_changes": {"widening": "compatible", "narrowing": "destructive"},
     "connect_types": {"int32": "integer"},
     "connect_rules": [{"from": "int32", "to": "int64", "verdict": "compatible"}]}

    {"synonyms": {"quantity": ["qty"]}, "decorators": ["total"]}

A list of rules replaces the default rules. Two rules about the same types are refused unless they agree,
also where an alias makes them the same.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession

from tidegate.functions.names import RenameHints
from tidegate.functions.sqltypes import VERDICTS, TypeMatrix

_FAMILIES = ("array", "boolean", "integer", "null", "number", "object", "string")


class PolicyError(ValueError):
    """A policy document is not usable."""


def load_type_matrix(spark: SparkSession, path: str) -> TypeMatrix:
    """Read a type policy."""
    return type_matrix(_document(spark, path))


def load_rename_hints(spark: SparkSession, path: str) -> RenameHints:
    """Read rename hints."""
    return rename_hints(_document(spark, path))


def type_matrix(document: dict[str, Any]) -> TypeMatrix:
    """The verdicts that a type policy states."""
    _only(document, {"default_verdict", "aliases", "rules", "length_changes", "connect_types", "connect_rules"})
    lengths = document.get("length_changes", {})
    _only(lengths, {"widening", "narrowing"})
    given: dict[str, Any] = {}
    for name, value in (("default", document.get("default_verdict")), ("widening", lengths.get("widening")),
                        ("narrowing", lengths.get("narrowing"))):
        if value is not None:
            given[name] = _one_of(VERDICTS, value)
    if "aliases" in document:
        given["aliases"] = {a.upper(): b.upper() for a, b in document["aliases"].items()}
    if "connect_types" in document:
        given["families"] = {name: _one_of(_FAMILIES, family) for name, family in document["connect_types"].items()}
    matrix = TypeMatrix(**given)
    if "rules" in document:
        given["rules"] = _rules(document["rules"], matrix.base_name)
    if "connect_rules" in document:
        given["connect_rules"] = _rules(document["connect_rules"], str)
    return TypeMatrix(**given)


def rename_hints(document: dict[str, Any]) -> RenameHints:
    """The hints that a document states."""
    _only(document, {"synonyms", "decorators"})
    words = [document.get("decorators", []), *document.get("synonyms", {}).values()]
    if any(not isinstance(w, list) or not all(isinstance(x, str) for x in w) for w in words):
        raise PolicyError("synonyms and decorators are lists of words")
    return RenameHints(**document)


def _document(spark: SparkSession, path: str) -> dict[str, Any]:
    row = spark.read.text(path, wholetext=True).first()
    try:
        document = json.loads(row.value if row else "")
    except json.JSONDecodeError as error:
        raise PolicyError(f"{path} is not valid JSON: {error}") from error
    if not isinstance(document, dict):
        raise PolicyError(f"{path} holds no JSON object")
    return document


def _rules(rows: list[dict[str, str]], base: Any) -> dict[tuple[str, str], str]:
    out: dict[tuple[str, str], str] = {}
    for row in rows:
        if set(row) != {"from", "to", "verdict"}:
            raise PolicyError(f"a rule has from, to and verdict: {row}")
        pair, verdict = (base(row["from"]), base(row["to"])), _one_of(VERDICTS, row["verdict"])
        if out.setdefault(pair, verdict) != verdict:
            raise PolicyError(f"two verdicts for {pair[0]} to {pair[1]}: {out[pair]} and {verdict}")
    return out


def _one_of(known: tuple[str, ...], value: Any) -> str:
    if value not in known:
        raise PolicyError(f"{value!r} is none of {', '.join(known)}")
    return value


def _only(document: dict[str, Any], known: set[str]) -> None:
    if unknown := set(document) - known:
        raise PolicyError(f"unknown settings: {', '.join(sorted(unknown))}")
