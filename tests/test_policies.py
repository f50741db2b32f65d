"""Type verdicts and rename hints from files."""

import json

import pytest
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions.names import RenameHints
from tidegate.functions.sqltypes import TypeMatrix
from tidegate.sources import policies


def write(path, document):
    path.write_text(document if isinstance(document, str) else json.dumps(document))
    return str(path)


def test_an_empty_document_keeps_every_default(spark, tmp_path):
    assert policies.load_type_matrix(spark, write(tmp_path / "t.json", {})) == TypeMatrix()
    assert policies.load_rename_hints(spark, write(tmp_path / "h.json", {})) == RenameHints()


def test_the_fixed_rows_as_a_file(spark, tmp_path):
    rows = lambda rules: [dict(zip(("from", "to", "verdict"), r)) for r in rules]
    document = {"default_verdict": "risky", "aliases": fixed.TYPE_ALIASES, "rules": rows(fixed.TYPE_RULES),
                "length_changes": {"widening": "compatible", "narrowing": "destructive"},
                "connect_types": fixed.CONNECT_FAMILIES, "connect_rules": rows(fixed.CONNECT_RULES)}
    assert policies.load_type_matrix(spark, write(tmp_path / "t.json", document)) == TypeMatrix()


def test_own_verdicts_reach_the_expressions(spark, tmp_path):
    path = write(tmp_path / "t.json", {
        "default_verdict": "destructive", "aliases": {"whole": "int"}, "length_changes": {"widening": "risky"},
        "rules": [{"from": "whole", "to": "text", "verdict": "requires_transformation"}],
        "connect_rules": [{"from": "int8", "to": "string", "verdict": "compatible"}]})
    matrix = policies.load_type_matrix(spark, path)
    pairs = [("INT", "TEXT"), ("WHOLE", "INT"), ("INT", "BIGINT"), ("VARCHAR(5)", "VARCHAR(9)"), ("VARCHAR(9)", "VARCHAR(5)")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.v for r in frame.select("i", matrix.verdict(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == ["requires_transformation", "identical", "destructive", "risky", "destructive"]
    wire = spark.range(1).select(matrix.connect_verdict(F.lit("int8"), F.lit("string")), matrix.connect_verdict(F.lit("int8"), F.lit("int16")))
    assert tuple(wire.first()) == ("compatible", "destructive")


def test_own_hints(spark, tmp_path):
    hints = policies.load_rename_hints(spark, write(tmp_path / "h.json", {"synonyms": {"mass": ["heft"]}}))
    assert hints.synonym_pairs() == ["heft|mass", "mass|heft"] and hints.decorators == fixed.DECORATORS


@pytest.mark.parametrize("document", [
    {"rule": []}, {"default_verdict": "fine"}, {"rules": [{"from": "INT", "to": "TEXT"}]}, {"length_changes": {"other": "risky"}},
    {"rules": [{"from": "INT", "to": "TEXT", "verdict": "risky"}, {"from": "INTEGER", "to": "text", "verdict": "compatible"}]},
    {"connect_types": {"int8": "whole"}}, [], "{"])
def test_unusable_type_policies_are_refused(spark, tmp_path, document):
    with pytest.raises(policies.PolicyError):
        policies.load_type_matrix(spark, write(tmp_path / "t.json", document))


@pytest.mark.parametrize("document", [{"synonym": {}}, {"synonyms": {"a": "b"}}, {"decorators": [1]}, ""])
def test_unusable_hints_are_refused(spark, tmp_path, document):
    with pytest.raises(policies.PolicyError):
        policies.load_rename_hints(spark, write(tmp_path / "h.json", document))
