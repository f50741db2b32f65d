"""Schema drift: compare a row image with its contract and classify the difference.

All of it is row-local.  A row meets its contract in a lookup join against the
catalogue (broadcast while the catalogue is small), and every comparison after
that is an expression over the row, so routing adds no shuffle and one hot table
cannot overload a task.  Renames are scored later, for dead letters only and once
per drift shape; only the character similarity of names needs Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions import jsonvalue as jv
from tidegate.functions import names
from tidegate.functions.binding import let, non_null
from tidegate.functions.numbers import round_exact
from tidegate.functions.sqltypes import TypeMatrix, lookup
from tidegate.operators.envelope import find_column
from tidegate.sources.catalog import Catalog

TYPE_CHANGE = "struct<field:string,expected:string,actual:string,level:string,compatibility:string>"
NULL_CHANGE = "struct<field:string,expected_nullable:boolean,level:string,detail:string>"
RENAME = ("struct<missing_field:string,unexpected_field:string,confidence:double,"
          "ambiguous:boolean,evidence:array<string>>")
SUMMARY = ["drift_type", "ambiguous", "confidence", "missing_fields", "unexpected_fields",
           "type_mismatches", "nullability_changes", "possible_renames"]
REPORT = [*SUMMARY, "validation_errors", "fingerprint", "drift_detected"]


# --- contract lookup ------------------------------------------------------------


def resolve_source(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds ``registry_name``: by topic prefix, else by database if one source has it."""
    registry = catalog.sources_df(df.sparkSession)
    by_prefix = registry.select(F.col("topic_prefix").alias("source_name"),
                                F.col("registry_name").alias("_by_prefix"))
    by_database = registry.filter("only_one").select(
        F.col("registry_database").alias("source_database"), F.col("registry_name").alias("_by_database"))
    return (
        df.join(by_prefix, "source_name", "left").join(by_database, "source_database", "left")
        .withColumn("registry_name", F.coalesce("_by_prefix", "_by_database"))
        .drop("_by_prefix", "_by_database")
    )


def resolve_contract(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds the contract of (source, database, table); its columns are NULL when there is none."""
    # concat, unlike concat_ws, is NULL when the source is unknown
    key = F.concat("registry_name", F.lit("."), "source_database", F.lit("."), "source_table")
    return resolve_source(df, catalog).withColumn("contract_key", key).join(
        catalog.contracts_df(df.sparkSession).withColumn("has_contract", F.lit(True)),
        "contract_key", "left")


# --- field comparisons ------------------------------------------------------------


def _family(kind: Column) -> Column:
    return F.when(kind == "whole", "number").otherwise(kind)


def _kind_fits(kind: Column, json_types: Column) -> Column:
    """Whether a value conforms to the JSON types of a contract field."""
    has = lambda t: F.array_contains(json_types, t)
    return (
        F.when(kind == "integer", has("integer") | has("number"))
        .when(kind == "whole", has("integer") | has("number"))
        .otherwise(F.array_contains(json_types, kind))
    )


def _family_fits(kind: Column, json_types: Column) -> Column:
    family = _family(kind)
    return F.array_contains(json_types, family) | (
        (family == "integer") & F.array_contains(json_types, "number"))


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _change(field: Column, expected: Column, actual: Column, level: str, verdict: Column) -> Column:
    return F.struct(field.alias("field"), expected.alias("expected"), actual.alias("actual"),
                    F.lit(level).alias("level"), verdict.alias("compatibility"))


def type_change(spec: Column, value: Column, column: Column, matrix: TypeMatrix) -> Column:
    """A type difference at the best level known: SQL, connect, JSON; NULL when none."""
    at_sql = _filled(column["sql_type"]) & _filled(spec["sql_type"])
    at_connect = _filled(column["connect_type"]) & _filled(spec["connect_type"])
    family = _family(value["kind"])
    return (
        F.when(at_sql, let(
            matrix.verdict(spec["sql_type"], column["sql_type"], spec["parts"]),
            lambda v: F.when(v != "identical",
                             _change(spec["name"], spec["sql_type"], column["sql_type"], "sql", v))))
        .when(at_connect, let(
            matrix.connect_verdict(spec["connect_type"], column["connect_type"]),
            lambda v: F.when(v != "identical", _change(
                spec["name"], spec["connect_type"], column["connect_type"], "connect", v))))
        .when((value["kind"] != "null") & ~_family_fits(value["kind"], spec["json_types"]),
              _change(spec["name"], F.array_join(spec["json_types"], "|"), family, "json",
                      F.lit("risky")))
    )


def nullability_change(spec: Column, value: Column, column: Column) -> Column:
    """A NULL or a newly nullable column where the contract says NOT NULL."""

    def change(level: str, detail: str) -> Column:
        return F.struct(spec["name"].alias("field"), F.lit(False).alias("expected_nullable"),
                        F.lit(level).alias("level"), F.lit(detail).alias("detail"))

    return (
        F.when(spec["nullable"], F.lit(None).cast(NULL_CHANGE))
        .when(value["kind"] == "null", change("value", "NULL value for a NOT NULL contract field"))
        .when(F.coalesce(column["optional"], F.lit(False)),
              change("schema", "source column became nullable"))
    )


def field_error(spec: Column, value: Column) -> Column:
    """What is wrong with one value, as ``$.path: message``; NULL when nothing is."""
    at = F.concat(F.lit("$."), spec["name"], F.lit(": "))
    types = F.array_join(F.transform(
        spec["json_types"], lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    return (
        F.when((F.size(spec["json_types"]) > 0) & ~_kind_fits(value["kind"], spec["json_types"]),
               F.concat(at, jv.repr_value(value), F.lit(" is not of type "), types))
        .when((value["kind"] == "string") & (F.length(value["text"]) > spec["max_length"]),
              F.concat(at, jv.repr_value(value), F.lit(" is too long")))
    )


def contract_errors(image: Column, fields: Column, field_names: Column, required: Column,
                    allows_additional: Column) -> Column:
    """Violations of a contract by a row image: required, additional, types, lengths."""
    present = F.map_keys(image)
    absent = F.transform(
        F.filter(required, lambda r: ~F.array_contains(present, r)),
        lambda r: F.concat(F.lit("$: '"), r, F.lit("' is a required property")))
    extra = F.when(allows_additional, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_except(present, field_names)))
    listed = F.array_join(F.transform(extra, lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", ")
    additional = F.when(F.size(extra) > 0, F.array(F.concat(
        F.lit("$: Additional properties are not allowed ("), listed,
        F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)"))))
    # an absent field has no value, hence no error
    wrong = non_null(F.transform(
        fields, lambda f: let(F.try_element_at(image, f["name"]), lambda v: field_error(f, v))))
    return F.concat(absent, F.coalesce(additional, F.array().cast("array<string>")), wrong)


def validate_contract(df: DataFrame, image: str = "image", into: str = "validation_errors") -> DataFrame:
    """Adds the contract violations of an image column."""
    return df.withColumn(into, contract_errors(
        F.col(image), F.col("fields"), F.col("field_names"), F.col("required"),
        F.col("allows_additional")))


def compare_fields(df: DataFrame, matrix: TypeMatrix) -> DataFrame:
    """Missing and unexpected fields, type and nullability changes, contract violations."""
    met = F.transform(
        F.filter("fields", lambda f: F.map_contains_key("image", f["name"])),
        lambda f: F.struct(f.alias("spec"), F.try_element_at("image", f["name"]).alias("value"),
                           find_column(F.col("column_schema"), f["name"]).alias("column")))
    compared = df.withColumns({
        "_met": met,
        "missing_fields": F.array_except("field_names", F.map_keys("image")),
        "unexpected_fields": F.when(F.col("allows_additional"), F.array().cast("array<string>"))
        .otherwise(F.array_sort(F.array_except(F.map_keys("image"), "field_names"))),
    })
    return validate_contract(compared.withColumns({
        "type_mismatches": non_null(F.transform(
            "_met", lambda m: type_change(m["spec"], m["value"], m["column"], matrix))),
        "nullability_changes": non_null(F.transform(
            "_met", lambda m: nullability_change(m["spec"], m["value"], m["column"]))),
    })).drop("_met")


# --- renames ------------------------------------------------------------------------


def type_affinity(spec: Column, value: Column, column: Column, matrix: TypeMatrix) -> Column:
    """(score, evidence): how well an unexpected column's type fits a missing field."""
    score = lambda v: F.coalesce(lookup(fixed.TYPE_SCORES, v), F.lit(0.2))
    pair = lambda s, e: F.struct(s.alias("score"), e.alias("evidence"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    at_sql = _filled(column["sql_type"]) & _filled(spec["sql_type"])
    at_connect = _filled(column["connect_type"]) & _filled(spec["connect_type"])
    types = F.concat(F.lit("["), F.array_join(F.transform(
        spec["json_types"], lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    family = _family(value["kind"])
    return (
        F.when(at_sql, let(
            matrix.verdict(spec["sql_type"], column["sql_type"], spec["parts"]),
            lambda v: pair(score(v), text("type ", spec["sql_type"], "->", column["sql_type"], " ", v))))
        .when(at_connect, let(
            matrix.connect_verdict(spec["connect_type"], column["connect_type"]),
            lambda v: pair(score(v), text(
                "connect type ", spec["connect_type"], "->", column["connect_type"], " ", v))))
        .when(value["kind"] == "null", pair(F.lit(0.5), F.lit("type unknown (null value)")))
        .when(_family_fits(value["kind"], spec["json_types"]),
              pair(F.lit(0.9), text("value type ", family, " matches")))
        .otherwise(pair(F.lit(0.1), text("value type ", family, " does not match ", types)))
    )


def null_affinity(spec: Column, value: Column, column: Column) -> Column:
    """How well an unexpected column's nullability fits a missing field."""
    optional = F.coalesce(column["optional"], F.lit(False))
    return (
        F.when((value["kind"] == "null") & ~spec["nullable"], 0.0)
        .when(column.isNull(), 0.75)
        .when(~optional | spec["nullable"], 1.0)
        .otherwise(0.5)
    )


def rename_candidates(df: DataFrame, matrix: TypeMatrix, hints: names.RenameHints) -> DataFrame:
    """Adds ``_scored``: every plausible (missing, unexpected) pair of the row, best first.

    Reads ``missing_fields, unexpected_fields, fields`` and ``facts`` (name, kind of value and
    column description of each unexpected field).
    """
    both = (F.size("missing_fields") > 0) & (F.size("unexpected_fields") > 0)
    crossed = F.flatten(F.transform(
        F.col("missing_fields"), lambda m: F.transform(
            F.col("unexpected_fields"), lambda u: F.struct(m.alias("m"), u.alias("u")))))
    paired = df.withColumn("_pairs", F.when(both, crossed))
    rated = paired.withColumn(
        "_ratios", names.similarity_ratios(F.col("_pairs.m"), F.col("_pairs.u")))
    joined = F.transform(F.arrays_zip("_pairs", "_ratios"), lambda z: F.struct(
        z["_pairs"]["m"].alias("m"), z["_pairs"]["u"].alias("u"), z["_ratios"].alias("ratio"),
        F.filter("fields", lambda f: f["name"] == z["_pairs"]["m"])[0].alias("spec"),
        F.filter("facts", lambda f: f["name"] == z["_pairs"]["u"])[0].alias("fact")))

    def affinities(c: Column) -> Column:
        lexical = let(names.tokens(c["m"]), lambda mw: let(
            names.tokens(c["u"]), lambda uw: names.lexical(c["m"], c["u"], c["ratio"], mw, uw, hints)))
        return F.struct(
            c["m"].alias("m"), c["u"].alias("u"), lexical.alias("lexical"),
            type_affinity(c["spec"], c["fact"], c["fact"]["column"], matrix).alias("type"),
            null_affinity(c["spec"], c["fact"], c["fact"]["column"]).alias("null"))

    def confidence(a: Column) -> Column:
        total = (fixed.WEIGHT_LEXICAL * a["lexical"]["score"] + fixed.WEIGHT_TYPE * a["type"]["score"]
                 + fixed.WEIGHT_NULL * a["null"])
        return let(round_exact(total, 3), lambda conf: F.when(
            # a destructive type relationship is never a plain rename
            (a["type"]["score"] != 0.0) & (conf >= fixed.RENAME_MIN),
            F.struct(conf.alias("confidence"), a["m"].alias("m"), a["u"].alias("u"),
                     F.concat(a["lexical"]["evidence"], F.array(a["type"]["evidence"])).alias("evidence"))))

    scored = F.transform(joined, lambda c: let(affinities(c), confidence))
    return rated.withColumn("_scored", F.sort_array(non_null(scored), asc=False)).drop("_pairs", "_ratios")


def assign_renames(df: DataFrame) -> DataFrame:
    """Adds ``possible_renames``: best pair first, each side used once, rivals flagged.

    Rivals are counted for the pairs that are chosen, at most one per missing field.
    """

    def pick(taken: Column, c: Column) -> Column:
        used = F.exists(taken, lambda t: (t["missing_field"] == c["m"]) | (t["unexpected_field"] == c["u"]))
        rivals = F.size(F.filter("_scored", lambda o: (
            ((o["m"] == c["m"]) | (o["u"] == c["u"])) & ~((o["m"] == c["m"]) & (o["u"] == c["u"]))
            & (c["confidence"] - o["confidence"] < fixed.RENAME_MARGIN))))
        chosen = let(rivals, lambda n: F.struct(
            c["m"].alias("missing_field"), c["u"].alias("unexpected_field"),
            c["confidence"].alias("confidence"),
            ((c["confidence"] < fixed.RENAME_CLEAR) | (n > 0)).alias("ambiguous"),
            F.when(n > 0, F.array_append(c["evidence"], F.concat(
                n.cast("string"), F.lit(f" competing candidate(s) within {fixed.RENAME_MARGIN}"))))
            .otherwise(c["evidence"]).alias("evidence")))
        return F.when(used, taken).otherwise(F.array_append(taken, chosen))

    nothing = F.array().cast(f"array<{RENAME}>")
    return df.withColumn("possible_renames", F.when(
        F.size("_scored") > 0, F.aggregate("_scored", nothing, pick)).otherwise(nothing)).drop("_scored")


# --- classification -----------------------------------------------------------------


def _sized(*columns: str) -> Column:
    some = F.lit(False)
    for c in columns:
        some = some | (F.size(c) > 0)
    return some


def classify_drift(df: DataFrame) -> DataFrame:
    """Adds ``drift_type, ambiguous, confidence``."""
    renames = F.col("possible_renames")
    removed = F.size(F.array_except("missing_fields", F.col("possible_renames.missing_field"))) > 0
    added = F.size(F.array_except("unexpected_fields", F.col("possible_renames.unexpected_field"))) > 0
    found = df.withColumns({"_removed": removed, "_added": added})
    kinds = non_null(F.array(
        F.when(F.size("possible_renames") > 0, "RENAMED_COLUMN"),
        F.when(F.col("_added"), "ADDED_COLUMN"),
        F.when(F.col("_removed"), "REMOVED_COLUMN"),
        F.when(F.size("type_mismatches") > 0, "TYPE_CHANGE"),
        F.when(F.size("nullability_changes") > 0, "NULLABILITY_CHANGE")))
    swapped = F.col("_removed") & F.col("_added")
    lowest = F.coalesce(F.array_min(F.col("possible_renames.confidence")), F.lit(1.0))
    only_values = F.col("drift_detected") & (F.size("_kinds") == 0)
    return found.withColumn("_kinds", kinds).withColumns({
        "drift_type": F.when(~F.col("drift_detected"), "NONE")
        .when(F.size("_kinds") == 0, "UNKNOWN")
        .when(F.size("_kinds") == 1, F.try_element_at("_kinds", F.lit(1)))
        .otherwise("MULTIPLE_CHANGES"),
        "ambiguous": only_values | swapped | F.exists(renames, lambda r: r["ambiguous"]),
        "confidence": F.when(only_values | swapped, F.least(lowest, F.lit(0.5))).otherwise(lowest),
    }).drop("_kinds", "_removed", "_added")


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def fingerprint() -> Column:
    """Identity of the shape of a drift, independent of the values of the row."""
    strings = lambda c: _json_list(F.transform(c, jv.ascii_quote))
    types = F.transform("type_mismatches", lambda t: strings(
        F.array(t["field"], t["expected"], t["actual"], t["level"])))
    nulls = F.transform("nullability_changes", lambda n: strings(F.array(n["field"], n["level"])))
    material = F.concat(
        F.lit('{"contract": '), jv.ascii_quote(F.col("contract_key")),
        F.lit(', "contract_version": '), jv.ascii_quote(F.col("contract_version")),
        F.lit(', "missing": '), strings(F.col("missing_fields")),
        F.lit(', "nullability": '), _json_list(nulls),
        F.lit(', "types": '), _json_list(types),
        F.lit(', "unexpected": '), strings(F.col("unexpected_fields")), F.lit("}"))
    return F.substring(F.sha2(material, 256), 1, 24)


def only_compatible_type_changes() -> Column:
    """The only drift is a lossless widening such as INT to BIGINT."""
    others = _sized("missing_fields", "unexpected_fields", "nullability_changes", "validation_errors")
    return _sized("type_mismatches") & ~others & F.forall("type_mismatches", lambda t: t["compatibility"] == "compatible")


def facts() -> Column:
    """What renames are judged by: name, kind of value and description of each unexpected field."""
    return F.transform("unexpected_fields", lambda u: F.struct(
        u.alias("name"), F.try_element_at("image", u)["kind"].alias("kind"),
        find_column(F.col("column_schema"), u).alias("column")))


def detect_drift(resolved: DataFrame, matrix: TypeMatrix | None = None,
                 hints: names.RenameHints | None = None) -> DataFrame:
    """The drift report of every row that has a contract (columns ``REPORT``)."""
    return report_renames(compare(resolved, matrix), matrix, hints)


def compare(resolved: DataFrame, matrix: TypeMatrix | None = None) -> DataFrame:
    """Adds all differences between rows and contracts but renames, and ``drift_detected``."""
    compared = compare_fields(resolved, matrix or TypeMatrix()).withColumn("facts", facts())
    return compared.withColumn("drift_detected", _sized(
        "missing_fields", "unexpected_fields", "type_mismatches", "nullability_changes", "validation_errors"))


#: Rows, the column of their shape, what describes a shape, and how shapes are scored -> rows with ``possible_renames``.
Meet = Callable[[DataFrame, str, list[str], Callable[[DataFrame], DataFrame]], DataFrame]


def report_renames(compared: DataFrame, matrix: TypeMatrix | None = None,
                   hints: names.RenameHints | None = None, meet: Meet | None = None) -> DataFrame:
    """Completes the report of compared rows: renames, classification, fingerprint.

    Renames depend on the shape of a drift, so they are scored once per shape; the rows of a
    shape are met again by a hash of it. Rows without both missing and unexpected fields have none.
    ``meet`` does that otherwise (``streaming.shapes`` from a stored table).
    """
    needed = (F.size("missing_fields") > 0) & (F.size("unexpected_fields") > 0)
    material = F.struct("contract_key", "contract_schema", "missing_fields", "unexpected_fields", "facts")
    shaped = compared.withColumn("_shape", F.when(needed, F.sha2(F.to_json(material), 256)))
    one = ["missing_fields", "unexpected_fields", "facts", "fields"]

    def score(shapes: DataFrame) -> DataFrame:
        scored = assign_renames(rename_candidates(shapes, matrix or TypeMatrix(), hints or names.RenameHints()))
        return scored.select("_shape", "possible_renames")

    if meet is None:
        shapes = shaped.filter("_shape IS NOT NULL").groupBy("_shape").agg(*[F.first(c).alias(c) for c in one])
        met = shaped.join(score(shapes), "_shape", "left").drop("_shape")
    else:
        met = meet(shaped, "_shape", one, score).drop("_shape")
    nothing = F.array().cast(f"array<{RENAME}>")
    renamed = met.withColumn("possible_renames", F.coalesce("possible_renames", nothing))
    return classify_drift(renamed).withColumn("fingerprint", fingerprint())


def drift_summary() -> Column:
    """The report without payload values."""
    return F.struct(*[F.col(c) for c in SUMMARY])


def fit_narrower_types(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """For each column and integer type: the largest absolute value and whether the type holds it. One pass."""
    top = df.agg(*[F.coalesce(F.max(F.abs(F.col(c).cast("decimal(38,0)"))), F.lit(0)).cast("decimal(38,0)").alias(c)
                   for c in columns])

    def fits(column: str, sql_type: str) -> Column:
        limit = fixed.INTEGER_LIMITS.get(sql_type.upper())
        held = F.lit(True) if limit is None else F.col(column) <= limit
        return F.struct(F.lit(column).alias("column_name"), F.lit(sql_type).alias("sql_type"),
                        F.col(column).alias("max_abs"), held.alias("fits"))

    rows = F.array(*[fits(c, t) for c, types in columns.items() for t in types])
    return top.select(F.explode(rows).alias("r")).select("r.*")
