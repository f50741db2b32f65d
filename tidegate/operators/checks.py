"""Independent checks of a repaired row.

All are expressions over row images, so they run per row without a shuffle and
no submitted code is ever executed: a repair can only rename, drop and keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions import jsonvalue as jv
from tidegate.functions.binding import let, non_null
from tidegate.functions.sqltypes import TypeMatrix, lookup
from tidegate.operators.drift import contract_errors

CHECK = "struct<name:string,passed:boolean,detail:string>"
_NULL = lambda: F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("text"))


def check(name: str | Column, passed: Column, detail: Column) -> Column:
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"),
                    passed.alias("passed"), detail.alias("detail"))


def _report(name: str, problems: Column, good: str, separator: str = "; ", prefix: str = "") -> Column:
    """A check that passes when the list of problems is empty."""
    return let(problems, lambda p: check(
        name, F.size(p) == 0,
        F.when(F.size(p) == 0, good).otherwise(
            F.concat(F.lit(prefix), jv.repr_names(p)) if prefix else F.array_join(p, separator))))


def apply_mapping(mapping: Column, image: Column) -> Column:
    """The contract row: every mapped field from its source field, NULL when that is absent."""
    return F.transform_values(
        mapping, lambda _, source: F.coalesce(F.try_element_at(image, source), _NULL()))


def fidelity_problems(output: Column, image: Column, report: Column, field_names: Column) -> Column:
    """Values that a repair invented or altered."""
    changed = F.transform(report["type_mismatches"], lambda t: t["field"])
    kept = F.array_sort(F.filter(
        field_names, lambda n: F.map_contains_key(image, n) & F.map_contains_key(output, n)))

    def altered(n: Column) -> Column:
        def told(new: Column, old: Column) -> Column:
            text = F.when(
                F.array_contains(changed, n),
                F.concat(n, F.lit(": converted value "), jv.repr_value(new), F.lit(" != source "), jv.repr_value(old))
            ).otherwise(F.concat(n, F.lit(": value changed "), jv.repr_value(old), F.lit(" -> "), jv.repr_value(new)))
            return F.when(~jv.same_value(new, old), text)

        # a map is searched from its start each time, so values are looked up once
        return let(F.try_element_at(output, n), lambda new: let(F.try_element_at(image, n), lambda old: told(new, old)))

    def lost(r: Column) -> Column:
        source, target = r["unexpected_field"], r["missing_field"]
        new, old = F.try_element_at(output, target), F.try_element_at(image, source)
        both = F.map_contains_key(image, source) & F.map_contains_key(output, target)
        return F.when(both & ~r["ambiguous"] & ~jv.same_value(new, old), F.concat(
            F.lit("rename "), source, F.lit("->"), target, F.lit(": value "), jv.repr_value(new),
            F.lit(" != source "), jv.repr_value(old)))

    return non_null(F.concat(F.transform(kept, altered), F.transform(report["possible_renames"], lost)))


def check_output(output: Column, image: Column, report: Column, prefix: str = "") -> Column:
    """schema_validation, required_fields, unexpected_fields and data_fidelity of one image.

    Reads the contract columns ``fields field_names required allows_additional``.
    """
    have = F.map_keys(output)
    errors = contract_errors(output, F.col("fields"), F.col("field_names"), F.col("required"),
                             F.col("allows_additional"))
    extra = F.array_sort(F.array_except(have, "field_names"))
    return non_null(F.array(
        _report(f"{prefix}schema_validation", errors, "conforms to the contract"),
        _report(f"{prefix}required_fields", F.array_sort(F.array_except("required", have)),
                "all required fields present", prefix="missing: "),
        F.when(~F.col("allows_additional"),
               _report(f"{prefix}unexpected_fields", extra, "no unexpected fields", prefix="unexpected: ")),
        _report(f"{prefix}data_fidelity", fidelity_problems(output, image, report, F.col("field_names")),
                "source values preserved")))


def check_fidelity(df: DataFrame) -> DataFrame:
    """Adds ``fidelity``: the problems of ``output`` against ``image`` under ``drift_report``."""
    return df.withColumn("fidelity", fidelity_problems(
        F.col("output"), F.col("image"), F.col("drift_report"), F.col("field_names")))


def test_case_result(mapping: Column, test_cases: Column) -> Column:
    """(passed, total) of a proposal's own test cases; informational only."""
    def passes(t: Column) -> Column:
        made = F.array_sort(F.map_entries(F.transform_values(
            mapping, lambda _, s: F.try_element_at(t["input"], s))))
        return made == F.array_sort(F.map_entries(t["expected_output"]))

    return F.struct(F.size(F.filter(test_cases, passes)).alias("passed"), F.size(test_cases).alias("total"))


def check_test_cases(proposals: DataFrame) -> DataFrame:
    return proposals.withColumn("test_result", test_case_result(F.col("mapping"), F.col("test_cases")))


# --- loading ----------------------------------------------------------------------------


def load_problem(name: Column, value: Column, parts: Column, nullable: Column) -> Column:
    """Why a value would not load into a column of a SQL type; NULL when it would."""
    base, text = parts["base"], value["text"]
    number = text.try_cast("decimal(38,10)")
    limit = F.coalesce(
        lookup({k: str(v) for k, v in fixed.INTEGER_LIMITS.items()}, base).cast("decimal(38,0)"),
        F.lit(2**63 - 1).cast("decimal(38,0)"))
    highest = F.when(parts["unsigned"], limit * 2 + 1).otherwise(limit)
    lowest = F.when(parts["unsigned"], F.lit(0).cast("decimal(38,0)")).otherwise(-limit - 1)
    whole = base.isin(*fixed.INTEGER_LIMITS, "BIGINT")
    wrong = lambda what: F.concat(F.lit(what + " for column '"), name, F.lit("'"))
    return (
        F.when(value.isNull() | (value["kind"] == "null"), F.when(
            ~nullable, F.concat(F.lit("column '"), name, F.lit("' cannot be null"))))
        .when(whole & number.isNull(), wrong("incorrect integer value"))
        .when(whole & ~number.between(lowest, highest), wrong("out of range value"))
        .when(base.isin("DECIMAL", "DOUBLE", "FLOAT") & text.try_cast("double").isNull(), wrong("incorrect value"))
        .when((base == "DECIMAL") & (
            F.abs(number) >= F.pow(F.lit(10.0), parts["length"] - F.coalesce(parts["scale"], F.lit(0)))),
            wrong("out of range value"))
        .when(base.isin("CHAR", "VARCHAR") & (F.length(text) > parts["length"]), wrong("data too long"))
    )


def load_problems(output: Column, fields: Column, actions: Column, matrix: TypeMatrix) -> Column:
    """Everything that keeps a row from loading, with the proposal's schema actions applied."""

    def problem(spec: Column) -> Column:
        # the last schema action on the column decides its type
        mine = F.try_element_at(F.filter(
            actions, lambda a: (a["kind"] == "modify_column") & (a["column"] == spec["name"])), F.lit(-1))
        parts = F.when(mine.isNotNull(), matrix.parts(mine["sql_type"])).otherwise(spec["parts"])
        return let(parts, lambda p: let(F.try_element_at(output, spec["name"]), lambda value: load_problem(
            spec["name"], value, p, F.coalesce(mine["nullable"], spec["nullable"]))))

    return non_null(F.transform(fields, problem))


def check_loadable(df: DataFrame, matrix: TypeMatrix | None = None, image: str = "image") -> DataFrame:
    """Adds ``load_problems`` of an image column against the contract's column types."""
    from tidegate.operators.proposals import ACTION

    nothing = F.array().cast(f"array<{ACTION}>")
    return df.withColumn("load_problems", load_problems(
        F.col(image), F.col("fields"), nothing, matrix or TypeMatrix()))


def diff_columns(before: DataFrame, after: DataFrame, matrix: TypeMatrix | None = None) -> DataFrame:
    """Unsafe column changes between two table descriptions.

    Both need ``table_name, column_name, column_type, nullable, column_default``.
    """
    keys = ["table_name", "column_name"]
    rename = lambda d, p: d.select(
        *keys, *[F.col(c).alias(p + c) for c in ("column_type", "nullable", "column_default")],
        F.lit(True).alias(p + "there"))
    both = rename(before, "b_").join(rename(after, "a_"), keys, "full_outer")
    verdict = (matrix or TypeMatrix()).verdict(F.upper("b_column_type"), F.upper("a_column_type"))
    name = F.concat(F.lit("column "), F.col("column_name"))
    kept = F.col("b_there") & F.col("a_there")
    changed = kept & (F.upper("b_column_type") != F.upper("a_column_type"))
    return both.withColumn("_verdict", F.when(changed, verdict)).withColumn("problem", F.explode(non_null(F.array(
        F.when(F.col("a_there").isNull(), F.concat(name, F.lit(" was removed"))),
        F.when(changed & ~F.col("_verdict").isin("compatible", "identical"), F.concat(
            name, F.lit(" changed "), F.upper("b_column_type"), F.lit(" -> "), F.upper("a_column_type"),
            F.lit(" ("), F.col("_verdict"), F.lit(")"))),
        F.when(kept & F.col("b_nullable") & ~F.col("a_nullable"), F.concat(name, F.lit(" became NOT NULL"))),
        F.when(F.col("b_there").isNull() & ~F.col("a_nullable") & F.col("a_column_default").isNull(),
               F.concat(F.lit("new "), name, F.lit(" is NOT NULL without a default")))))
    )).select(*keys, "problem")
