"""The contract catalogue: which tables exist and which rows they may hold.

A catalogue is configuration (one small document per table).  It is read and
checked once on the driver; its DataFrames are local relations, so Spark knows
their exact size and broadcasts them only below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles them beyond.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field
from importlib import resources
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate import fixed_values as fixed
from tidegate.functions.sqltypes import TypeMatrix


# JSON Schema keywords that the drift operators evaluate, and pure annotations.
# Others are refused when a contract is loaded, so none is silently ignored.
_DOCUMENT_KEYWORDS = {"$id", "$schema", "additionalProperties", "description", "properties",
                      "required", "title", "type", "x-source"}
_FIELD_KEYWORDS = {"description", "maxLength", "title", "type", "x-connect-type", "x-nullable",
                   "x-sql-type"}
_JSON_TYPES = {"array", "boolean", "integer", "null", "number", "object", "string"}

_PARTS = pa.struct([("base", pa.string()), ("length", pa.int64()), ("scale", pa.int64()),
                    ("unsigned", pa.bool_())])
_FIELD = pa.struct([
    ("name", pa.string()), ("json_types", pa.list_(pa.string())), ("sql_type", pa.string()),
    ("parts", _PARTS), ("connect_type", pa.string()), ("nullable", pa.bool_()),
    ("max_length", pa.int64()), ("ordinal", pa.int32()),
])
_CONTRACT = pa.schema([
    ("contract_key", pa.string()), ("contract_id", pa.string()), ("contract_version", pa.string()),
    ("contract_source", pa.string()), ("contract_database", pa.string()),
    ("contract_table", pa.string()), ("primary_key", pa.list_(pa.string())),
    ("allows_additional", pa.bool_()), ("required", pa.list_(pa.string())),
    ("field_names", pa.list_(pa.string())), ("fields", pa.list_(_FIELD)),
    ("contract_schema", pa.string()),
])


class ContractError(ValueError):
    """The source registry or a contract is not usable."""


@dataclass(frozen=True)
class Contract:
    """One table's contract: its document, and the row of ``_CONTRACT`` that operators join."""

    document: dict[str, Any] = field(hash=False)
    row: dict[str, Any] = field(hash=False)

    @property
    def key(self) -> str:
        return self.row["contract_key"]

    @property
    def version(self) -> str:
        return self.row["contract_version"]

    @property
    def primary_key(self) -> list[str]:
        return self.row["primary_key"]

    def columns(self) -> dict[str, dict[str, Any]]:
        """The fields by name, in the order of the document."""
        return {f["name"]: f for f in sorted(self.row["fields"], key=lambda f: f["ordinal"])}


def contract_row(place: tuple[str, str, str], primary_key: list[str], document: dict[str, Any],
                 matrix: TypeMatrix) -> dict[str, Any]:
    """The row of ``_CONTRACT`` for the table at ``place`` (source, database, table)."""
    text, key = canonical_text(document), ".".join(place)
    fields = []
    for ordinal, (name, prop) in enumerate(document.get("properties", {}).items()):
        kinds = _listed(prop.get("type"))
        sql = prop.get("x-sql-type")
        fields.append(dict(
            name=name, ordinal=ordinal, json_types=kinds, sql_type=sql, parts=matrix.parse(sql),
            connect_type=prop.get("x-connect-type"), max_length=prop.get("maxLength"),
            nullable=bool(prop["x-nullable"] if "x-nullable" in prop else "null" in kinds)))
    fields.sort(key=lambda f: f["name"])
    row = dict(zip(("contract_source", "contract_database", "contract_table"), place))
    return row | dict(
        contract_key=key, contract_id=document.get("$id") or key, contract_schema=text,
        contract_version=hashlib.sha256(text.encode()).hexdigest()[:12], primary_key=primary_key,
        allows_additional=document.get("additionalProperties", True), required=list(document.get("required", ())),
        field_names=[f["name"] for f in fields], fields=fields)


def _listed(types: Any) -> list[str]:
    return [] if types is None else [types] if isinstance(types, str) else list(types)


def canonical_text(document: dict[str, Any]) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


def contract_subject(source: str, database: str, table: str) -> str:
    return f"contract.{source}.{database}.{table}-value"


@dataclass(frozen=True)
class Catalog:
    """Sources, their tables and one contract per table."""

    sources: dict[str, dict[str, Any]]
    contracts: dict[str, Contract]
    matrix: TypeMatrix = field(default_factory=TypeMatrix)

    @classmethod
    def from_documents(cls, sources: dict[str, Any], documents: dict[str, dict[str, Any]],
                       matrix: TypeMatrix | None = None) -> Catalog:
        """Check a source registry with its contract documents (by file name)."""
        registry = sources.get("sources") or {}
        if not registry:
            raise ContractError("no sources declared")
        prefixes = {name: cfg.get("topic_prefix", name) for name, cfg in registry.items()}
        _unique(prefixes.values(), "topic_prefix")
        _unique([cfg["server_id"] for cfg in registry.values() if cfg.get("server_id")], "server_id")
        matrix, contracts = matrix or TypeMatrix(), {}
        for name, cfg in registry.items():
            if "database" not in cfg or "engine" not in cfg:
                raise ContractError(f"source {name!r} needs a database and an engine")
            for table in cfg.get("tables", []):
                place = (name, cfg["database"], table["name"])
                document = documents.get(table["contract"])
                if document is None:
                    raise ContractError(f"{'.'.join(place)}: there is no document {table['contract']}")
                _check_document(table["contract"], document, place)
                keys = table.get("primary_key") or document.get("x-source", {}).get("primary_key", [])
                contract = Contract(document, contract_row(place, list(keys), document, matrix))
                contracts[contract.key] = contract
        return cls({n: dict(c, topic_prefix=prefixes[n]) for n, c in registry.items()}, contracts, matrix)

    @classmethod
    def default(cls) -> Catalog:
        """The catalogue that comes with the package."""
        root = resources.files("tidegate") / "config"
        documents = {f.name: json.loads(f.read_text()) for f in (root / "contracts").iterdir()
                     if f.name.endswith(".json")}
        return cls.from_documents(json.loads((root / "sources.json").read_text()), documents)

    def contracts_df(self, spark: SparkSession) -> DataFrame:
        """One row per contract, its fields sorted by name."""
        rows = [c.row for c in self.contracts.values()]
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_CONTRACT))

    def fields_df(self, spark: SparkSession) -> DataFrame:
        """One row per contract field."""
        return self.contracts_df(spark).select(
            "contract_key", "contract_table", F.explode("fields").alias("f")
        ).select("contract_key", "contract_table", "f.*")

    def sources_df(self, spark: SparkSession) -> DataFrame:
        """Registry name, topic prefix and database; ``only_one`` marks a database of one source."""
        uses = Counter(cfg["database"] for cfg in self.sources.values())
        rows = [{"registry_name": n, "topic_prefix": c["topic_prefix"], "registry_database": c["database"],
                 "only_one": uses[c["database"]] == 1} for n, c in self.sources.items()]
        schema = pa.schema([("registry_name", pa.string()), ("topic_prefix", pa.string()),
                            ("registry_database", pa.string()), ("only_one", pa.bool_())])
        return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def load_contracts(spark: SparkSession, sources_path: str, contracts_dir: str,
                   matrix: TypeMatrix | None = None) -> Catalog:
    """Read a registry file and a folder of contract documents from any Spark file system."""
    docs = (
        spark.read.text(contracts_dir, wholetext=True, pathGlobFilter="*.json")
        .select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")
        .collect()
    )
    registry = spark.read.text(sources_path, wholetext=True).first()
    try:
        return Catalog.from_documents(
            json.loads(registry["value"]), {d["name"]: json.loads(d["value"]) for d in docs}, matrix)
    except json.JSONDecodeError as exc:
        raise ContractError(f"not valid JSON: {exc}") from exc


def _unique(values: Any, what: str) -> None:
    twice = sorted(str(v) for v, n in Counter(values).items() if n > 1)
    if twice:
        raise ContractError(f"each source needs its own {what}; used twice: {twice}")


def _check_document(file: str, document: dict[str, Any], place: tuple[str, str, str]) -> None:
    """Refuse what the drift operators would ignore, and a document that was written for another table."""
    properties = document.get("properties", {})
    unknown = (set(document) - _DOCUMENT_KEYWORDS).union(*(set(p) - _FIELD_KEYWORDS for p in properties.values()))
    if unknown:
        raise ContractError(f"{file}: unsupported keywords {sorted(unknown)}")
    for name, prop in properties.items():
        if bad := sorted(set(_listed(prop.get("type"))) - _JSON_TYPES):
            raise ContractError(f"{file}: {name} has unknown type {bad}")
    if not isinstance(document.get("additionalProperties", True), bool):
        raise ContractError(f"{file}: additionalProperties must be true or false")
    own = document.get("x-source")
    if own and (own.get("database"), own.get("table")) != place[1:]:
        raise ContractError(f"{file}: its x-source is the table {own.get('table')} of {own.get('database')},"
                            f" the registry gives it to {'.'.join(place)}")


# --- contracts from table descriptions, and their versions -----------------------


def describe_tables(spark: SparkSession, database: str, table: str | None = None) -> DataFrame:
    """Columns of catalogue tables: names, types, nullability and row counts.

    Names come from the catalogue (driver side metadata); each row count is one
    ``count`` in a single union, read from file footers where the format has them.
    """
    listed = {t.name: t.isTemporary for t in spark.catalog.listTables(database) if table in (None, t.name)}
    rows, counts = [], None
    for name, temporary in listed.items():
        frame = spark.table(f"`{name}`" if temporary else f"`{database}`.`{name}`")
        for i, f in enumerate(frame.schema.fields):
            rows.append({"table_name": name, "column_name": f.name, "column_type": f.dataType.simpleString(),
                         "nullable": f.nullable, "ordinal": i})
        one = frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ContractError(f"no tables in {database}")
    schema = pa.schema([("table_name", pa.string()), ("column_name", pa.string()),
                        ("column_type", pa.string()), ("nullable", pa.bool_()), ("ordinal", pa.int32())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema)).join(counts, "table_name")


def generate_contracts(columns: DataFrame) -> DataFrame:
    """Column metadata to contract documents, one row per table.

    Needs ``table_schema, table_name, column_name, column_type, data_type,
    is_nullable, column_key, character_maximum_length, ordinal_position``.
    """
    from tidegate.functions.jsonvalue import quote
    from tidegate.functions.sqltypes import lookup

    kind = F.lower("data_type")
    nullable = F.col("is_nullable") == "YES"
    json_type = F.coalesce(lookup(fixed.DB_TO_JSON_TYPE, kind), F.lit("string"))
    known = kind.isin(list(fixed.DB_TO_CONNECT_TYPE))
    sql_type = F.when(known & (kind != "decimal"),
                      F.regexp_replace(F.upper("column_type"), r"\(\d+\)", "")
                      ).otherwise(F.upper("column_type"))
    connect = F.coalesce(lookup(fixed.DB_TO_CONNECT_TYPE, kind),
                         F.when(json_type == "string", "string"))
    length = F.when(kind.isin("char", "varchar"), F.col("character_maximum_length"))
    text_type = F.concat(F.lit('"'), json_type, F.lit('"'))
    prop = F.concat(
        quote(F.col("column_name")), F.lit(':{"type":'),
        F.when(nullable, F.concat(F.lit("["), text_type, F.lit(',"null"]'))).otherwise(text_type),
        F.lit(',"x-sql-type":'), quote(sql_type),
        F.lit(',"x-nullable":'), nullable.cast("string"),
        F.coalesce(F.concat(F.lit(',"x-connect-type":"'), connect, F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit(',"maxLength":'), length.cast("string")), F.lit("")),
        F.lit("}"),
    )
    # the columns of one table: bounded by the database's own column limit
    per_table = columns.groupBy("table_schema", "table_name").agg(
        F.array_sort(F.collect_list(F.struct(
            "ordinal_position", "column_name", prop.alias("prop"),
            (F.col("column_key") == "PRI").alias("in_key")))).alias("cols"))
    names = lambda cols: F.concat(
        F.lit("["), F.array_join(F.transform(cols, lambda c: quote(c["column_name"])), ","), F.lit("]"))
    ref = F.concat_ws(".", "table_schema", "table_name")
    document = F.concat(
        F.lit('{"$schema":"https://json-schema.org/draft/2020-12/schema","$id":'),
        quote(F.concat(F.lit("urn:cdc:contract:"), ref, F.lit(":v1"))),
        F.lit(',"title":'), quote(ref),
        F.lit(',"type":"object","x-source":{"database":'), quote(F.col("table_schema")),
        F.lit(',"table":'), quote(F.col("table_name")),
        F.lit(',"primary_key":'), names(F.filter("cols", lambda c: c["in_key"])),
        F.lit('},"properties":{'), F.array_join(F.transform("cols", lambda c: c["prop"]), ","),
        F.lit('},"required":'), names(F.col("cols")), F.lit(',"additionalProperties":false}'),
    )
    return per_table.select("table_schema", "table_name", document.alias("contract_document"))


def register_contract_versions(contracts: DataFrame, registry: DataFrame) -> DataFrame:
    """New rows for a version table: only contracts whose hash a subject does not have yet.

    ``contracts``: ``subject, schema``; ``registry``: ``subject, version, version_hash, schema``.
    """
    hashed = contracts.withColumn("version_hash", F.substring(F.sha2("schema", 256), 1, 12))
    new = hashed.dropDuplicates(["subject", "version_hash"]).join(
        registry.select("subject", "version_hash"), ["subject", "version_hash"], "left_anti")
    last = registry.groupBy("subject").agg(F.max("version").alias("last_version"))
    order = Window.partitionBy("subject").orderBy("version_hash")
    return new.join(last, "subject", "left").select(
        "subject",
        (F.coalesce("last_version", F.lit(0)) + F.row_number().over(order)).cast("int").alias("version"),
        "version_hash", "schema")


def latest_contract_versions(registry: DataFrame) -> DataFrame:
    return registry.groupBy("subject").agg(
        F.max("version").alias("version"),
        F.max_by("version_hash", "version").alias("version_hash"),
        F.max_by("schema", "version").alias("schema"))
