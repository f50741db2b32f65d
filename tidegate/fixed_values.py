"""Constants that results depend on, stated as plain tables.

Everything in this module is a value that has to be exactly what it is for the
results to be right (verdict tables, word lists, limits, formats).  Callers
that need other values pass their own or load them from a file; see
``TypeMatrix``, ``RenameHints`` and ``tidegate.sources.policies``.
"""

# --- change operations ------------------------------------------------------
ROW_OPS = ("c", "d", "r", "u")
CONTROL_OPS = ("m", "t")

# --- SQL type verdicts: contract type -> observed type ----------------------
TYPE_ALIASES = {
    "BOOL": "TINYINT",
    "BOOLEAN": "TINYINT",
    "CHARACTER": "CHAR",
    "INTEGER": "INT",
    "NUMERIC": "DECIMAL",
    "REAL": "DOUBLE",
}
# Contract type, observed type, verdict.
TYPE_RULES = [
    ("TINYINT", "SMALLINT", "compatible"),
    ("TINYINT", "MEDIUMINT", "compatible"),
    ("TINYINT", "INT", "compatible"),
    ("TINYINT", "BIGINT", "compatible"),
    ("SMALLINT", "MEDIUMINT", "compatible"),
    ("SMALLINT", "INT", "compatible"),
    ("SMALLINT", "BIGINT", "compatible"),
    ("MEDIUMINT", "INT", "compatible"),
    ("MEDIUMINT", "BIGINT", "compatible"),
    ("INT", "BIGINT", "compatible"),
    ("INT", "DECIMAL", "compatible"),
    ("INT", "DOUBLE", "compatible"),
    ("FLOAT", "DOUBLE", "compatible"),
    ("FLOAT", "DECIMAL", "requires_transformation"),
    ("CHAR", "VARCHAR", "compatible"),
    ("VARCHAR", "TEXT", "compatible"),
    ("VARCHAR", "MEDIUMTEXT", "compatible"),
    ("VARCHAR", "LONGTEXT", "compatible"),
    ("TEXT", "MEDIUMTEXT", "compatible"),
    ("TEXT", "LONGTEXT", "compatible"),
    ("INT", "VARCHAR", "requires_transformation"),
    ("BIGINT", "VARCHAR", "requires_transformation"),
    ("VARCHAR", "INT", "risky"),
    ("VARCHAR", "BIGINT", "risky"),
    ("DECIMAL", "VARCHAR", "risky"),
    ("DOUBLE", "VARCHAR", "risky"),
    ("BIGINT", "INT", "destructive"),
    ("BIGINT", "SMALLINT", "destructive"),
    ("INT", "SMALLINT", "destructive"),
    ("INT", "TINYINT", "destructive"),
    ("DOUBLE", "FLOAT", "destructive"),
    ("TEXT", "VARCHAR", "destructive"),
    ("LONGTEXT", "VARCHAR", "destructive"),
]
CONNECT_RULES = [
    ("int8", "int16", "compatible"),
    ("int8", "int32", "compatible"),
    ("int8", "int64", "compatible"),
    ("int16", "int32", "compatible"),
    ("int16", "int64", "compatible"),
    ("int32", "int64", "compatible"),
    ("float", "double", "compatible"),
    ("int64", "int32", "destructive"),
    ("double", "float", "destructive"),
    ("int32", "string", "requires_transformation"),
    ("int64", "string", "requires_transformation"),
    ("string", "int32", "risky"),
    ("string", "int64", "risky"),
]
DEFAULT_VERDICT = "risky"
LENGTH_WIDENING = "compatible"
LENGTH_NARROWING = "destructive"

# connect type -> JSON family, used when a source does not send its SQL types
CONNECT_FAMILIES = {
    "boolean": "boolean",
    "bytes": "string",
    "double": "number",
    "float": "number",
    "float32": "number",
    "float64": "number",
    "int16": "integer",
    "int32": "integer",
    "int64": "integer",
    "int8": "integer",
    "string": "string",
}

# --- rename scoring -----------------------------------------------------------
SYNONYMS = {
    "amount": ["amt"],
    "description": ["desc", "descr", "details"],
    "identifier": ["id"],
    "name": ["title", "product_name"],
    "number": ["num", "no", "nbr"],
    "price": ["unit_price", "cost"],
    "quantity": ["qty", "stock_quantity", "quantity_on_hand", "qty_on_hand", "stock"],
    "weight": ["wt", "weight_kg", "product_weight"],
}
DECORATORS = [
    "current", "item", "kg", "lbs", "new", "old", "product",
    "source", "src", "stock", "total", "value",
]
TYPE_SCORES = {
    "identical": 1.0,
    "compatible": 0.8,
    "requires_transformation": 0.4,
    "risky": 0.2,
    "destructive": 0.0,
}
WEIGHT_LEXICAL, WEIGHT_TYPE, WEIGHT_NULL = 0.55, 0.30, 0.15
RENAME_MIN, RENAME_CLEAR, RENAME_MARGIN = 0.55, 0.75, 0.08

# --- repair policy --------------------------------------------------------------
ALLOWED_COLUMN_TYPES = [
    "BIGINT", "BOOL", "BOOLEAN", "CHAR", "DATE", "DATETIME", "DECIMAL",
    "DOUBLE", "FLOAT", "INT", "INTEGER", "JSON", "LONGTEXT", "MEDIUMINT",
    "MEDIUMTEXT", "NUMERIC", "SMALLINT", "TEXT", "TIMESTAMP", "TINYINT", "VARCHAR",
]
MAX_STATEMENTS = 3
CONFIDENCE_THRESHOLD = 0.90
MANUAL_REVIEW_FLOOR = 0.60
MAX_ATTEMPTS = 3
MANUAL_DRIFT_TYPES = ["REMOVED_COLUMN", "UNKNOWN"]
FATAL_CHECKS = ["sql_policy", "code_security", "sandbox_migration", "model_risk"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
TERMINAL_STATUSES = ["REPAIRED", "REJECTED", "MANUAL_REVIEW"]
DRIFT_TYPES = [
    "ADDED_COLUMN", "REMOVED_COLUMN", "RENAMED_COLUMN", "TYPE_CHANGE",
    "NULLABILITY_CHANGE", "MULTIPLE_CHANGES", "UNKNOWN", "NONE",
]
# spellings of "no migration" that arrive as text
NO_MIGRATION_WORDS = ["", "n/a", "na", "no migration", "none", "not required", "null"]

# --- limits -------------------------------------------------------------------

# --- table description -> contract ----------------------------------------------
DB_TO_JSON_TYPE = {
    "bigint": "integer", "char": "string", "date": "integer", "datetime": "integer",
    "decimal": "string", "double": "number", "enum": "string", "float": "number",
    "int": "integer", "json": "string", "longtext": "string", "mediumint": "integer",
    "mediumtext": "string", "smallint": "integer", "text": "string",
    "timestamp": "string", "tinyint": "integer", "varchar": "string",
}
DB_TO_CONNECT_TYPE = {
    "bigint": "int64", "decimal": "string", "double": "double", "float": "float",
    "int": "int32", "mediumint": "int32", "smallint": "int16", "tinyint": "int16",
}
INTEGER_LIMITS = {"TINYINT": 127, "SMALLINT": 32767, "MEDIUMINT": 8388607, "INT": 2147483647}

# --- measurements -----------------------------------------------------------------
UNIT_TO_KG = {
    "g": 0.001, "gram": 0.001, "grams": 0.001,
    "kg": 1.0, "kilogram": 1.0, "kilograms": 1.0,
    "lb": 0.453592, "lbs": 0.453592, "pound": 0.453592, "pounds": 0.453592,
    "ounce": 0.0283495, "ounces": 0.0283495, "oz": 0.0283495,
}
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, 300.0]
