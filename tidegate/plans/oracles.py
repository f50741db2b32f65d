"""DuckDB SQL for the registered queries.

Written against the base tables, from the labels that hold by construction; none
of it goes through the feed or the operators.
"""

from __future__ import annotations

from tidegate import fixed_values as fixed
from tidegate.plans import queries as q
from tidegate.plans.feed import TS_MS
from tidegate.sources.catalog import Catalog

_CATALOG = Catalog.default()
_P = _CATALOG.contracts["inventory.inventory.products"]
_H = _CATALOG.contracts["inventory.inventory.products_on_hand"]

# c: class of the part; product: whether its message is about products
_FEED = f"""feed AS (
  SELECT p.*, p_partkey % 10 AS c,
    (p_partkey % 20 = 0 OR p_partkey % 10 IN (2, 4, 5, 8)) AS product,
    CASE WHEN p_partkey % 20 = 0 OR p_partkey % 10 IN (2, 4, 5, 8) THEN 'products'
         WHEN p_partkey % 10 = 7 THEN 'unlisted'
         WHEN p_partkey % 20 = 10 OR p_partkey % 10 IN (1, 3) THEN 'products_on_hand' END AS tbl,
    CASE p_partkey % 10 WHEN 0 THEN 'NONE' WHEN 1 THEN 'RENAMED_COLUMN' WHEN 2 THEN 'ADDED_COLUMN'
         WHEN 3 THEN 'TYPE_CHANGE' WHEN 4 THEN 'REMOVED_COLUMN' WHEN 5 THEN 'NULLABILITY_CHANGE'
         ELSE 'NONE' END AS drift,
    CASE WHEN p_partkey % 10 = 1 THEN 'u' WHEN p_partkey % 10 = 8 THEN 't'
         WHEN p_partkey % 10 IN (6, 9) THEN NULL ELSE 'c' END AS op
  FROM part p)"""

_OP = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END"
_USER_KEY = """'{"user_id":' || user_id || '}'"""
_LATEST = f"""ranked AS (
  SELECT *, {_OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)"""


def _pick(values: list[str], index: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], ({index}) + 1)"


def _rules(rows: list[tuple[str, str, str]]) -> str:
    return "(VALUES " + ", ".join(str(row) for row in rows) + ") r(a, b, v)"


def _parts(column: str) -> str:
    pattern = r"^([A-Z]+)(?:\((\d+)(?:,(\d+))?\))?(?: (UNSIGNED))?$"
    base = f"regexp_extract({column}, '{pattern}', 1)"
    alias = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TYPE_ALIASES.items())
    part = lambda i: f"TRY_CAST(regexp_extract({column}, '{pattern}', {i}) AS BIGINT)"
    p = column[0]
    return (f"CASE {base} {alias} ELSE {base} END AS {p}_base, {part(2)} AS {p}_len, {part(3)} AS {p}_scale, "
            f"regexp_extract({column}, '{pattern}', 4) <> '' AS {p}_uns")


_N, _M = len(q.SQL_TYPES), len(q.CONNECT_TYPES)
_VERDICTS = f"""
WITH pairs AS (
  SELECT {_pick(q.SQL_TYPES, f'p_partkey % {_N}')} AS expected,
         {_pick(q.SQL_TYPES, f'(p_partkey // {_N}) % {_N}')} AS actual,
         {_pick(q.CONNECT_TYPES, f'p_partkey % {_M}')} AS c_expected,
         {_pick(q.CONNECT_TYPES, f'(p_partkey // {_M}) % {_M}')} AS c_actual FROM part),
parsed AS (SELECT *, {_parts('expected')}, {_parts('actual')} FROM pairs),
judged AS (SELECT expected, actual, c_expected, c_actual,
  CASE WHEN e_base = a_base AND e_len IS NOT DISTINCT FROM a_len AND e_scale IS NOT DISTINCT FROM a_scale
            AND e_uns = a_uns THEN 'identical'
       WHEN e_base = a_base AND e_uns <> a_uns THEN 'risky'
       WHEN e_base = a_base AND (e_len IS NULL OR a_len IS NULL)
         THEN CASE WHEN e_scale IS NOT DISTINCT FROM a_scale THEN 'identical' ELSE 'risky' END
       WHEN e_base = a_base AND a_len >= e_len AND coalesce(a_scale, 0) >= coalesce(e_scale, 0) THEN 'compatible'
       WHEN e_base = a_base THEN 'destructive'
       ELSE coalesce((SELECT v FROM {_rules(fixed.TYPE_RULES)} WHERE a = e_base AND b = a_base), 'risky')
  END AS verdict,
  CASE WHEN c_expected = c_actual THEN 'identical'
       ELSE coalesce((SELECT v FROM {_rules(fixed.CONNECT_RULES)} WHERE a = c_expected AND b = c_actual), 'risky')
  END AS c_verdict FROM parsed)
SELECT expected, actual, verdict, c_expected, c_actual, c_verdict, count(*) AS parts
FROM judged GROUP BY ALL"""


def _fingerprint(contract, missing="[]", unexpected="[]", types="[]", nulls="[]") -> str:
    return (f"""substr(sha256('{{"contract": "{contract.key}", "contract_version": "{contract.version}", """
            f""""missing": {missing}, "nullability": {nulls}, "types": {types}, "unexpected": {unexpected}}}'), 1, 24)""")


_SOURCE = "CASE WHEN tbl IS NULL THEN 'unknown' ELSE 'cdc:inventory.' || tbl END"
_STATUS = """CASE WHEN c IN (1, 2, 3) THEN 'REPAIRED' WHEN c = 5 THEN 'REJECTED' ELSE 'MANUAL_REVIEW' END"""
_WIDEN = "ALTER TABLE `products_on_hand` MODIFY COLUMN `quantity` BIGINT NOT NULL"
_DELIVERABLE = "c IN (0, 1, 2, 3)"
_GLOBS = """routes AS (
  SELECT event_type, {op} AS op, ts, user_id, event_id, destination FROM events, LATERAL (
    SELECT unnest(list_filter([
      CASE WHEN event_type = 'error' THEN 'errors_only' END, 'everything',
      CASE WHEN event_type NOT LIKE 'v%' THEN 'not_views' END,
      CASE WHEN length(event_type) = 6 THEN 'six_letters' END], lambda x: x IS NOT NULL)) AS destination))
""".format(op=_OP)
_KG = " ".join(f"WHEN '{u}' THEN {f}" for u, f in fixed.UNIT_TO_KG.items())
_QUANTITY = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256({x}), ''), "
             "lambda d: (instr('0123456789abcdef', d) - 1)::BIGINT)), lambda acc, d: (acc * 16 + d) % 200)")


def _quantity(column: str) -> str:
    return _QUANTITY.format(x=column)


_BRAND = """cols AS (
  SELECT p_brand, p_type, max(p_size) AS size FROM part GROUP BY ALL),
docs AS (
  SELECT p_brand AS table_name, '{"$schema":"https://json-schema.org/draft/2020-12/schema","$id":"urn:cdc:contract:brands.'
    || p_brand || ':v1","title":"brands.' || p_brand || '","type":"object","x-source":{"database":"brands","table":"'
    || p_brand || '","primary_key":[' || coalesce(string_agg('"' || p_type || '"', ',') FILTER (p_type = 'ECONOMY'), '')
    || ']},"properties":{' || string_agg('"' || p_type || '":{"type":'
        || CASE WHEN size > 40 THEN '["string","null"]' ELSE '"string"' END || ',"x-sql-type":"VARCHAR(' || size
        || ')","x-nullable":' || CASE WHEN size > 40 THEN 'true' ELSE 'false' END
        || ',"x-connect-type":"string","maxLength":' || size || '}', ',' ORDER BY ascii(p_type), p_type)
    || '},"required":[' || string_agg('"' || p_type || '"', ',' ORDER BY ascii(p_type), p_type)
    || '],"additionalProperties":false}' AS doc
  FROM cols GROUP BY p_brand)"""

ORACLES: dict[str, str] = {
    "outcome_counts": f"""WITH {_FEED} SELECT {_SOURCE} AS source,
        CASE c WHEN 0 THEN 'validated' WHEN 6 THEN 'dlq:MALFORMED_JSON' WHEN 7 THEN 'dlq:UNKNOWN_SCHEMA'
          WHEN 8 THEN 'validated:control' WHEN 9 THEN 'skipped:tombstone' ELSE 'dlq:SCHEMA_DRIFT' END AS outcome,
        drift AS drift_type, count(*) AS messages FROM feed GROUP BY ALL""",
    "validated_rows": f"""WITH {_FEED} SELECT p_partkey AS "offset", op AS operation, tbl AS source_table,
        CASE WHEN c = 8 THEN '' ELSE 'urn:cdc:contract:inventory.' || tbl || ':v1' END AS contract_id,
        CASE WHEN c = 8 THEN NULL WHEN product THEN '{{"id":' || p_partkey || '}}'
             ELSE '{{"product_id":' || p_partkey || '}}' END AS key,
        {TS_MS} + p_partkey AS ts_ms, CASE WHEN c = 8 THEN 't' ELSE '' END AS control_event,
        CASE WHEN c = 0 AND product THEN p_partkey END AS id, CASE WHEN c = 0 AND product THEN p_name END AS name,
        CASE WHEN c = 0 AND product THEN p_type END AS description,
        CASE WHEN c = 0 AND product THEN p_retailprice END AS weight,
        CASE WHEN c = 0 AND NOT product THEN p_partkey END AS product_id,
        CASE WHEN c = 0 AND NOT product THEN p_size END::BIGINT AS quantity
        FROM feed WHERE c IN (0, 8)""",
    "compatible_widening": """SELECT p_partkey AS "offset", 'quantity' AS field, 'INT' AS expected,
        'BIGINT' AS actual, 'compatible' AS compatibility FROM part WHERE p_partkey % 10 = 3""",
    "dlq_rows": f"""WITH {_FEED} SELECT p_partkey AS "offset", 'cdc.mutations' AS topic, (p_partkey % 3)::INT AS partition,
        'cdc.mutations/' || p_partkey % 3 || '/' || p_partkey AS correlation_id,
        CASE c WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'SCHEMA_DRIFT' END AS reason,
        CASE c WHEN 6 THEN 'not a valid JSON document'
          WHEN 7 THEN 'no canonical contract for cdc:inventory.unlisted' END AS error,
        coalesce(tbl, '') AS source_table, coalesce(op, '') AS operation, c <> 6 AS has_payload, c = 1 AS has_before,
        CASE WHEN c = 6 THEN length('{{"payload": ' || p_partkey || ' broken') END::INT AS raw_chars
        FROM feed WHERE c BETWEEN 1 AND 7""",
    "drift_reports": f"""WITH {_FEED} SELECT p_partkey AS "offset", drift AS drift_type, false AS ambiguous,
        CASE WHEN c = 1 THEN 0.956 ELSE 1.0 END::DOUBLE AS confidence,
        CASE c WHEN 1 THEN 'quantity' WHEN 4 THEN 'weight' ELSE '' END AS missing,
        CASE c WHEN 1 THEN 'stock_quantity' WHEN 2 THEN 'supplier_code' ELSE '' END AS unexpected,
        CASE WHEN c = 3 THEN 'quantity:INT:BIGINT:sql:compatible' ELSE '' END AS type_changes,
        CASE WHEN c = 5 THEN 'name:value:NULL value for a NOT NULL contract field' ELSE '' END AS nullability,
        CASE c WHEN 1 THEN '$: ''quantity'' is a required property; $: Additional properties are not allowed '
                           || '(''stock_quantity'' was unexpected)'
          WHEN 2 THEN '$: Additional properties are not allowed (''supplier_code'' was unexpected)'
          WHEN 4 THEN '$: ''weight'' is a required property'
          WHEN 5 THEN '$.name: None is not of type ''string''' ELSE '' END AS errors,
        CASE c WHEN 1 THEN {_fingerprint(_H, '["quantity"]', '["stock_quantity"]')}
          WHEN 2 THEN {_fingerprint(_P, unexpected='["supplier_code"]')}
          WHEN 3 THEN {_fingerprint(_H, types='[["quantity", "INT", "BIGINT", "sql"]]')}
          WHEN 4 THEN {_fingerprint(_P, '["weight"]')}
          WHEN 5 THEN {_fingerprint(_P, nulls='[["name", "value"]]')} END AS fingerprint
        FROM feed WHERE c BETWEEN 1 AND 5""",
    "rename_pairs": """SELECT p_partkey AS "offset", 'quantity' AS missing_field, 'stock_quantity' AS unexpected_field,
        0.956::DOUBLE AS confidence, false AS ambiguous,
        'name similarity 0.73; token containment (stock extra); configured synonym; type INT->INT identical' AS evidence
        FROM part WHERE p_partkey % 10 = 1""",
    "fingerprint_groups": f"""WITH {_FEED} SELECT 'inventory.inventory.' || tbl AS contract_key, drift AS drift_type,
        count(*) AS events FROM feed WHERE c BETWEEN 1 AND 5 GROUP BY ALL""",
    "event_ids": f"""WITH {_FEED}, ids AS (SELECT *, 'cdc.mutations/' || p_partkey % 3 || '/' || p_partkey AS place FROM feed)
        SELECT p_partkey AS "offset", place AS correlation_id,
        CASE WHEN c = 6 THEN 'malformed-' || substr(sha256(place), 1, 20) ELSE tbl || '-' || op || '-' || substr(sha256(
          '{{"db": "inventory", "file": "mysql-bin.000003", "gtid": null, "key": '
          || CASE WHEN c = 8 THEN 'null' WHEN product OR c = 7 THEN '{{"id": ' || p_partkey || '}}'
                  ELSE '{{"product_id": ' || p_partkey || '}}' END
          || ', "lsn": null, "op": "' || op || '", "pos": ' || p_partkey
          || ', "row": 0, "server": "cdc", "table": "' || tbl || '"}}'), 1, 20) END AS event_id
        FROM ids WHERE c <> 9""",
    "malformed_documents": """SELECT doc_id, 'MALFORMED_JSON' AS reason,
        'malformed-' || substr(sha256('documents/0/' || doc_id), 1, 20) AS event_id,
        length(text)::INT AS raw_chars, md5(text) AS raw_hash FROM documents""",
    "malformed_envelopes": """SELECT event_id AS message, 'MALFORMED_ENVELOPE' AS reason, 'missing ''op'' field' AS error,
        props AS raw_event FROM events""",
    "contract_violations": """SELECT doc_id,
        (2 + (length(lang) > 2)::INT + (length(text) > 255)::INT)::INT AS n_errors,
        ((length(lang) > 2)::INT + (length(text) > 255)::INT)::INT AS n_load_problems,
        '$: Additional properties are not allowed (''source'' was unexpected)' AS additional,
        concat_ws('; ', CASE WHEN length(lang) > 2 THEN 'data too long for column ''lang''' END,
          CASE WHEN length(text) > 255 THEN 'data too long for column ''text''' END) AS load_problems FROM documents""",
    "payload_views": """SELECT doc_id, md5(CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...[truncated]'
        ELSE text END) AS view_hash FROM documents""",
    "type_verdicts": _VERDICTS,
    "narrow_fits": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS sql_type, max(abs({c}))::BIGINT AS max_abs, "
        f"max(abs({c})) <= {fixed.INTEGER_LIMITS[t]} AS fits FROM lineitem"
        for c in ("l_orderkey", "l_quantity", "l_suppkey") for t in ("TINYINT", "SMALLINT", "INT")),
    "drift_summaries": f"""WITH {_FEED} SELECT p_partkey AS "offset", drift AS drift_type, false AS ambiguous,
        CASE WHEN c = 1 THEN 0.956 ELSE 1.0 END::DOUBLE AS confidence, (c IN (1, 4))::INT AS missing, (c IN (1, 2))::INT AS unexpected,
        (c = 3)::INT AS type_changes, (c = 5)::INT AS null_changes, (c = 1)::INT AS renames FROM feed WHERE c BETWEEN 1 AND 5""",
    "long_keys": """SELECT doc_id, md5('{' || text || doc_id) AS key_hash, n_chars AS quantity FROM documents""",
    "long_dead_letters": """SELECT doc_id, 'MALFORMED_ENVELOPE' AS reason, (3 * length(text))::INT AS chars, md5(repeat(text, 3)) AS hash
        FROM documents""",
    "large_positions": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 9300000000000000000::HUGEINT + event_id
        ELSE 2000000000000000::HUGEINT + (10000000000000000000::HUGEINT + event_id) * 1000 END::VARCHAR AS sequence FROM events""",
    "wide_table_repairs": """SELECT s_suppkey, 'REPAIRED' AS status, 130::INT AS mapped, true AS long_mapping FROM supplier""",
    "stored_log": f"""WITH {_FEED} SELECT CASE c WHEN 0 THEN 'validated' WHEN 6 THEN 'dlq:MALFORMED_JSON' WHEN 7 THEN 'dlq:UNKNOWN_SCHEMA'
          WHEN 8 THEN 'validated:control' WHEN 9 THEN 'skipped:tombstone' ELSE 'dlq:SCHEMA_DRIFT' END AS outcome,
        count(*) AS messages FROM feed GROUP BY ALL""",
    "proposal_test_cases": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END::INT AS passed,
        CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END::INT AS total FROM part""",
    "stored_destinations": f"""WITH {_FEED} SELECT destination, 'inventory.inventory.' || tbl AS table_ref, op, count(*) AS changes,
        max(3000000000000000 + p_partkey * 1000) AS last
        FROM feed, (VALUES ('current'), ('json_log'), ('table_log')) AS t(destination) WHERE {_DELIVERABLE} GROUP BY ALL""",
    "decisions": f"""WITH {_FEED} SELECT p_partkey AS "offset",
        CASE c WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'SCHEMA_DRIFT' END AS reason,
        {_STATUS} AS status, CASE WHEN c IN (1, 2, 3) THEN 'LOW' ELSE 'MEDIUM' END AS risk,
        CASE WHEN c IN (1, 2, 3) THEN '' WHEN c = 4 THEN 'confidence: 0.50 < 0.90'
          WHEN c = 5 THEN 'schema_validation: $.name: None is not of type ''string''; confidence: 0.50 < 0.90'
          WHEN c = 6 THEN 'no automatic repair: MALFORMED_JSON'
          ELSE 'no automatic repair: UNKNOWN_SCHEMA' END AS reasons,
        CASE WHEN c IN (1, 2, 3) THEN 1 WHEN c IN (4, 5) THEN 3 ELSE 0 END::INT AS attempt
        FROM feed WHERE c BETWEEN 1 AND 7""",
    "repaired_rows": f"""WITH {_FEED} SELECT p_partkey AS "offset", op AS operation, tbl AS source_table,
        'urn:cdc:contract:inventory.' || tbl || ':v1' AS contract_id, drift AS repair_classification,
        'model' AS repair_source, 0.95::DOUBLE AS confidence,
        CASE WHEN c = 3 THEN '{_WIDEN}' ELSE '' END AS migration_sql,
        CASE WHEN c = 3 THEN 'VERIFIED_IN_SANDBOX' ELSE 'NOT_REQUIRED' END AS migration_status,
        CASE WHEN product THEN 4 ELSE 2 END::INT AS n_fields,
        CASE WHEN product THEN p_partkey END AS id, CASE WHEN product THEN p_name END AS name,
        CASE WHEN product THEN p_type END AS description, CASE WHEN product THEN p_retailprice END AS weight,
        CASE WHEN NOT product THEN p_partkey END AS product_id, CASE WHEN NOT product THEN p_size END::BIGINT AS quantity
        FROM feed WHERE c IN (1, 2, 3)""",
    "repair_checks": f"""WITH {_FEED}, listed AS (SELECT drift, c, unnest(CASE c
          WHEN 1 THEN ['response_schema','model_risk','schema_validation','required_fields','unexpected_fields','data_fidelity',
            'before_image_schema_validation','before_image_required_fields','before_image_unexpected_fields',
            'before_image_data_fidelity','deterministic_replay','sandbox_db_load']
          WHEN 3 THEN ['response_schema','model_risk','sql_policy','schema_validation','required_fields','unexpected_fields',
            'data_fidelity','deterministic_replay','sandbox_migration','sandbox_db_load']
          WHEN 5 THEN ['response_schema','model_risk','schema_validation','required_fields','unexpected_fields','data_fidelity',
            'deterministic_replay']
          ELSE ['response_schema','model_risk','schema_validation','required_fields','unexpected_fields','data_fidelity',
            'deterministic_replay','sandbox_db_load'] END) AS check_name,
        generate_subscripts(CASE c WHEN 1 THEN range(12) WHEN 3 THEN range(10) WHEN 5 THEN range(7) ELSE range(8) END, 1) AS i
        FROM feed WHERE c BETWEEN 1 AND 5)
        SELECT drift AS drift_type, (i - 1)::INT AS position, check_name,
          NOT (c = 5 AND check_name = 'schema_validation') AS passed, count(*) AS rows FROM listed GROUP BY ALL""",
    "audit_rows": f"""WITH {_FEED} SELECT CASE WHEN c = 6 THEN 'unknown' ELSE 'inventory.' || tbl END AS source_table,
        CASE c WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'SCHEMA_DRIFT' END AS dlq_reason,
        drift AS drift_type, CASE WHEN c > 5 THEN '' ELSE drift END AS classification,
        CASE WHEN c IN (1, 2, 3) THEN 0.95 WHEN c IN (4, 5) THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN c IN (1, 2, 3) THEN 'LOW' ELSE 'MEDIUM' END AS risk_level,
        CASE WHEN c = 3 THEN 'VERIFIED_IN_SANDBOX' ELSE 'NOT_REQUIRED' END AS migration_status,
        CASE WHEN c IN (1, 2, 3) THEN 1 WHEN c IN (4, 5) THEN 3 ELSE 0 END::INT AS attempts,
        CASE WHEN c > 5 THEN 'NOT_RUN' ELSE 'PASSED' END AS sandbox_result,
        CASE WHEN c > 5 THEN 'NOT_RUN' WHEN c = 5 THEN 'FAILED' ELSE 'PASSED' END AS validation_result,
        {_STATUS} AS repair_result, count(*) AS events FROM feed WHERE c BETWEEN 1 AND 7 GROUP BY ALL""",
    "repair_reports": f"""WITH {_FEED} SELECT drift || '; lost ' || CASE c WHEN 1 THEN 'quantity' WHEN 4 THEN 'weight' ELSE '-' END
          || '; new ' || CASE c WHEN 1 THEN 'stock_quantity' WHEN 2 THEN 'supplier_code' ELSE '-' END
          || '; retyped ' || CASE WHEN c = 3 THEN 'quantity INT>BIGINT compatible' ELSE '-' END AS drift,
        CASE WHEN c = 1 THEN 'quantity=stock_quantity 0.96' ELSE '-' END AS renames,
        CASE WHEN c = 3 THEN '{_WIDEN} (VERIFIED_IN_SANDBOX)' ELSE '- (NOT_REQUIRED)' END AS migration,
        {_STATUS} AS decision, count(*) AS reports FROM feed WHERE c BETWEEN 1 AND 7 GROUP BY ALL""",
    "cached_repairs": f"""WITH {_FEED} SELECT p_partkey AS "offset",
        CASE WHEN c IN (1, 2, 3) THEN 'REPAIRED' WHEN c IN (4, 5) THEN 'DEFERRED' ELSE 'MANUAL_REVIEW' END AS status,
        CASE WHEN c IN (1, 2, 3) THEN 'cache' ELSE '' END AS repair_source FROM feed WHERE c BETWEEN 1 AND 7""",
    "deferred_events": """SELECT 'cdc.mutations/' || p_partkey % 3 || '/' || p_partkey AS correlation_id,
        'RENAMED_COLUMN' AS drift_type, 'DEFERRED' AS repair_result FROM part WHERE p_partkey % 10 = 1""",
    "deferrals_over_batches": f"""WITH {_FEED} SELECT 'cdc.mutations/' || p_partkey % 3 || '/' || p_partkey AS correlation_id, {_STATUS} AS status,
        (c = 1)::BIGINT AS deferrals, (c = 1)::BIGINT AS deferred_audits, 1 + (c = 1)::BIGINT AS audits FROM feed WHERE c BETWEEN 1 AND 7""",
    "retry_feedback": f"""WITH {_FEED}, lines AS (SELECT unnest(CASE c
          WHEN 1 THEN [
            'meet the contract: $: Additional properties are not allowed (''stock_quantity'' was unexpected)',
            'leave these out: unexpected: [''stock_quantity'']',
            'meet the contract (before image): $: Additional properties are not allowed (''stock_quantity'' was unexpected)',
            'leave these out (before image): unexpected: [''stock_quantity'']']
          WHEN 2 THEN [
            'meet the contract: $: Additional properties are not allowed (''supplier_code'' was unexpected)',
            'leave these out: unexpected: [''supplier_code'']']
          WHEN 4 THEN ['confidence: 0.50 < 0.90']
          ELSE ['meet the contract: $.name: None is not of type ''string''',
                'confidence: 0.50 < 0.90'] END) AS line
        FROM feed WHERE c IN (1, 2, 4, 5))
        SELECT 2::INT AS next_attempt, line, count(*) AS events FROM lines GROUP BY ALL""",
    "pending_events": f"""WITH {_FEED} SELECT p_partkey AS "offset",
        CASE c WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'SCHEMA_DRIFT' END AS reason
        FROM feed WHERE c IN (4, 6, 7)""",
    "replayed_repairs": """SELECT true AS identical, count(*) AS events FROM part WHERE p_partkey % 10 IN (1, 2, 3)""",
    "proposal_shapes": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN ''
          WHEN 2 THEN 'extra: unknown member'
          WHEN 3 THEN 'response: not a JSON object; classification: not a repair classification; confidence: not within 0 and 1; '
            || 'reasoning_summary: empty; mapping: empty; risk_level: unknown level'
          WHEN 4 THEN 'confidence: not within 0 and 1; risk_level: unknown level'
          ELSE 'reasoning_summary: missing; reasoning_summary: empty' END AS violations, 0::INT AS n_actions FROM part""",
    "schema_action_policy": """SELECT p_partkey, p_partkey % 9 IN (0, 3) AS allowed, p_partkey % 9 IN (1, 5, 7, 8) AS destructive,
        CASE p_partkey % 9 WHEN 0 THEN 'LOW' WHEN 3 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 4 THEN 'MEDIUM' WHEN 6 THEN 'MEDIUM'
          ELSE 'HIGH' END AS risk,
        CASE p_partkey % 9 WHEN 1 THEN 'not_wider: weight FLOAT > INT risky'
          WHEN 2 THEN 'no_change: name is VARCHAR(255)'
          WHEN 4 THEN 'column_exists: weight'
          WHEN 5 THEN 'switched_off: change_column'
          WHEN 6 THEN 'switched_off: create_index; unknown_index_column: size'
          WHEN 7 THEN 'other_table: orders instead of products; type_off_list: GEOMETRY'
          WHEN 8 THEN 'unknown_action: drop_column' ELSE '' END AS violations,
        CASE p_partkey % 9 WHEN 0 THEN 'ALTER TABLE `products` MODIFY COLUMN `name` VARCHAR(512) NOT NULL'
          WHEN 3 THEN 'ALTER TABLE `products` ADD COLUMN `note` VARCHAR(64) NULL' ELSE '' END AS statement FROM part""",
    "column_diff": """SELECT 't' || p_partkey AS table_name, CASE p_partkey % 5 WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'a' END AS column_name,
        CASE p_partkey % 5 WHEN 0 THEN 'column a was removed' WHEN 1 THEN 'column a changed INT -> SMALLINT (destructive)'
          WHEN 2 THEN 'column b became NOT NULL' ELSE 'new column c is NOT NULL without a default' END AS problem
        FROM part WHERE p_partkey % 5 <> 4""",
    "change_records": f"""WITH {_FEED} SELECT p_partkey AS "offset", 'inventory.inventory.' || tbl AS table_ref, op,
        CASE WHEN product THEN '{{"id":' || p_partkey || '}}' ELSE '{{"product_id":' || p_partkey || '}}' END AS key,
        3000000000000000 + p_partkey * 1000 AS sequence, CASE WHEN c = 0 THEN 'validated' ELSE 'repaired' END AS origin,
        c <> 0 AS has_repair, 'urn:cdc:contract:inventory.' || tbl || ':v1' AS contract_id, {TS_MS} AS source_ts_ms
        FROM feed WHERE {_DELIVERABLE}""",
    "current_products": f"""WITH {_FEED} SELECT p_partkey AS product_id, p_size::BIGINT AS quantity, op AS _op,
        3000000000000000 + p_partkey * 1000 AS _seq, CASE WHEN c = 0 THEN 'validated' ELSE 'repaired' END AS _origin
        FROM feed WHERE c IN (0, 1, 3) AND NOT product""",
    "latest_per_user": f"""WITH {_LATEST} SELECT {_USER_KEY} AS key, op, event_id AS sequence,
        CASE WHEN event_id % 7 = 0 THEN 'repaired' ELSE 'validated' END AS origin, event_type FROM ranked WHERE rn = 1""",
    "current_users": f"""WITH {_LATEST} SELECT {_USER_KEY} AS key, value, 'evt-' || event_id AS event_id
        FROM ranked WHERE rn = 1 AND op <> 'd'""",
    "late_arrivals": f"""WITH {_LATEST} SELECT {_USER_KEY} AS key, op, event_id AS sequence, 'evt-' || event_id AS event_id
        FROM ranked WHERE rn = 1""",
    "ledger_index": f"""SELECT 'evt-' || event_id AS event_id, {_OP} AS op, value,
        CASE WHEN event_id % 3 = 2 AND event_id % 5 <> 0 THEN 'b' ELSE 'a' END AS run,
        CASE WHEN event_id % 3 = 0 OR event_id % 3 = 2 AND event_id % 5 <> 0 THEN 0 ELSE 1 END::INT AS batch FROM events""",
    "current_buckets": f"""WITH {_LATEST} SELECT {_USER_KEY} AS key, op, event_id AS sequence, 'evt-' || event_id AS event_id, value,
        CASE WHEN event_id % 7 = 0 THEN 'repaired' ELSE 'validated' END AS origin FROM ranked WHERE rn = 1 AND op <> 'd'""",
    "committed_batches": f"""SELECT 'evt-' || event_id AS event_id, {_OP} AS op, {_USER_KEY} AS key,
        '{{"user_id":' || user_id || ',"value":' || value || ',"event_type":"' || event_type || '"}}' AS payload, event_id AS sequence,
        CASE WHEN event_id % 7 = 0 THEN 'rep-' || event_id END AS repair_id,
        CASE WHEN event_id % 7 = 0 THEN 'repaired' ELSE 'validated' END AS origin, event_id AS "offset", run, batch::INT AS batch
        FROM events, (VALUES ('stream', 0), ('frames', 0), ('frames', 1)) AS r(run, batch)
        WHERE run = 'stream' OR event_id % 3 = batch""",
    "versioned_rows": """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_retailprice::VARCHAR
        ELSE p_name END AS reading, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS brand, 'part-' || p_partkey AS _event_id FROM part""",
    "changelog_rows": f"""SELECT 'app' AS source, 'web' AS database, 'users' AS "table", user_id, value, event_type,
        {_OP} AS _op, event_id AS _seq, 'evt-' || event_id AS _event_id,
        CASE WHEN event_id % 7 = 0 THEN 'rep-' || event_id END AS _repair_id,
        CASE WHEN event_id % 7 = 0 THEN 'repaired' ELSE 'validated' END AS _origin, user_id AS key_user_id FROM events""",
    "routed_by_glob": f"""WITH {_GLOBS} SELECT destination, 'app.web.' || event_type AS table_ref, count(*) AS changes
        FROM routes GROUP BY ALL""",
    "dedupe_redelivered": f"""SELECT 'evt-' || event_id AS event_id, {_OP} AS op, event_id AS "offset" FROM events
        WHERE event_type <> 'error'""",
    "live_row_counts": """SELECT 'app.web.' || event_type AS table_ref,
        CASE WHEN event_type = 'error' THEN 0 ELSE count(DISTINCT user_id) END AS live_rows FROM events GROUP BY event_type""",
    "key_lookup": f"""SELECT count(*) AS changes, arg_max({_OP}, event_id) AS op, 'evt-' || max(event_id) AS event_id,
        max(event_id) AS sequence FROM events WHERE user_id = 8""",
    "source_sequences": """SELECT event_id, CASE event_id % 3
          WHEN 0 THEN ((event_id % 20000)::HUGEINT * 1000000000000000 + event_id * 1000 + user_id)::VARCHAR
          WHEN 1 THEN (event_id * 11)::VARCHAR ELSE ((event_id + 5) * 1000)::VARCHAR END AS sequence FROM events""",
    "repair_counts": f"""WITH {_FEED} SELECT CASE WHEN c = 6 THEN '.' ELSE 'inventory.' || tbl END AS source_table,
        drift AS drift_type, {_STATUS} AS status, CASE WHEN c > 5 THEN '' ELSE 'model' END AS repair_source,
        count(*) AS events FROM feed WHERE c BETWEEN 1 AND 7 GROUP BY ALL""",
    "decision_stats": f"""WITH {_FEED} SELECT {_STATUS} AS status, count(*) AS events FROM feed
        WHERE c BETWEEN 1 AND 7 GROUP BY ALL""",
    "latency_histogram": " UNION ALL ".join(
        [f"SELECT {b}::DOUBLE AS le, count(*) FILTER (value <= {b}) AS observations FROM events"
         for b in fixed.LATENCY_BUCKETS]
        + ["SELECT 'infinity'::DOUBLE AS le, count(value) AS observations FROM events"]),
    "delivery_stats": f"""WITH {_GLOBS} SELECT destination, count(*) FILTER (op = 'u') AS delivered,
        count(*) FILTER (op = 'd') AS duplicates, count(*) FILTER (op = 'c') AS skipped, 0::BIGINT AS failed_batches,
        max(epoch_us(ts) // 1000) FILTER (op = 'u') AS last_delivery FROM routes GROUP BY destination""",
    "topic_counts": """SELECT 'app.events' AS topic, (event_id % 4)::INT AS partition, min(event_id) AS low,
        max(event_id) AS high, max(event_id) - min(event_id) + 1 AS messages FROM events GROUP BY ALL""",
    "peek_last": """WITH e AS (SELECT event_id AS id, ts FROM events)
        (SELECT 'topic' AS kind, 'app.events' AS topic, (id % 4)::INT AS partition, id AS "offset", 'evt-' || id AS event_id
         FROM e ORDER BY epoch_us(ts) // 1000 DESC, id % 4 DESC, id DESC LIMIT 5)
        UNION ALL
        (SELECT 'partition', 'app.events', (id % 4)::INT, id, 'evt-' || id FROM e
         QUALIFY row_number() OVER (PARTITION BY id % 4 ORDER BY id DESC) <= 5)""",
    "find_repairs": """SELECT 'evt-' || event_id AS event_id, 'rep-' || event_id AS repair_id FROM events
        WHERE events.event_id % 7 = 0""",
    "event_traces": f"""WITH {_FEED} SELECT 'cdc.mutations/' || p_partkey % 3 || '/' || p_partkey AS dlq_coordinates,
        CASE c WHEN 6 THEN 'MALFORMED_JSON' WHEN 7 THEN 'UNKNOWN_SCHEMA' ELSE 'SCHEMA_DRIFT' END AS reason,
        CASE WHEN c > 5 THEN '' ELSE drift END AS drift_type, {_STATUS} AS repair_result, c IN (1, 2, 3) AS is_repaired,
        CASE WHEN c IN (1, 2, 3) THEN 'everything' ELSE '' END AS destinations FROM feed WHERE c BETWEEN 1 AND 7""",
    "generated_contracts": f"""WITH {_BRAND} SELECT 'brands' AS table_schema, table_name, doc AS contract_document FROM docs""",
    "contract_versions": f"""WITH {_BRAND} SELECT 'contract.x.' || table_name || '-value' AS subject,
        CASE WHEN length(doc) % 2 = 0 THEN 1 ELSE 2 END::INT AS version FROM docs""",
    "weight_kg": f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE
        round((p_size + 0.3)::DOUBLE * CASE {_pick(q.UNITS, f'p_partkey % {len(q.UNITS)}')} {_KG} END::DOUBLE, 3) END AS kg FROM part""",
    "stock_quantities": f"""SELECT p_partkey, {_quantity('p_partkey::VARCHAR')} AS quantity FROM part""",
    "mapped_rows": f"""SELECT p_partkey, substr(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), 1, 8) AS name, p_type AS kind,
        {_quantity('p_brand')} AS stock FROM part""",
    "loaded_products": """WITH fresh AS (SELECT p_name, arg_min(p_size, p_partkey) AS quantity, min(p_partkey) AS pk FROM part
          WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size <= 2) GROUP BY p_name)
        SELECT (SELECT coalesce(max(p_partkey), 0) FROM part WHERE p_size <= 2) + row_number() OVER (ORDER BY pk) AS id,
          p_name AS name, quantity FROM fresh""",
}
