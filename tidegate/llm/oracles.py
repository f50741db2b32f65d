"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS} AS w, least(len(w), 13) AS n FROM benchmark),
     wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
              FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
     places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                      FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
     found AS (SELECT r, item_id, i, n FROM places JOIN wins USING (n, win)),
     hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
     names AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
               FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""

ORACLES["op5_line_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
     l AS (SELECT r, doc_id, source, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
     n AS (SELECT source, trim(line) AS line, count(DISTINCT r) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
     t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
     b AS (SELECT n.source, n.line FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
           WHERE n.n >= 5 AND n.n > 0.02 * t.pages),
     k AS (SELECT r, i, l.line, b.line IS NOT NULL AS gone
           FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line),
     s AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                  string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY r)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN s USING (r)
"""

_SAID = r"""regexp_replace(coalesce(text, ''), '(\\*(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]))', '\\\1', 'g')"""

ORACLES["op8_chat"] = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_SAID}) + CASE role WHEN 'user' THEN 23 WHEN 'system' THEN 25 WHEN 'assistant' THEN 10
                                  ELSE 25 + length(coalesce(role, '')) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
    SELECT a.r AS ar, a.id AS anchor_id, b.r AS br, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.r <> b.r AND len(a.x) = len(b.x)
    WHERE a.id % 50 = 0
), positives AS (
    SELECT ar, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (ar, anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY ar, positive_id, positive_score ORDER BY score DESC, id, br)
QUALIFY row_number() OVER w <= 3
"""
