"""The queries of operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from .chat_tree import OTHER, TEMPLATE

_SPACED = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_CASED = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_ALNUM = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


def _grams(words: str, n: str) -> str:
    """Runs of n words, joined by blanks, of a list; all of it as one if it is shorter, none of an empty one."""
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(len({words}) - {n} + 1), lambda i: array_to_string({words}[i + 1:i + {n}], ' ')) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


OP4 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest({_grams('w', '10')}) AS g FROM b),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS g, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, g.n, i, item FROM g JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""".strip()

#: What op5 counts, and the test that needs no rules.
QUALITY_BASE = f"""
WITH d AS (SELECT doc_id, {_CASED} AS w, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
""".strip()

_B32 = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '')"
OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages), t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t
""".strip()

_CONTROLS = ("</s>", "<<SYS>>", "<</SYS>>", "<|role:", "<|end|>", "[INST]", "[/INST]", "|>", "\\")


def _escaped(c: str) -> str:
    """Characters of an escaped text: one more for each control string and backslash."""
    return f"length({c})" + "".join(f" + (length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in _CONTROLS)


OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped('text')} + CASE role {' '.join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TEMPLATE.items())} ELSE {sum(map(len, OTHER))} + {_escaped('role')} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""".strip()

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT doc_id, list_distinct({_grams('w', '4')}) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a AS v, a AS c FROM links UNION SELECT r.v, l.b FROM r JOIN links l ON r.c = l.a),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v), k AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(k, 0) AS n_links FROM s LEFT JOIN c ON doc_id = v LEFT JOIN k ON doc_id = a
""".strip()
