"""DuckDB SQL for those queries that SQL can express: the plain definition of each result, without its operator's method."""

from __future__ import annotations

from .licenses import PHRASES
from .secrets import BASE_KINDS, RULES

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_GROUPED = """
reach(node, other) AS (
  SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a
), least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

OP2 = f"""
WITH RECURSIVE links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.93
), both_ways AS (SELECT a, b FROM links), nodes AS (SELECT vec_id AS node FROM embeddings), {_GROUPED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = node LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id
"""

OP4 = """
SELECT conv_id, count(*) AS n_messages, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_orphans, 0::BIGINT AS n_unordered, 0::BIGINT AS n_invalid,
  '[' || string_agg(to_json({'content': text, 'role': role})::VARCHAR, ',' ORDER BY turn, role, text) || ']' AS chat
FROM conversations GROUP BY conv_id
"""

OP5 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS g FROM texts
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
both_ways AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
nodes AS (SELECT doc_id AS node FROM documents), {_GROUPED}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = node LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def _found(place: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, start, start + length(m[i]) AS stop FROM (
  SELECT doc_id, i, m, v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (
    SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS v, string_split_regex(text, '{pattern}') AS g
      FROM documents WHERE regexp_matches(text, '{rule.hint}')))) WHERE length(v[i]) >= {rule.least}"""


_BASE = ", ".join(f"'{k}'" for k in BASE_KINDS)
OP6 = f"""
WITH found AS ({" UNION ALL ".join(_found(i, r) for i, r in enumerate(RULES))}
), told AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (WHERE kind IN ({_BASE})) AS base,
    {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)}
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""

OP8 = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
lines AS (SELECT doc_id, ls, i, ls[i + 1] AS line, len(regexp_extract_all(ls[i + 1], '{_WORD}')) AS w FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM split)),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines),
windows AS (
  SELECT x.doc_id, x.i AS a, y.i AS b, array_to_string(x.ls[x.i + 1:y.i + 1], chr(10)) AS content FROM summed x JOIN summed y ON x.doc_id = y.doc_id AND y.i >= x.i
  WHERE y.c - x.c + x.w >= 50 AND (y.c - y.w - x.c + x.w < 50 OR y.c - x.c < 50)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranked WHERE k > 1),
islands AS (SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island),
cut AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_lines FROM islands GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

MIX = f"""
WITH per AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::BIGINT AS s FROM documents GROUP BY source),
ranked AS (SELECT source, s, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM per),
capped AS (SELECT *, row_number() OVER (ORDER BY 2 * s / w, source) AS k FROM ranked),
levels AS (SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped),
chosen AS (SELECT arg_min(level, k) AS level FROM levels WHERE level * w <= 2 * s)
SELECT source, s AS source_size, round(least(2 * s, w * coalesce((SELECT level FROM chosen), 1e300)), 6) AS target FROM ranked
"""

_PLACES = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM words, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in PHRASES.items())
LICENSES = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS ({_PLACES}),
told AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS low, max(i) - 1 AS high, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM words w LEFT JOIN told t ON t.doc_id = w.doc_id
"""

TOOLS = """
WITH replies AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER v - 1 AS nth, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role = 'assistant' WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
calls AS (SELECT *, CASE WHEN conv_id % 3 = 1 AND turn > first THEN turn - 2 WHEN conv_id % 3 = 2 AND turn = first THEN turn + 2 END AS ref FROM replies),
placed AS (SELECT *, ref > last AS lost, CASE WHEN conv_id % 3 = 2 AND ref <= last THEN ref ELSE turn END AS pos, CASE WHEN ref > last THEN 1073741824 WHEN conv_id % 3 = 1 THEN nth WHEN ref IS NOT NULL THEN 1 ELSE 0 END AS level FROM calls),
lines AS (
  SELECT conv_id, turn AS t, 0 AS level, '' AS call, 0 AS after, -1 AS own, role, text, 'plain' AS what, false AS bad, to_json({'content': text, 'role': role})::VARCHAR AS json FROM conversations WHERE role <> 'assistant'
  UNION ALL SELECT conv_id, turn, 0, '', 0, -1, 'assistant', 'I see.', 'plain', false, '{"content":"I see.","role":"assistant"}' FROM replies
  UNION ALL SELECT conv_id, pos, level, 'c' || turn, 0, -1, 'assistant', '', CASE WHEN lost THEN 'unordered' ELSE 'call' END, conv_id % 2 = 1,
    to_json({'arguments': '{"n":' || n || coalesce(',"on":{"$ref":"c' || ref || '"}', '') || ',"z":"é"}', 'id': 'c' || turn, 'name': CASE WHEN conv_id % 2 = 0 THEN 'say' ELSE 'shout' END, 'role': 'assistant'})::VARCHAR FROM placed
  UNION ALL SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN turn ELSE pos END, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE level END, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'c' || turn END, 1, turn, 'tool', 'r' || turn, CASE WHEN conv_id % 5 = 0 THEN 'orphan' ELSE 'linked' END, false,
    to_json({'content': 'r' || turn, 'role': 'tool', 'tool_call_id': CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE 'c' END || turn})::VARCHAR FROM placed
)
SELECT conv_id, count(*) AS n_messages, count(*) FILTER (WHERE what IN ('call', 'unordered')) AS n_calls, count(*) FILTER (WHERE what = 'linked') AS n_linked, count(*) FILTER (WHERE what = 'orphan') AS n_orphans,
  count(*) FILTER (WHERE what = 'unordered') AS n_unordered, count(*) FILTER (WHERE bad) AS n_invalid, '[' || string_agg(json, ',' ORDER BY t, level, call, after, own, role, text) || ']' AS chat FROM lines GROUP BY conv_id
"""

SQL = {"mix_targets": MIX, "license_places": LICENSES, "chat_tool_calls": TOOLS, "op2_embedding_near_dedup": OP2, "op4_chat_format": OP4, "op5_minhash_near_dedup": OP5, "op6_secret_scan": OP6, "op8_line_dedup": OP8}
