"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, ws[p : p + least(13, len(ws)) - 1] AS w
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, ws[p : p + n - 1] AS w FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, bw.item_id, dw.p, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP4 = r"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM z GROUP BY source),
b AS (SELECT *, 3 * source_size AS bound, sum(source_size) OVER () AS total FROM t),
l AS (SELECT *, (total - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM b WINDOW o AS (ORDER BY bound / w, source NULLS LAST)),
s AS (SELECT source, source_size, coalesce(least(bound::DOUBLE, w * (SELECT arg_min(level, bound / w) FROM l WHERE level * w <= bound)), 0.0) AS target FROM l),
q AS (SELECT z.*, source_size, target, sum(size) OVER (PARTITION BY z.source ORDER BY k) AS sent FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
r AS (SELECT q.*, e, (e * source_size + sent) / target AS finish FROM q, (SELECT unnest(range(3)) AS e) WHERE target > 0 AND e * source_size < target),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, k) AS spent FROM r),
n AS (SELECT doc_id, count(*) AS times FROM g WHERE spent <= (SELECT sum(size) FROM z) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (coalesce(times, 0) * q.size)::BIGINT AS taken FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""

_ESCAPED = r"replace(replace(replace(replace({}, '\', '\\'), '#', '\#'), ':', '\:'), '</turn>', '\</turn>')"
_OP5 = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 14)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, least(len(ls), 3) AS n, p, ls[p : p + least(len(ls), 3) - 1] AS x FROM (SELECT doc_id, ls, unnest(range(1, greatest(len(ls) - 3, 0) + 2)) AS p FROM d WHERE text IS NOT NULL)),
r AS (SELECT doc_id, n, p FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM r)),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS q FROM d WHERE text IS NOT NULL),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.q) AS kept FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.q = c.q WHERE c.q IS NULL GROUP BY l.doc_id),
m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(m.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[p : p + 4] AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT g.b, r.c FROM r JOIN g ON r.doc_id = g.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op3_decontaminate": _OP3, "op4_mix": _OP4, "op5_chat": _OP5, "op6_line_dedup": _OP6, "op9_near_duplicates": _OP9}
