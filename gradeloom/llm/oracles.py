"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, {WS}), '{UPPER}', '{LOWER}') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT a.doc_id, a.line, a.pos, hot.k IS NOT NULL AND a.doc_id <> hot.last AS gone FROM keyed a LEFT JOIN hot ON a.k = hot.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SAID = "<|im_end|><|im_start|>assistant ok"
_ROLE = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
CHAT = f"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '{SAID}' UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '{SAID}'),
sized AS (SELECT *, 12 + length({_ROLE}) + 1 + length(regexp_replace(text, '<(!*)\\|im_', '<!\\1|im_', 'g')) + 11 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_FILL = """
g{k} AS (SELECT source, any_value(extra) - coalesce(sum(size) FILTER (WHERE more), 0) AS gap FROM m{k} GROUP BY source),
f{k} AS (SELECT m.*, g.gap, CASE WHEN NOT more AND extra > 0 AND size <= gap THEN size ELSE 0 END AS fit FROM m{k} m JOIN g{k} g ON m.source IS NOT DISTINCT FROM g.source),
m{n} AS (SELECT doc_id, size, source, source_size, target, base, extra, h,
           more OR (fit > 0 AND sum(fit) OVER (PARTITION BY source ORDER BY h, doc_id, size) <= gap) AS more FROM f{k}),"""
MIX = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
sized AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM docs GROUP BY source),
ranked AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sized),
levels(step, level) AS (
  SELECT 0, (SELECT sum(n) / sum(w) FROM ranked)
  UNION ALL
  SELECT step + 1, (SELECT (sum(n) - 3 * coalesce(sum(n) FILTER (WHERE w * level > 3 * n), 0)) / sum(w) FILTER (WHERE w * level <= 3 * n) FROM ranked) FROM levels WHERE step < 40),
plan AS (SELECT source, n, least(w * (SELECT max(level) FROM levels), 3 * n) AS target FROM ranked),
rated AS (SELECT source, CAST(n AS BIGINT) AS source_size, target, CASE WHEN n > 0 THEN CAST(floor(round(target / n, 9)) AS BIGINT) ELSE 0 END AS base FROM plan),
m0 AS (SELECT d.doc_id, d.size, d.source, r.source_size, r.target, r.base, r.target - r.base * r.source_size AS extra, d.h, false AS more FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
{"".join(_FILL.format(k=k, n=k + 1) for k in range(6))}
gap AS (SELECT source, any_value(extra) - coalesce(sum(size) FILTER (WHERE more), 0) AS gap FROM m6 GROUP BY source),
last AS (SELECT m.source, min(struct_pack(size := m.size, h := m.h, doc_id := m.doc_id)) AS pick, any_value(gap.gap) AS gap
         FROM m6 m JOIN gap ON m.source IS NOT DISTINCT FROM gap.source WHERE NOT more AND size > 0 AND extra > 0 GROUP BY m.source)
SELECT m.doc_id, CAST(m.size AS BIGINT) AS size, m.source_size, m.target,
       CAST(CASE WHEN m.size > 0 THEN m.base + CASE WHEN m.more OR (l.pick.size < 2 * l.gap AND l.pick.h = m.h AND l.pick.doc_id = m.doc_id AND l.pick.size = m.size) THEN 1 ELSE 0 END ELSE 0 END * m.size AS BIGINT) AS taken
FROM m6 m LEFT JOIN last l ON m.source IS NOT DISTINCT FROM l.source
"""

ORACLES = {"op6_mixing": MIX, "op7_chat_format": CHAT, "op9_line_dedup": LINES}
