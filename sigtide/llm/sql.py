"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from sigtide.llm import decontam, urls

_LOWER = f"translate(coalesce({{0}}, ''), '{decontam._UPPER}', '{decontam._LOWER}')"
_WORDS = (f"list_filter(regexp_split_to_array({_LOWER}, '{decontam._BREAK}+'), lambda x: x <> '')")


def _words(column: str) -> str:
    return _WORDS.format(column)


def _components(pairs: str, nodes: str) -> str:
    """CTE bodies (reach, component) over pairs (a, b) in both directions and nodes (id)."""
    return f"""
reach(a, b) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT r.a, p.b FROM reach r JOIN {pairs} p ON r.b = p.a
),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


NEAR_DEDUP = f"""
WITH RECURSIVE
nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM nodes
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT x.id AS a, y.id AS b FROM usable x JOIN usable y ON x.id <> y.id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),
{_components('pairs', 'nodes')}
SELECT c.id AS vec_id, count(p.b) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM component c LEFT JOIN pairs p ON p.a = c.id
GROUP BY c.id, c.component_id
"""

JACCARD_JOIN = f"""
WITH RECURSIVE
nodes AS (SELECT doc_id AS id, {_words('text')} AS w FROM documents),
shingle AS (
  SELECT DISTINCT id, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM (SELECT id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM nodes WHERE len(w) > 0)
),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
common AS (
  SELECT x.id AS a, y.id AS b, count(*) AS n
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id
),
pairs AS (
  SELECT c.a, c.b FROM common c JOIN size x ON x.id = c.a JOIN size y ON y.id = c.b
  WHERE c.n * 5 >= 4 * (x.n + y.n - c.n)
),
{_components('pairs', 'nodes')},
class AS (
  SELECT id, CASE WHEN len(w) = 0 THEN id ELSE min(id) OVER (PARTITION BY w) END AS class_id
  FROM nodes
)
SELECT c.id AS doc_id, k.class_id, c.component_id, count(p.b) AS n_links,
       c.id = c.component_id AS kept
FROM component c JOIN class k ON k.id = c.id LEFT JOIN pairs p ON p.a = c.id
GROUP BY c.id, k.class_id, c.component_id
"""

TOOL_CALLS = """
WITH RECURSIVE
calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn,
         ['search', 'lookup', 'note'][length(text) % 3 + 1] AS name, length(text) % 60 AS lim,
         CASE WHEN turn = 0 THEN []
              WHEN turn // 2 = turn // 3 THEN ['call_' || (turn // 2)]
              ELSE ['call_' || (turn // 2), 'call_' || (turn // 3)] END AS needs, text
  FROM conversations WHERE role = 'user'
),
results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn AS result_turn, text AS content
  FROM conversations WHERE role = 'assistant'
),
needed AS (
  SELECT conv_id, call_id, need FROM (SELECT conv_id, call_id, unnest(needs) AS need FROM calls)
  WHERE need <> call_id
),
edges AS (
  SELECT n.* FROM needed n SEMI JOIN calls c ON c.conv_id = n.conv_id AND c.call_id = n.need
),
dangling AS (
  SELECT DISTINCT conv_id, call_id FROM needed n
  ANTI JOIN calls c ON c.conv_id = n.conv_id AND c.call_id = n.need
),
walk AS (
  SELECT conv_id, call_id, 0 AS level FROM calls
  UNION
  SELECT e.conv_id, e.call_id, w.level + 1
  FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.need = w.call_id
),
ranked AS (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY conv_id, call_id),
wrong AS (
  SELECT c.conv_id, c.call_id, array_to_string(list_filter([
    CASE WHEN name = 'search' AND lim > 40 THEN 'limit is above 40' END,
    CASE WHEN name = 'search' AND lim < 1 THEN 'limit is below 1' END,
    CASE WHEN d.call_id IS NOT NULL THEN 'unknown need' END], lambda x: x IS NOT NULL), ', ') AS errors
  FROM calls c LEFT JOIN dangling d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
       c.turn, c.name, CAST(k.level AS BIGINT) AS level,
       CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results, r.result_turn, w.errors,
       w.errors = '' AS valid,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered'
            ELSE 'linked' END AS status,
       CASE WHEN c.call_id IS NOT NULL THEN
         '{"arguments":{"after":[' ||
         array_to_string(list_transform(c.needs, lambda x: '"' || x || '"'), ',') || ']' ||
         CASE WHEN c.name <> 'note' THEN ',"limit":' || c.lim ELSE '' END ||
         ',"text":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":"' || c.call_id ||
         '","name":"' || c.name || '"' ||
         CASE WHEN r.content IS NOT NULL THEN ',"result":' || CAST(to_json(r.content) AS VARCHAR)
              ELSE '' END || '}' END AS canonical
FROM calls c FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
LEFT JOIN ranked k ON k.conv_id = c.conv_id AND k.call_id = c.call_id
LEFT JOIN wrong w ON w.conv_id = c.conv_id AND w.call_id = c.call_id
"""

DECONTAMINATION = f"""
WITH
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS size,
               unnest(range(greatest(0, len(w) - 9) + CAST(len(w) BETWEEN 1 AND 9 AS INT))) AS i
        FROM b)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i
        FROM d CROSS JOIN sizes)
),
found AS (SELECT p.doc_id, p.i, p.size, x.item FROM places p JOIN windows x
          ON x.s = p.s AND x.size = p.size),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _url_filter() -> str:
    longest = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, act)
            for act, h, p in longest]
    rule = " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits)
    action = " ".join(f"WHEN {f} THEN '{act}'" for f, _, act in fits)
    return f"""
WITH
parsed AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{decontam._UPPER}',
                       '{decontam._LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1),
      '(?:^|&){urls.TRACKING}=[^&]*', '', 'g'), '^&+', '') AS query
  FROM pages
),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') ||
    regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS canonical
  FROM parsed
),
listed AS (
  SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical
  HAVING bool_or(regexp_matches(host, '{urls.SPAM_HOST}')) OR min(url) <> max(url)
),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {action} END AS action FROM named)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN listed l ON l.canonical = r.canonical
"""


FILTER_AUDIT = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
),
worded AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM base
),
least AS (SELECT t, min(doc_id) AS least FROM base GROUP BY t),
marks AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
flag AS (
  SELECT x.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, map {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * length(regexp_replace(x.t, '[^A-Z]', '', 'g')) > 3 * length(x.t),
    'D': regexp_matches(x.t, '[#$%&*|]'),
    'E': coalesce(x.doc_id > l.least, false)} AS fails
  FROM worded x JOIN least l ON l.t = x.t LEFT JOIN marks m ON m.doc_id = x.doc_id
),
letter(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a JOIN letter b ON b.f <> a.f JOIN letter c ON c.f NOT IN (a.f, b.f)
  JOIN letter d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, list_filter(['A', 'B', 'C', 'D', 'E'],
    lambda x: contains(filter_order[1:step - 1], x)) AS before
  FROM orders, unnest(range(1, 6)) AS s(step)
),
kinds AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY part, fails
),
choice AS (SELECT DISTINCT f, before FROM steps),
sums AS (
  SELECT k.part, c.f, c.before,
    sum(n) FILTER (NOT now AND NOT earlier) AS kept, sum(n) FILTER (now AND NOT earlier) AS removed,
    sum(n) FILTER (now AND earlier) AS redundant, sum(n) FILTER (now AND total = 1) AS unique_fails,
    sum(good) FILTER (now AND NOT earlier) AS good_lost,
    sum(toxic) FILTER (now AND NOT earlier) AS toxic_lost
  FROM kinds k, choice c, LATERAL (SELECT k.fails[c.f] AS now,
    len(list_filter(c.before, lambda x: k.fails[x])) > 0 AS earlier,
    len(list_filter(map_values(k.fails), lambda x: x)) AS total) z
  GROUP BY k.part, c.f, c.before
),
shapley AS (
  SELECT x.part, x.f, sum(x.removed) AS shapley
  FROM sums x JOIN steps s ON s.f = x.f AND s.before = x.before GROUP BY x.part, x.f
)
SELECT x.part, s.filter_order, s.step::int AS step, coalesce(x.kept, 0)::bigint AS kept,
  coalesce(x.removed, 0)::bigint AS removed, coalesce(x.redundant, 0)::bigint AS redundant,
  coalesce(x.unique_fails, 0)::bigint AS unique_fails, coalesce(x.good_lost, 0)::bigint AS good_lost,
  coalesce(x.toxic_lost, 0)::bigint AS toxic_lost, coalesce(y.shapley, 0)::bigint AS shapley
FROM sums x JOIN steps s ON s.f = x.f AND s.before = x.before
JOIN shapley y ON y.part = x.part AND y.f = x.f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": NEAR_DEDUP,
        "op2_ngram_jaccard_join": JACCARD_JOIN,
        "op3_tool_call_linking": TOOL_CALLS,
        "op5_benchmark_decontamination": DECONTAMINATION,
        "op7_url_filter": _url_filter(),
        "op13_filter_interactions": FILTER_AUDIT,
    }
