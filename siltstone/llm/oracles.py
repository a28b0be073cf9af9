"""The queries that SQL can express, in SQL for an independent engine."""

#: All vectors as integers, every pair of a query and another row, the best twenty.
TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score, CAST(score AS VARCHAR) AS score_text FROM r WHERE n <= 20
"""

#: Conversations as texts; one that starts another is dropped.
CHAT = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n,
         string_agg('<|im_start|>' || CASE role WHEN '' THEN 'unknown' ELSE role END || chr(10) || text || '<|im_end|>' || chr(10),
                    '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM t GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, text FROM c GROUP BY n, text)
SELECT conv_id, n AS n_turns, copies AS n_copies, text
FROM d WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.n > d.n AND starts_with(b.text, d.text))
"""

#: All pairs of documents that share a shingle, and what links reach.
NEARDUP = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 75 * (len(x.sh) + len(y.sh) - i)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON d = doc_id
"""

#: Every 50-byte string of every document, as hexadecimal text.
PASSAGES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, CAST(2 * k + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS k FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.k FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
o AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o),
c AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM i GROUP BY doc_id, run),
r AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS e FROM c GROUP BY doc_id),
x AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM c),
t AS (
  SELECT x.doc_id, string_agg(substr(d.h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (a - f) AS BIGINT)), '' ORDER BY a) || any_value(substr(d.h, CAST(2 * r.e + 1 AS BIGINT))) AS h
  FROM x JOIN d ON d.doc_id = x.doc_id JOIN r ON r.doc_id = x.doc_id GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN d.h ELSE coalesce(t.h, '') END)) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

#: All pairs of vectors of a label, and what links reach.
VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT vec_id AS d, vec_id AS c FROM embeddings UNION SELECT r.d, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT d, min(c) AS component_id FROM r GROUP BY d)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON d = vec_id LEFT JOIN n ON n.a = vec_id
"""
