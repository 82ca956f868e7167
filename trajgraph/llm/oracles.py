"""SQL of the queries that SQL can express, for DuckDB."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD10 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"

OP4 = f"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
n AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size, 0.5 + 0.5 * len(list_distinct(w)) / greatest(len(w), 1) AS weight,
  (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/mix'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(wt) OVER (ORDER BY cap / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM o),
f AS (SELECT *, rest / wsum AS lvl, rest / wsum * wt >= cap AS is_full FROM r),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (max(lvl) FILTER (NOT is_full) OVER ()) * wt END AS target FROM f),
b AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS epochs FROM t),
k AS (SELECT n.doc_id, n.size, b.*, target - epochs * source_size AS budget, coalesce(sum(size) OVER (PARTITION BY n.source ORDER BY pow(u, 1.0 / weight) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, pow(u, 1.0 / weight) AS key
  FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source),
c AS (SELECT *, max(CASE WHEN ahead + size / 2.0 > budget THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY key DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS over FROM k)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST((epochs + CASE WHEN over = 0 AND source_size > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE list_slice(w, i, i + 3) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.root = l.a)
SELECT r.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD10}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD10}') AS w FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, p, p + 12) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
y AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM x) z WHERE len(w) >= n)),
h AS (SELECT doc_id, item, y.n, p FROM y JOIN x ON x.n = y.n AND x.g = y.g),
m AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

OP11 = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND p.k <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP12 = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_WHOLE}),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20
"""

_RUNS = f"regexp_extract_all({_LOWER}, '{_WORD10}')"
_CRC = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

OP13 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_RUNS} AS w FROM documents), b AS (SELECT {_RUNS} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(w) AS w FROM b),
tab AS MATERIALIZED (SELECT {_CRC} AS t),
x AS MATERIALIZED (SELECT w, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda p: CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])) AS c
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)), tab),
k AS MATERIALIZED (SELECT w, (4294967295 - c) % 10000 AS bucket FROM x),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.n + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (z.n + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM k) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), (SELECT count(*)::DOUBLE AS n FROM dw) a, (SELECT count(*)::DOUBLE AS n FROM bw) z),
p AS (SELECT r, sum(gain) AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN p USING (r)),
f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM f LEFT JOIN o USING (r)
"""
