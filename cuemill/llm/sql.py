"""DuckDB SQL of the operators that SQL can express over whole tables."""

_MIX = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS u FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][n % 3 + 1] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS most FROM per),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY most / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT *, CASE WHEN most >= level * w THEN (SELECT level FROM levels WHERE most >= level * w ORDER BY most / w, n LIMIT 1) * w ELSE most END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM targets),
drawn AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.base, r.target - r.base * r.source_size AS need,
  sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (base + CASE WHEN need > 0 AND before + size / 2 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn"""

_CLASSES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c WHERE 100 * shared >= 85 * (total - shared) UNION ALL SELECT y, x FROM c WHERE 100 * shared >= 85 * (total - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN m ON s.doc_id = m.doc_id"""

ORACLE_SQL = {"op9_mixing": _MIX, "op6_ngram_join": _CLASSES}
