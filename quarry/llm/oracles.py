"""DuckDB SQL for the queries that SQL can express on whole tables."""

#: Blanks of a line, and letters lower-cased.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
d AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT d.v, c.root FROM c JOIN d ON d.u = c.doc_id)
SELECT documents.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c.root) AS component_id
FROM documents JOIN c ON c.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY documents.doc_id"""

DECONTAMINATION = f"""
WITH rule AS (SELECT '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+' AS r),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), (SELECT r FROM rule)) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), (SELECT r FROM rule)) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, unnest([array_to_string(w[i:i+least(len(w), 13)-1], ' ') FOR i IN range(1, len(w) - least(len(w), 13) + 2)]) AS g FROM b WHERE len(w) > 0),
x AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS pos, unnest([array_to_string(w[i:i+m-1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS g
      FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT doc_id, pos, p.m, item_id FROM x JOIN p ON p.g = x.g AND p.m = x.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

TOP_K = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES = {"op1_exact_top_k": TOP_K, "op4_ngram_jaccard_join": JACCARD, "op6_line_dedup": LINE_DEDUP, "op8_benchmark_decontamination": DECONTAMINATION}
