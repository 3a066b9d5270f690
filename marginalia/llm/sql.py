"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)
),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    length(regexp_replace(t, '\P{L}', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS upper,
    length(regexp_replace(t, '[^\pL\pM]', '', 'g')) AS alphas, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, len(string_split(t, chr(10))) AS lines FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 30 * n_words OR 10 * word_chars < 20 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > lines
    OR 2 * upper > letters OR 3 * bangs > n_words OR 2 * alphas < word_chars) AS kept
FROM g
"""

OP9 = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls) - 2)) AS i FROM d)),
word AS (SELECT * FROM win WHERE regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
later AS (SELECT doc_id, i FROM word QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (VALUES (0), (1), (2)) v(k)),
lines AS (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
left_over AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.i IS NULL), '') AS new, count(gone.i)::BIGINT AS n_removed
  FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, n_removed, length(new)::BIGINT AS n_chars, sha256(new) AS text_sha256 FROM left_over
"""

OP5 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS k, CASE WHEN embedding IS NULL OR len(embedding) = 0 OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) OR list_bool_and(list_transform(embedding, lambda x: x = 0)) THEN NULL
    ELSE embedding::DOUBLE[] END AS e FROM embeddings
),
link AS (SELECT a.k, b.k AS other, b.vec_id AS other_id FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(k, node) AS (SELECT k, k FROM v UNION SELECT r.k, l.other FROM reach r JOIN link l ON l.k = r.node),
least AS (SELECT r.k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.node GROUP BY r.k)
SELECT vec_id, (SELECT count(*) FROM link l WHERE l.k = v.k) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least USING (k)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
bag AS (
  SELECT k, shingle, count(*) AS c FROM (SELECT k, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS shingle FROM (SELECT k, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)) GROUP BY ALL
),
size AS (SELECT k, sum(c) AS n FROM bag GROUP BY k),
link AS (
  SELECT k, other FROM (SELECT a.k, b.k AS other, sum(least(a.c, b.c)) AS both_n FROM bag a JOIN bag b ON a.shingle = b.shingle AND a.k <> b.k GROUP BY ALL) p
  JOIN size x USING (k) JOIN size y ON y.k = p.other WHERE both_n >= 0.8 * (x.n + y.n - both_n)
),
reach(k, node) AS (SELECT k, k FROM d UNION SELECT r.k, l.other FROM reach r JOIN link l ON l.k = r.node),
class AS (SELECT r.k, min(d.doc_id) AS class_id, count(*) AS n_class FROM reach r JOIN d ON d.k = r.node GROUP BY r.k)
SELECT doc_id, class_id, n_class, doc_id = class_id AS kept FROM d JOIN class USING (k)
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
),
s AS (SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
t AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM t WHERE rank <= 20
"""

OP13 = r"""
WITH RECURSIVE step(i, r, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, r + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE r < 8
),
crc AS (SELECT list(c ORDER BY i) AS k FROM step WHERE r = 8),
d AS (SELECT 0 AS kind, doc_id, row_number() OVER () AS n, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, n, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d),
h AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
b AS (
  SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, x: xor(k[(xor(a, x) & 255) + 1], a >> 8))) % 10000 AS bucket
  FROM h, crc
),
f AS (SELECT kind, n, bucket FROM w JOIN b USING (word)),
c AS (SELECT i AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(i) LEFT JOIN (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM f GROUP BY bucket) ON bucket = i),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
x AS (SELECT n, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY n),
y AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN x USING (n) WHERE kind = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= floor(10 * able / 100) THEN k END AS rank FROM r
"""

SQL = {"op1_quality_rules": OP1, "op5_embedding_near_dedup": OP5, "op7_minhash_near_dedup": OP7, "op9_line_dedup": OP9, "op11_exact_topk": OP11, "op13_importance_resampling": OP13}
