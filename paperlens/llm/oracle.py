"""DuckDB SQL of the corpus queries, written from their contracts."""

from paperlens.llm import quality

STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

QUALITY = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    row_number() OVER () AS r
  FROM documents),
win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1)
  GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•‣●]\\s'))) AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({STOP}))) AS n_stop_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words OR 100 * n_symbols > 25 * n_words
    OR 100 * n_stop_words < 5 * n_words OR 100 * n_letter_words < 60 * n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * n_bullet_lines > 90 * n_lines OR 100 * n_ellipsis_lines > 40 * n_lines) AS kept
FROM m
"""

DECONTAMINATION = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS s
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hit AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, s)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
it AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS k FROM hit) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""

MIXING = """
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s GROUP BY source),
lv AS (
  SELECT source, source_size, w, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
    sum(source_size) OVER () AS total FROM src),
t AS (
  SELECT source, source_size, total, least(cap::DOUBLE, max((total - full_before)::DOUBLE / weight_from) OVER () * w) AS target FROM lv),
q AS (
  SELECT s.doc_id, s.source, s.size, s.k, t.source_size, t.target, t.total, row_number() OVER () AS r,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (upto + e * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0),
g AS (SELECT r, sum(size) OVER (ORDER BY finish, k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= total AS took, size FROM e)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN (SELECT r, sum(size) AS taken FROM g WHERE took GROUP BY r) x USING (r)
"""

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT r, doc_id, i - 1 AS pos, ls[i] AS s, length(ls[i]) AS n
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d) WHERE regexp_matches(ls[i], '[^\\x20\\x09-\\x0D]')),
u AS (SELECT s, n, min({'k': doc_id IS NULL, 'd': doc_id, 'a': pos}) AS p FROM l GROUP BY s, n),
k AS (
  SELECT s, n, p, m, side, CASE side WHEN 1 THEN left(s, m // 2) ELSE right(s, m - m // 2) END AS half
  FROM (SELECT s, n, p, unnest([n, n - 1]) AS m FROM u WHERE n >= 20), (VALUES (1), (2)) v(side)),
c AS (
  SELECT DISTINCT a.s AS s, b.s AS t FROM k a JOIN k b USING (m, side, half)
  WHERE a.p > b.p AND a.s <> b.s AND abs(a.n - b.n) <= 1),
e AS (
  SELECT DISTINCT s FROM (
    SELECT s, greatest(length(s), length(t)) AS n,
      list_max(list_filter(range(0, least(length(s), length(t)) + 1), lambda i: left(s, i) = left(t, i))) AS pre,
      list_max(list_filter(range(0, least(length(s), length(t)) + 1), lambda i: right(s, i) = right(t, i))) AS post FROM c)
  WHERE pre + post >= n - 1),
keep AS (SELECT l.r, l.pos FROM l JOIN u USING (s) WHERE l.doc_id IS NOT DISTINCT FROM u.p.d AND l.pos = u.p.a AND l.s NOT IN (SELECT s FROM e)),
n AS (SELECT r, count(*) AS n_lines FROM l GROUP BY r),
kn AS (SELECT r, count(*) AS n_kept, list(pos) AS ats FROM keep GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept,
  md5(CASE WHEN coalesce(n_kept, 0) = coalesce(n_lines, 0) THEN text WHEN coalesce(n_kept, 0) = 0 THEN ''
    ELSE array_to_string(list_filter(ls, lambda x, i: NOT regexp_matches(x, '[^\\x20\\x09-\\x0D]') OR list_contains(ats, i - 1)), chr(10)) END) AS text_md5
FROM d LEFT JOIN n USING (r) LEFT JOIN kn USING (r)
"""

ARCHIVES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT page_id, h, n, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM q
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id NULLS LAST)
QUALIFY row_number() OVER best <= 10
"""
