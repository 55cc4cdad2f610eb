"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Matches with what lies before each: their lengths add up to places.
OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT * FROM (VALUES
  (0, 'assign', '(?s)(.*?)(([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 6),
  (1, 'access', '(?s)(.*?)(()(AKIA[A-Z0-9]+))', 20),
  (2, 'hex', '(?s)(.*?)(()([0-9a-f]{24,}))', 24)) AS p(k, kind, re, least)),
m AS (SELECT doc_id, k, kind, least, regexp_extract_all(text, re, 1) AS pre, regexp_extract_all(text, re, 2) AS hit, regexp_extract_all(text, re, 4) AS val FROM t, p),
f AS (SELECT doc_id, k, kind, least, pre, hit, val, unnest(generate_series(1, len(hit))) AS i FROM m WHERE len(hit) > 0),
s AS (
  SELECT doc_id, k, kind, length(array_to_string(pre[1 : i], '')) + length(array_to_string(hit[1 : i - 1], '')) AS a, length(hit[i]) AS n
  FROM f WHERE length(val[i]) >= least),
g AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans
  FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS a
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.a AS DOUBLE[]), CAST(c.a AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.a) = len(c.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos FROM d),
p AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY lines[pos], lines[pos + 1] ORDER BY doc_id, pos) AS nth FROM l WHERE pos < len(lines)),
one AS (SELECT doc_id, pos, lines, row_number() OVER (PARTITION BY lines[pos] ORDER BY doc_id, pos) AS nth FROM l),
single AS (
  SELECT doc_id, pos FROM one
  WHERE nth > 1 AND lines[pos] <> '' AND (len(lines) = 1 OR length(lines[pos]) - length(replace(lines[pos], ' ', '')) + 1 >= 50)),
hit AS (SELECT doc_id, unnest([pos, pos + 1]) AS pos FROM p WHERE nth > 1 UNION SELECT doc_id, pos FROM single),
m AS (SELECT l.doc_id, l.pos, l.lines[l.pos] AS line, hit.pos IS NOT NULL AS gone FROM l LEFT JOIN hit ON hit.doc_id = l.doc_id AND hit.pos = l.pos),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM m),
eq AS (SELECT a.doc_id AS d1, a.pos AS p1, b.doc_id AS d2, b.pos - a.pos AS shift FROM m a JOIN m b ON a.line = b.line AND (a.doc_id <> b.doc_id OR a.pos <> b.pos)),
diag AS (SELECT d1, d2, shift, p1 - row_number() OVER (PARTITION BY d1, d2, shift ORDER BY p1) AS island FROM eq),
far AS (SELECT d1 AS doc_id, max(n) AS longest FROM (SELECT d1, count(*) AS n FROM diag GROUP BY d1, d2, shift, island) GROUP BY d1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs, coalesce(any_value(longest), 0) AS longest_run,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM e LEFT JOIN far USING (doc_id) GROUP BY doc_id
"""

OP7 = f"""
WITH b AS (SELECT item_id, {WORDS7} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS7} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, spot.n, item_id FROM spot JOIN win ON spot.n = win.n AND spot.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS8} AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i : i + 2], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id, doc_id AS to_ FROM documents UNION SELECT reach.doc_id, edge.v FROM reach JOIN edge ON edge.u = reach.to_),
low AS (SELECT doc_id, min(to_) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM low LEFT JOIN n USING (doc_id)
"""

# Bytes as two hexadecimal digits each.
OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS i FROM d WHERE length(h) >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM late),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM e) GROUP BY doc_id, r),
n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, count(*) AS n, sum(size) AS source_size FROM d GROUP BY source),
wt AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM src),
cap AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM wt),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM cap),
fix AS (SELECT arg_min(level, ratio) AS level FROM lev WHERE level <= ratio),
goal AS (
  SELECT source, n, CAST(source_size AS BIGINT) AS source_size, coalesce(least(cap, weight * fix.level), cap) AS target FROM lev LEFT JOIN fix ON true),
c AS (
  SELECT source, length(bin(size)) AS digits, CAST(sum(size) AS DOUBLE) AS words FROM d WHERE size > 0 GROUP BY ALL),
l0 AS (
  SELECT c.*, (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(words * digits) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c JOIN goal ON goal.source IS NOT DISTINCT FROM c.source),
l1 AS (SELECT source, arg_max(level, digits) FILTER (level * digits <= 3) AS level FROM l0 GROUP BY source),
x AS (
  SELECT c.source, c.digits, least(3.0::DOUBLE, coalesce(level, 3.0::DOUBLE) * c.digits) AS number
  FROM c JOIN l1 ON l1.source IS NOT DISTINCT FROM c.source),
e AS (
  SELECT source, digits, floor(k) AS whole, k - floor(k) AS p
  FROM (SELECT source, digits, CASE WHEN abs(number - round(number)) < 1e-9 THEN round(number) ELSE number END AS k FROM x)),
r AS (
  SELECT d.*, g.n, g.source_size, g.target, coalesce(e.whole, 0) AS whole, coalesce(e.p, 0) AS p, (h + 0.5::DOUBLE) / 4503599627370496 AS u, d.size * g.n > g.source_size AS long_
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
  LEFT JOIN e ON d.size > 0 AND e.source IS NOT DISTINCT FROM d.source AND e.digits = length(bin(d.size))),
q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM r WHERE p > 0),
o AS (SELECT *, floor(q / (1 + q) * 4503599627370496) AS rank FROM q),
l AS (
  SELECT *, sum(size * p) OVER (PARTITION BY source) AS goal,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM o WHERE long_),
lp AS (SELECT *, before + size / 2.0::DOUBLE <= goal AS picked FROM l),
hope AS (SELECT source, sum(size * p) AS goal FROM o GROUP BY source),
got AS (SELECT source, sum(size) FILTER (picked) AS got FROM lp GROUP BY source),
s AS (
  SELECT o.*, hope.goal - coalesce(got, 0) AS goal,
         coalesce(sum(size) OVER (PARTITION BY o.source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM o JOIN hope ON hope.source IS NOT DISTINCT FROM o.source LEFT JOIN got ON got.source IS NOT DISTINCT FROM o.source WHERE NOT long_),
pick AS (SELECT doc_id FROM lp WHERE picked UNION ALL SELECT doc_id FROM s WHERE before + size / 2.0::DOUBLE <= goal)
SELECT r.doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST((whole + CASE WHEN pick.doc_id IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r LEFT JOIN pick ON pick.doc_id = r.doc_id
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
n AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (
  SELECT doc_id, text, n, form, array_to_string(u[1 : least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1 : greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1 :], '') AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

OP12 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
d AS (
  SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 10 * length(t.text))::INT
         + 8 * regexp_matches(t.text, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > first, false)::INT AS mask, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM t JOIN f ON f.text = t.text LEFT JOIN labels l ON l.doc_id = t.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM d GROUP BY ALL),
o AS (
  SELECT '' AS name, 0 AS len
  UNION ALL SELECT name || x, len + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE len < 5 AND NOT contains(name, x)),
s AS (
  SELECT name, step, 1 << (ascii(name[step]) - 65) AS bit,
         list_sum(list_transform(string_split(name[1 : step], ''), lambda c: 1 << (ascii(c) - 65)))::BIGINT AS upto
  FROM o, (SELECT unnest(generate_series(1, 5))::INT AS step) WHERE len = 5),
r AS (
  SELECT part, name AS filter_order, step, bit,
         sum(n) FILTER (mask & upto = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & (upto - bit) = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & (upto - bit) > 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit > 0 AND mask & (upto - bit) = 0) AS good_lost, sum(bad) FILTER (mask & bit > 0 AND mask & (upto - bit) = 0) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""

OP13 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS a FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT x.vec_id AS u, y.vec_id AS w FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.a) = len(y.a)
  WHERE list_inner_product(x.a, y.a) / (sqrt(list_inner_product(x.a, x.a)) * sqrt(list_inner_product(y.a, y.a))) >= 0.98::DOUBLE),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM r JOIN l ON l.u = r.w),
c AS (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLES = {"op1_secrets": OP1, "op4_topk": OP4, "op5_linedup": OP5, "op7_decontaminate": OP7, "op8_minhash": OP8, "op9_suffix": OP9, "op10_mix": OP10, "op11_fim": OP11, "op12_filters": OP12, "op13_embdedup": OP13}
