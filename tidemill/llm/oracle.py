"""DuckDB SQL for those queries of the training-data operators that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(generate_series(1, greatest(1, len(w) - 12))) AS t(i) WHERE len(w) > 0),
m AS (
  SELECT d.r, p.i, k.n, g.item
  FROM d, (SELECT DISTINCT n FROM g) k, unnest(generate_series(1, len(d.w) - k.n + 1)) AS p(i), g
  WHERE g.n = k.n AND g.gram = array_to_string(d.w[p.i:p.i + k.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT q.j) AS n_hit FROM m, unnest(generate_series(m.i, m.i + m.n - 1)) AS q(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) AS m
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + m + 24) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant'
                     WHEN before = 'assistant' THEN role IN ('user', 'tool')
                     WHEN before = 'tool' THEN role = 'assistant' ELSE false END
                AND (back > 1 OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i)),
m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, j FROM g JOIN m USING (h), unnest(generate_series(i, i + 34)) AS t(j)),
k AS (SELECT r, list(j) AS gone, count(*) AS n FROM c GROUP BY r),
x AS (
  SELECT d.r, count(*) FILTER (c.j IS NULL) AS n, string_agg(d.w[p.i], ' ' ORDER BY p.i) FILTER (c.j IS NULL) AS kept
  FROM d CROSS JOIN unnest(generate_series(1, len(d.w))) AS p(i) LEFT JOIN c ON c.r = d.r AND c.j = p.i GROUP BY d.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(x.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN x USING (r)
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 10 * length(x) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN g USING (doc_id)),
n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM n a, n b, n c, n d, n e
  WHERE a.c <> b.c AND a.c <> c.c AND a.c <> d.c AND a.c <> e.c AND b.c <> c.c AND b.c <> d.c AND b.c <> e.c AND c.c <> d.c AND c.c <> e.c AND d.c <> e.c),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS mine, filter_order[:k - 1] AS before FROM o, unnest(generate_series(1, 5)) AS t(k)),
u AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
r AS (
  SELECT part, filter_order, step, mine,
         coalesce(sum(n) FILTER (NOT contains(fails, mine) AND translate(fails, before, '') = fails), 0) AS kept,
         coalesce(sum(n) FILTER (contains(fails, mine) AND translate(fails, before, '') = fails), 0) AS removed,
         coalesce(sum(n) FILTER (contains(fails, mine) AND translate(fails, before, '') <> fails), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = mine), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(fails, mine) AND translate(fails, before, '') = fails), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(fails, mine) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM u, s GROUP BY part, filter_order, step, mine)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
FROM r
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, v, total, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS mine
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 2) // (mine + 2 * v) AS HUGEINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (lang_n + 2) // (total + 2 * v) AS HUGEINT) AS q
  FROM f),
a AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(a.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (
  SELECT r, doc_id, t.i, a[t.i] AS line,
         translate(trim(a[t.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(generate_series(1, len(a))) AS t(i)),
h AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3),
m AS (SELECT l.*, h.k IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS gone FROM l LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

ORACLES = {"op11_filter_audit": OP11, "op12_source_divergence": OP12, "op13_line_dedup": OP13, "op8_substrings": OP8, "op1_decontaminate": OP1, "op3_chat": OP3}
