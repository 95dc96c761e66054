"""SQL twins of the queries."""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffle
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (
  SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0) AS HUGEINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS HUGEINT) AS open,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT coalesce(max(place), 0) AS n FROM o WHERE weight * rest >= 4 * source_size * open),
t AS (
  SELECT o.source, source_size, CASE WHEN place <= n THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (SELECT rest FROM o AS x WHERE x.place = n + 1) AS DOUBLE) / CAST(2 * (SELECT open FROM o AS x WHERE x.place = n + 1) AS DOUBLE) END AS target
  FROM o, c),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS words,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size
    + greatest(0, least(start + size, words % source_size) - start) END AS taken
FROM p
"""

LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id < largest AS dropped FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'),
    '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS escaped,
    coalesce(lag(role) OVER o = role, false) AS joined
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN joined THEN 8 ELSE 8 + length(role) + 8 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

PHRASES_SQL = r"""
WITH RECURSIVE b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.phrase = p.phrase),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS shingle FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""

NEAREST_SQL = r"""
WITH e AS (SELECT vec_id, [x > 0 FOR x IN embedding] AS bits FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, CAST(list_sum([CAST(p[1] <> p[2] AS INT) FOR p IN list_zip(q.bits, e.bits)]) AS BIGINT) AS distance
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS place FROM d) WHERE place <= 10
"""

DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS BIGINT) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
s AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1) // (total + v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (lang_n + 1) // (lang_total + v) AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT x.lang, x.source, y.source AS item FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM s AS x JOIN s AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM s WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""

MANIFEST_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS b,
    coalesce(strlen(lang) || ':' || lang, '-') AS c, coalesce(strlen(text) || ':' || text, '-') AS e,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) AS crc
  FROM documents),
h AS (
  SELECT doc_id, lang, sha256(a || b || c || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || e) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(a || b || c || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || e) END AS claim
  FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM h),
nodes(level, lang, pos, total, node) AS (
  SELECT 0, lang, pos, total, leaf FROM l
  UNION ALL SELECT level + 1, lang, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE total > 1 GROUP BY level, lang, pos // 2, total),
subs AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM nodes WHERE total = 1),
tops(level, pos, total, node) AS (
  SELECT 0, place, langs, subroot FROM subs
  UNION ALL SELECT level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE total > 1 GROUP BY level, pos // 2, total),
top AS (SELECT level AS height, node AS root FROM tops WHERE total = 1),
steps AS (
  SELECT lang, pos AS own, level AS step, pos >> level AS seat FROM (SELECT l.lang, l.pos, unnest(range(0, height)) AS level FROM l JOIN subs ON l.lang IS NOT DISTINCT FROM subs.lang)),
low AS (
  SELECT s.lang, s.own, s.step, s.seat, coalesce(n.node, '') AS beside FROM steps AS s
  LEFT JOIN nodes AS n ON n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.step AND n.pos = xor(s.seat, 1)),
high AS (
  SELECT s.lang, s.height + s.level AS step, s.seat, coalesce(t.node, '') AS beside
  FROM (SELECT lang, subs.height, unnest(range(0, top.height)) AS level, place >> unnest(range(0, top.height)) AS seat FROM subs, top) AS s
  LEFT JOIN tops AS t ON t.level = s.level AND t.pos = xor(s.seat, 1)),
ways AS (
  SELECT l.lang, l.pos, list(struct_pack(seat := w.seat, beside := w.beside) ORDER BY step) AS way
  FROM l JOIN (SELECT lang, own, step, seat, beside FROM low UNION ALL SELECT lang, NULL, step, seat, beside FROM high) AS w
    ON l.lang IS NOT DISTINCT FROM w.lang AND (w.own IS NULL OR w.own = l.pos) GROUP BY l.lang, l.pos),
folds(lang, pos, step, way, node) AS (
  SELECT l.lang, l.pos, 0, coalesce(way, []), coalesce(claim, leaf) FROM l LEFT JOIN ways ON l.lang IS NOT DISTINCT FROM ways.lang AND l.pos = ways.pos
  UNION ALL SELECT lang, pos, step + 1, way, CASE WHEN way[step + 1].seat % 2 = 1 THEN sha256(way[step + 1].beside || node) ELSE sha256(node || way[step + 1].beside) END
    FROM folds WHERE step < len(way))
SELECT l.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x.beside), '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM l JOIN folds AS f ON l.lang IS NOT DISTINCT FROM f.lang AND l.pos = f.pos AND f.step = len(f.way) JOIN subs ON subs.lang IS NOT DISTINCT FROM l.lang, top
"""
