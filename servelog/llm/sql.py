"""DuckDB SQL for the rows of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Components by repeated minimum over at most a handful of hops at test size.
_COMPONENTS = """
reach(id, seen) AS (
  SELECT a, a FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
least AS (SELECT id, min(seen) AS m FROM reach GROUP BY id)"""

MINHASH = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingles),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS c
  FROM each p JOIN each q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
{_COMPONENTS}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(m, s.doc_id) AS component_id,
  coalesce(m, s.doc_id) = s.doc_id AS kept
FROM shingles s LEFT JOIN least ON least.id = s.doc_id"""

VECTORS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q
    ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_dot_product(p.v, q.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v))) >= 0.98),
{_COMPONENTS},
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, e.vec_id) AS component_id,
  coalesce(m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least ON least.id = e.vec_id LEFT JOIN degree ON degree.id = e.vec_id"""


def _seats(parties: str, group: str, votes: str, total: str, order: str) -> str:
    """Seats by highest quotients, all quotients written out."""
    return f"""
  SELECT {group}{order} AS party, count(*) AS seats FROM (
    SELECT {group}{order}, {total} AS total, row_number() OVER (
      {f'PARTITION BY {group[:-2]} ' if group else ''}ORDER BY {votes}::DOUBLE / (2 * k + 1) DESC, {order}) AS r
    FROM (SELECT *, unnest(range(0, {total} + 1)) AS k FROM {parties} WHERE {votes} > 0)
  ) WHERE r <= total GROUP BY ALL"""


MIXING = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0)::BIGINT AS size,
    ('0x' || substr(md5(text), 1, 13))::BIGINT AS tie FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sizes GROUP BY source),
weighted AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM named),
running AS (
  SELECT *, sum(2 * source_size) OVER up - 2 * source_size AS full_before,
    sum(weight) OVER up - weight AS weight_before, sum(source_size) OVER () AS whole, sum(weight) OVER () AS weights
  FROM weighted WINDOW up AS (ORDER BY 2 * source_size / weight, nth ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max((1.5 * whole::DOUBLE - full_before::DOUBLE) / (weights - weight_before)::DOUBLE) AS l FROM running),
aimed AS (SELECT nth, source, source_size, least(2.0::DOUBLE * source_size, l * weight) AS target FROM weighted, level),
total AS (SELECT *, round(sum(target) OVER () / 4)::BIGINT AS blocks,
  greatest(1, ceil(source_size / 65536))::BIGINT AS shards FROM aimed),
won AS ({_seats('total', '', 'target', 'blocks', 'nth')}),
quotas AS (SELECT t.*, coalesce(seats, 0) AS quota FROM total t LEFT JOIN won ON party = nth),
dealt AS (
  SELECT s.doc_id, s.size, s.tie, q.nth, q.source_size, q.target, q.quota, md5('mix:' || coalesce(s.doc_id::VARCHAR, '~')) AS d,
    ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '~')), 14, 13))::BIGINT % q.shards AS shard
  FROM sizes s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
shelves AS (SELECT nth, shard // 1024 AS shelf, quota, sum(size)::BIGINT AS z FROM dealt GROUP BY ALL),
shelf_won AS ({_seats('shelves', 'nth, ', 'z', 'quota', 'shelf')}),
shard_sizes AS (
  SELECT d.nth, d.shard // 1024 AS shelf, d.shard, coalesce(any_value(w.seats), 0) AS quota, sum(d.size)::BIGINT AS z
  FROM dealt d LEFT JOIN shelf_won w ON w.nth = d.nth AND w.party = d.shard // 1024 GROUP BY d.nth, d.shard),
shard_won AS ({_seats('shard_sizes', 'nth, shelf, ', 'z', 'quota', 'shard')}),
cuts AS (
  SELECT s.nth, s.shard, z, least(coalesce(seats, 0) * 4, 2 * z) AS words,
    ('0x' || substr(md5('mix:' || s.nth || ':' || s.shard), 1, 13))::BIGINT % greatest(1, z) AS lo
  FROM shard_sizes s LEFT JOIN shard_won w ON w.nth = s.nth AND w.party = s.shard),
placed AS (
  SELECT d.*, c.z, c.lo, c.words // greatest(1, c.z) AS full_times, c.words % greatest(1, c.z) AS rest,
    sum(d.size) OVER (PARTITION BY d.nth, d.shard ORDER BY d.d, d.size, d.tie ROWS UNBOUNDED PRECEDING) - d.size AS p
  FROM dealt d JOIN cuts c ON c.nth = d.nth AND c.shard = d.shard)
SELECT doc_id, size, source_size, target, (full_times * size
  + greatest(0, least(p + size, lo + rest) - greatest(p, lo))
  + greatest(0, least(p + size, lo - z + rest) - greatest(p, lo - z)))::BIGINT AS taken
FROM placed"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_RUN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHARE = "1 + (1000000000 * ({0}::HUGEINT + 2)) // ({1}::HUGEINT + 2 * {2}::HUGEINT)"
_GAP = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"

DIVERGENCE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
places AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM places GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM places JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    {_SHARE.format('coalesce(c.c, 0)', 'coalesce(t.n, 0)', 'l.v')} AS p,
    {_SHARE.format('k.c', 'l.n', 'l.v')} AS q
  FROM grps g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
rated AS (
  SELECT a.lang, a.source, b.source AS item, sum({_GAP.format('a.p', 'b.p')}) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(r.value, 0)::BIGINT AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN rated r ON r.lang = a.lang AND r.source = a.source AND r.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ({_GAP.format('p', 'q')})::BIGINT AS value
  FROM grid WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
  FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 10"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_RUN_WORD}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_RUN_WORD}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, k, i, array_to_string(w[i:i+k-1], ' ') AS x
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
hits AS (SELECT r, i, p.k, item_id FROM places p JOIN windows v ON v.k = p.k AND v.x = p.x),
covered AS (
  SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY r),
named AS (SELECT r, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""

# crc32 byte by byte over a table that the polynomial gives.
_STEP = "CASE WHEN ({0}) & 1 = 1 THEN xor(({0}) >> 1, 3988292384) ELSE ({0}) >> 1 END"
_CRC_TABLE = "SELECT list(b8 ORDER BY b0) AS crc FROM (" + "".join(
    f"SELECT *, {_STEP.format(f'b{k}')} AS b{k + 1} FROM (" for k in range(7, -1, -1)
) + "SELECT unnest(range(0, 256)) AS b0" + ")" * 9

SPELLING = f"""
WITH RECURSIVE tab AS MATERIALIZED ({_CRC_TABLE}),
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS word FROM documents)
  GROUP BY ALL),
summed AS (
  SELECT word, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      range(0, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || word))),
      lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab.crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM runs, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2)
      ELSE word END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY ALL HAVING sum(n) >= 3),
gone AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
swapped AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS mask
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM swapped a JOIN swapped b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT g.word, g.n, w.word, w.n FROM gone g JOIN words w ON w.word = g.less
  UNION ALL SELECT w.word, w.n, g.word, g.n FROM gone g JOIN words w ON w.word = g.less),
best AS (
  SELECT word, count(*) AS k, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY ALL),
formed AS (
  SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form,
    CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS higher FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.higher WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.higher FROM chain c JOIN formed f ON f.word = c.higher WHERE f.form IS NULL)
SELECT word, form, coalesce(ends.higher, word) AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM formed LEFT JOIN ends USING (word)"""
