"""The queries in SQL, where SQL can express them.

The learnt models, the rolling hashes, the lexer, the tokenizer and spans with scores
are tested against brute force instead.
"""

from __future__ import annotations

# Components of links (a, b) over ids: every id takes the smallest id that it can reach.
_REACH = """reach AS (
  SELECT a AS id, b AS other FROM links UNION SELECT b, a FROM links
  UNION SELECT r.id, l.other FROM reach r
    JOIN (SELECT a AS id, b AS other FROM links UNION ALL SELECT b, a FROM links) l
      ON r.other = l.id),
lowest AS (SELECT id, least(id, min(other)) AS low FROM reach GROUP BY id)"""

NEAR = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS id FROM sets WHERE len(s) > 0
            GROUP BY ALL),
one AS (SELECT id, n, unnest(s) AS x FROM classes),
rare AS (  -- of two sets that are similar enough, one of the rarer 16% is in both
  SELECT id, n, x FROM (
    SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY f, x) AS r FROM (
      SELECT id, n, x, count(*) OVER (PARTITION BY x) AS f FROM one))
  WHERE r <= n - (85 * n + 99) // 100 + 1),
maybe AS (SELECT DISTINCT p.id AS a, q.id AS b FROM rare p JOIN rare q ON p.x = q.x AND p.id < q.id
          WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)),
linked AS (
  SELECT m.a, m.b FROM maybe m JOIN classes p ON m.a = p.id JOIN classes q ON m.b = q.id
  WHERE 185 * len(list_intersect(p.s, q.s)) >= 85 * (p.n + q.n)),
links AS (
  SELECT a, b FROM linked UNION ALL
  SELECT c.id, s.doc_id FROM sets s JOIN classes c ON list_sort(s.s) = c.s WHERE c.id <> s.doc_id),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id,
       coalesce(low, doc_id) = doc_id AS kept
FROM sets LEFT JOIN lowest ON id = doc_id"""

# The checksum's table comes from its polynomial, as SQL has no function for it.
SHARDS = """WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t),
docs AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda c, h:
      xor(c >> 8, t[xor(c & 255, strpos('0123456789ABCDEF', h[1]) * 16 - 17
                                 + strpos('0123456789ABCDEF', h[2])) + 1]),
      CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents, crc),
keyed AS (
  SELECT *, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(crc AS VARCHAR)) AS k
  FROM docs),
parts AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size) - 1
             + CAST('0x' || md5('1:' || coalesce(source, ''))[:13] AS BIGINT) / 4503599627370496e0)
            / count(*) OVER (PARTITION BY source) AS part FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY part, k, source NULLS FIRST, doc_id, size) - 1 AS place,
         count(*) OVER () AS n FROM parts),
cut AS (SELECT *, place * 8 // n AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(shard AS INTEGER) AS shard, CAST(place - (shard * n + 7) // 8 AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, source
FROM cut"""

_WORDS = r"""list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

LEAKS = rf"""WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
      lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS x
  FROM items WHERE len(w) > 0),
words AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT d, size, unnest(range(1, len(w) - size + 2)) AS i, w
  FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (
  SELECT DISTINCT d, i, size, item
  FROM (SELECT d, size, i, array_to_string(w[i : i + size - 1], ' ') AS x FROM places)
  JOIN windows USING (size, x)),
hits AS (
  SELECT d, count(DISTINCT p) AS n_hit
  FROM (SELECT d, unnest(range(i, i + size)) AS p FROM found) GROUP BY d),
named AS (
  SELECT d, count(DISTINCT item) AS n_items,
         string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (d) LEFT JOIN named USING (d)"""

VECTORS = f"""WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id
  WHERE CASE WHEN len(p.e) = len(q.e) THEN list_cosine_similarity(p.e, q.e) >= 0.9 END),
degrees AS (
  SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links)
  GROUP BY id),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id,
       coalesce(low, vec_id) = vec_id AS kept
FROM v LEFT JOIN degrees d ON d.id = vec_id LEFT JOIN lowest l ON l.id = vec_id"""

SEARCH = rf"""WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
size AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs),
items AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark),
asked AS (SELECT DISTINCT i, item_id, unnest(w) AS x FROM items),
held AS (
  SELECT d, doc_id, x, count(*) AS tf, 10 + (90 * any_value(m) * any_value(n)) // any_value(l) AS m
  FROM (SELECT d, doc_id, len(w) AS m, unnest(w) AS x FROM docs), size
  WHERE x IN (SELECT x FROM asked) GROUP BY d, doc_id, x),
weights AS (
  SELECT x, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM held, size GROUP BY x),
scores AS (
  SELECT i, item_id, d, doc_id,
    CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (x) JOIN weights USING (x) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS r
  FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10"""

REPEATS = r"""WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(
    coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT d, unnest(range(1, len(w) - 33)) AS i,
    unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i : i + 34], ' '))) AS x
  FROM words WHERE len(w) >= 35),
again AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT d, list(p) AS ps FROM (
    SELECT DISTINCT d, unnest(range(i, i + 35)) AS p FROM windows JOIN again USING (x))
  GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' '))
    AS kept_sha256
FROM words LEFT JOIN gone USING (d)"""

DIVERGENCE = r"""WITH words AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
held AS (
  SELECT d, lang, source, x, count(*) AS n
  FROM (SELECT d, lang, source, unnest(w) AS x FROM words) GROUP BY ALL),
kept AS (
  SELECT lang, x, CAST(sum(n) AS HUGEINT) AS total FROM held GROUP BY lang, x HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM words),
counts AS (
  SELECT lang, source, x, CAST(sum(held.n) AS HUGEINT) AS c
  FROM held JOIN kept USING (lang, x) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT lang, source, x, coalesce(c, 0) AS c,
    1 + (1000000000 * (coalesce(c, 0) + 1)) // (coalesce(s.n, 0) + v) AS p,
    1 + (1000000000 * (total + 1)) // (l.n + v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs l USING (lang)
    LEFT JOIN counts USING (lang, source, x) LEFT JOIN sizes s USING (lang, source)),
terms AS (
  SELECT lang, source, 'term' AS part, x AS item, ((p - q) * (p - q)) // q AS value
  FROM shares WHERE c > 0 AND p > q),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.x = b.x AND a.source <> b.source
    GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= 200"""

ORACLE: dict[str, str] = {
    "op2_minhash": NEAR,
    "op3_sharding": SHARDS,
    "op5_decontamination": LEAKS,
    "op7_embeddings": VECTORS,
    "op11_ranking": SEARCH,
    "op12_substrings": REPEATS,
    "op13_divergence": DIVERGENCE,
}
