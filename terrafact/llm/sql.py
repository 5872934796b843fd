"""SQL that gives the rows of operators 5, 7, 8 and 12 without their methods."""

REACH = """reach(i, j) AS (SELECT i, i FROM v UNION SELECT r.i, p.j FROM reach r JOIN links p ON p.i = r.j),
least AS (SELECT r.i, min(w.{key}) AS component_id FROM reach r JOIN v w ON w.i = r.j GROUP BY r.i)"""

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS i, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT i, len(s) AS n, unnest(s) AS t FROM v WHERE doc_id IS NOT NULL),
shared AS (SELECT a.i, b.i AS j, a.n AS na, b.n AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.t = b.t AND a.i <> b.i GROUP BY ALL),
links AS MATERIALIZED (SELECT i, j FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
{REACH.format(key="doc_id")}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM v JOIN least USING (i)
"""

VECTORS = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
links AS MATERIALIZED (SELECT a.i, b.i AS j FROM v a JOIN v b ON a.label = b.label AND a.i <> b.i AND a.ok AND b.ok
          AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
{REACH.format(key="vec_id")},
counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN least USING (i) LEFT JOIN counts USING (i)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.u, c.u) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.u) = len(c.u)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# crc32 byte by byte from a table that its polynomial gives; words with one code point cut out meet in a join.
SPELLING = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT w, k, flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS bytes FROM runs),
hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h
  FROM coded, tab),
spoiled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT p.word, p.other, w.n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS r FROM pairs p JOIN words w ON w.word = p.other),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.other END AS form,
         CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
follow(word, place, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT f.word, g.form, f.step + 1 FROM follow f JOIN formed g ON g.word = f.place WHERE g.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(place, step) AS root FROM follow GROUP BY word) l ON l.word = f.word
"""
