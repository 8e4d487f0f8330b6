"""DuckDB equivalents of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{LOWER}') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), ''))
         AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

_WORDS = f"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                   '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), s AS (
  SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p
  FROM b WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM s
), sizes AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, item, n, p FROM dw JOIN iw USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: CRC-32 a byte at a time, over the table of the reflected polynomial.
OP11 = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1
             THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), keyed AS (
  SELECT run, count(*) AS n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(octet_length(b)),
             lambda i: CAST('0x' || substr(hex(b), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
           lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) AS h
  FROM keyed, crc
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0
                  THEN substr(run, 1, CAST(h % length(run) AS INT))
                       || substr(run, CAST(h % length(run) + 2 AS INT))
                  ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n
  FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), forms AS (
  SELECT best.word, min(near) AS form
  FROM best JOIN pairs ON best.word = pairs.word AND near_n = most GROUP BY best.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 10 * w.n THEN form END AS form,
         CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best USING (word) LEFT JOIN forms USING (word)
), r0 AS (SELECT word, coalesce(form, word) AS root FROM f),
r1 AS (SELECT a.word, b.root FROM r0 a JOIN r0 b ON a.root = b.word),
r2 AS (SELECT a.word, b.root FROM r1 a JOIN r1 b ON a.root = b.word),
r3 AS (SELECT a.word, b.root FROM r2 a JOIN r2 b ON a.root = b.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r3 USING (word)
"""


def _op13_assigned(book: str) -> str:
    """Each part with the nearest entry of the codebooks ``book``."""
    return f"""
  SELECT vec_id, label, p, v, r[1] AS d, r[2] AS e FROM (
    SELECT vec_id, any_value(label) AS label, x.p, any_value(x.v) AS v, min([CAST(list_sum(
             list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) ** 2)) AS BIGINT), b.e]) AS r
    FROM parts x JOIN {book} b ON x.p = b.p GROUP BY vec_id, x.p)"""


def _op13_improved(book: str, assigned: str) -> str:
    return f"""
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v
    FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n
          FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {assigned})
          GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""


OP13 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v
  FROM (SELECT *, unnest(range(16)) AS p FROM kept)
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), b0 AS MATERIALIZED (
  SELECT p, e, v FROM parts JOIN firsts USING (vec_id)
), a0 AS MATERIALIZED ({_op13_assigned("b0")}
), b1 AS MATERIALIZED ({_op13_improved("b0", "a0")}
), a1 AS MATERIALIZED ({_op13_assigned("b1")}
), b2 AS MATERIALIZED ({_op13_improved("b1", "a1")}
), a2 AS MATERIALIZED ({_op13_assigned("b2")}
), coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code,
         CAST(sum(d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded
"""

ORACLES = {"op7_exact_dedup": OP7, "op8_decontamination": OP8, "op10_line_dedup": OP10}
ORACLES |= {"op11_spelling_variants": OP11, "op13_vector_codes": OP13}
