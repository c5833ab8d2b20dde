"""SQL that must give the same rows as the queries, where SQL can express them."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + least(5, len(w))], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(r.b, doc_id)) AS class_id, coalesce(c.n_links, 0)::BIGINT AS n_links
FROM documents LEFT JOIN least_of r ON r.a = doc_id LEFT JOIN counted c ON c.a = doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, size, array_to_string(w[k + 1 : k + size], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS k FROM i)),
spots AS (SELECT doc_id, k, size, array_to_string(w[k + 1 : k + size], ' ') AS win
          FROM (SELECT doc_id, w, size, unnest(range(0, greatest(0, len(w) - size + 1))) AS k FROM d, (SELECT DISTINCT size FROM wins))),
hits AS (SELECT DISTINCT doc_id, k, s.size, item_id FROM spots s JOIN wins USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

#: Words one edit apart share a word without one of its letters at the same place, or one is the other without a letter.
SPELLING = r"""
WITH RECURSIVE table_of AS (
    SELECT list(c ORDER BY i) AS crc_of FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
    SELECT doc_id, run, n, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(0, octet_length(encode(doc_id || ':' || run))),
            lambda i: ('0x' || substr(hex(encode(doc_id || ':' || run)), 2 * i + 1, 2))::INTEGER::BIGINT)),
        lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
    FROM runs, table_of),
words AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_less AS (SELECT DISTINCT c.word AS longer, w.word AS shorter FROM cut c JOIN words w ON w.word = c.rest),
near AS (
    SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT longer, shorter FROM one_less UNION SELECT shorter, longer FROM one_less),
best AS (
    SELECT x.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n
    FROM near x JOIN words o ON o.word = x.other GROUP BY x.word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
phrases AS (
    SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*) AS a
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM (SELECT lang, words, unnest([1, 2, 3, 4]) AS k FROM lists))
    GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS words FROM phrases WHERE k > 1 AND a >= 30),
cuts AS (
    SELECT c.lang, c.phrase, c.k, c.a, c.words, c.cut_at, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a) AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut_at FROM candidates) c
    JOIN phrases l ON l.lang = c.lang AND l.k = c.cut_at AND l.phrase = array_to_string(c.words[1:c.cut_at], ' ')
    JOIN phrases r ON r.lang = c.lang AND r.k = c.k - c.cut_at AND r.phrase = array_to_string(c.words[c.cut_at + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
inner_ones AS (
    SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(a) AS most
    FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)) GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN inner_ones i ON i.lang = c.lang AND i.phrase = c.phrase WHERE NOT coalesce(100::HUGEINT * i.most >= 80::HUGEINT * c.a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
