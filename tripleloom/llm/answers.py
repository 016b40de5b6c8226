"""Answers in SQL for the queries whose contracts SQL can say, over whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') AS words FROM documents
), item AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERED}') AS words FROM benchmark
), sized AS (
    SELECT item, words, least(len(words), 10) AS size FROM item WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item, size, array_to_string(words[i : i + size - 1], ' ') AS line
    FROM (SELECT item, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM sized)
), places AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
    FROM doc CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), hits AS (
    SELECT p.doc_id, p.i, p.size, w.item FROM places p
    JOIN windows w ON w.size = p.size AND w.line = array_to_string(p.words[p.i : p.i + p.size - 1], ' ')
), hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

SUBSTRING_DEDUP = rf"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS words FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS line FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM doc)
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), word AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM doc
), judged AS (
    SELECT word.doc_id, word, word.i, word.i - max(later.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) < 20 AS gone
    FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.i
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT coalesce(gone, FALSE)) AS line
    FROM judged GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS words FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS line
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM doc WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * shared.n >= 80 * (sa.n + sb.n - shared.n)
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
    SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), roots AS (
    SELECT doc_id, min(other) AS root FROM reached GROUP BY doc_id
)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc.doc_id) AS component_id, coalesce(root, doc.doc_id) = doc.doc_id AS kept
FROM doc LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH doc AS (
    SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents
), bytes AS (
    SELECT doc_id, unnest(range(1, octet_length(data) + 1)) AS i,
           unnest(list_transform(range(1, octet_length(data) + 1), lambda i: hex(array_slice(data, i, i)))) AS pair
    FROM doc
), windows AS (
    SELECT doc_id, unnest(range(1, octet_length(data) - 98)) AS i,
           unnest(list_transform(range(1, octet_length(data) - 98), lambda i: md5_number(array_slice(data, i, i + 99)))) AS line
    FROM doc WHERE octet_length(data) >= 100
), later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), judged AS (
    SELECT bytes.doc_id, bytes.i, pair,
           coalesce(bytes.i - max(later.i) OVER (PARTITION BY bytes.doc_id ORDER BY bytes.i) < 100, FALSE) AS gone
    FROM bytes LEFT JOIN later ON later.doc_id = bytes.doc_id AND later.i = bytes.i
), edged AS (
    SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM judged
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(pair, '' ORDER BY i) FILTER (NOT gone) AS rest
    FROM edged GROUP BY doc_id
)
SELECT doc.doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

#: crc32 is spelled out: a byte is met by exclusive or, followed by eight shifts (marked -1).
PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      range(1, length(CAST(c AS VARCHAR)) + 1),
      lambda i: [CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 9 AS BIGINT) AS h
  FROM (SELECT DISTINCT c FROM turns)
), joined AS (
  SELECT v.c, 0 AS side, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h
), lists AS (
  SELECT v.c, coalesce(j.steps, []) AS steps FROM convs v LEFT JOIN (
    SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY side, pos) AS steps FROM joined GROUP BY c) j ON j.c = v.c
), sizes AS (
  SELECT DISTINCT sha256(length(role) || ':' || role || text) AS step, strlen(text) AS bytes FROM joined
), prefixes AS (
  SELECT c, len(steps) AS n, d, steps[1:d] AS path FROM (SELECT c, steps, unnest(range(0, len(steps) + 1)) AS d FROM lists)
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d
), weighed AS (
  SELECT nodes.*, (n_convs - 1) * coalesce(bytes, 0) AS own FROM nodes LEFT JOIN sizes ON step = path[-1]
), children AS (
  SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT w.*, coalesce(k.n, 0) AS n_children FROM weighed w LEFT JOIN children k ON k.path = w.path AND k.d = w.d
), above AS (
  SELECT path[1:e] AS path, e AS d, sum(own) AS saved, count_if(n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY ALL
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs,
  k.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN above a ON a.path = k.path AND a.d = k.d LEFT JOIN nodes p ON k.d > 0 AND p.path = k.path[1:k.d - 1] AND p.d = k.d - 1
"""
