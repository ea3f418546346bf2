"""DuckDB SQL for the operators that SQL can express.

The rest is tested against brute force in tests/llm: op1 and op5 (links), op3
(markup), op4 and op6 (fitted models), op8 (dynamic programming), op9
(bisection), op10 (scored graph), op12 (tokenizer) and op13 (edits).
"""

from __future__ import annotations

OP2 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
hits AS (
  SELECT doc_id, i, d.n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) d JOIN win ON d.n = win.n AND d.g = win.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# The same layout and damage, compared record by record without a tree.
OP7 = r"""
WITH rec AS (
  SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM pages),
one AS (SELECT page_id, url, r, md5(r) AS digest FROM rec GROUP BY ALL),
laid AS (
  SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % greatest(1, ((SELECT count(*) FROM one) + 255) // 256) AS file,
         CAST('0x' || substr(digest, 9, 6) AS BIGINT) AS draw, CAST(length(r) // 2 AS BIGINT) AS mid FROM one),
pos AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page_id NULLS LAST, url NULLS LAST, digest) - 1 AS pos FROM laid),
a AS (SELECT file, pos, page_id, url, r, sum(strlen(r)) OVER (PARTITION BY file ORDER BY pos) AS e FROM pos),
dam AS (
  SELECT file, pos, CASE WHEN draw % 128 = 5 THEN substr(r, 1, mid) || chr(1) || substr(r, mid + 2)
                         WHEN draw % 512 = 7 THEN substr(r, 1, mid) ELSE r END AS r FROM pos WHERE draw % 512 <> 9),
b AS (SELECT file, pos, r, sum(strlen(r)) OVER (PARTITION BY file ORDER BY pos) AS e FROM dam)
SELECT CAST(file AS INTEGER) AS file, CAST(pos AS INTEGER) AS pos, page_id, url,
       CASE WHEN b.r IS NULL THEN 'missing' WHEN a.r = b.r THEN 'moved' ELSE 'changed' END AS status,
       CAST(a.e - strlen(a.r) AS BIGINT) AS start_a, CAST(a.e AS BIGINT) AS end_a,
       CAST(b.e - strlen(b.r) AS BIGINT) AS start_b, CAST(b.e AS BIGINT) AS end_b,
       sha256(a.r) AS sha256_a, sha256(b.r) AS sha256_b
FROM a LEFT JOIN b USING (file, pos) WHERE b.r IS NULL OR a.r <> b.r OR a.e <> b.e
"""

# Prefixes as joined digests; every node's subtree through the nodes that its
# first member passes. CRC-32 bit by bit over the id's digits.
OP11 = r"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t) AS r, t, n FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS n,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL)),
lens AS (SELECT c, count(*) AS n FROM own GROUP BY c),
head AS (
  SELECT c, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda crc, x: list_reduce(list_concat([xor(crc, x)], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 9 AS h FROM lens),
conv AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS s, least(a.h, coalesce(b.n, 0)) + greatest(0, a.n - a.h) AS len
         FROM head a LEFT JOIN lens b ON b.c = a.c - a.c % 5),
built AS (
  SELECT own.c, r - h + s AS d, t, n FROM own JOIN conv USING (c) WHERE r > h
  UNION ALL SELECT conv.c, r, t, n FROM conv JOIN own ON own.c = conv.c - conv.c % 5 AND r <= s),
pre AS (SELECT c, d, n, string_agg(t, ',') OVER (PARTITION BY c ORDER BY d) AS p FROM built UNION ALL SELECT c, 0, 0, '' FROM conv),
node AS (SELECT d, p, min(c) AS conv, count(*) AS n_convs, max(n) AS n FROM pre GROUP BY d, p),
member AS (SELECT pre.c, pre.d, node.conv FROM pre JOIN node USING (d, p)),
edge AS (SELECT node.*, member.conv AS up FROM node LEFT JOIN member ON member.c = node.conv AND member.d = node.d - 1),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM edge WHERE d > 0 GROUP BY up, d),
leaf AS (SELECT edge.*, coalesce(n_children, 0) AS n_children FROM edge LEFT JOIN kids ON kids.up = edge.conv AND kids.d = edge.d),
total AS (
  SELECT m.conv, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n) AS saved
  FROM leaf JOIN member m ON m.c = leaf.conv AND m.d <= leaf.d GROUP BY m.conv, m.d),
ends AS (SELECT member.conv, member.d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM member JOIN conv USING (c) WHERE d = len GROUP BY member.conv, member.d)
SELECT leaf.conv AS conv_id, CAST(leaf.d AS BIGINT) AS depth, up AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM leaf JOIN total ON total.conv = leaf.conv AND total.d = leaf.d LEFT JOIN ends ON ends.conv = leaf.conv AND ends.d = leaf.d
"""

ORACLE: dict[str, str] = {"op2_decontaminate": OP2, "op7_warc_fixity": OP7, "op11_prefix_trie": OP11}
