"""DuckDB SQL for the operators that it can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

CONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, list_slice(w, k, k + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM wins),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, n, item_id FROM grams JOIN wins USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
counts AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM docs) GROUP BY x),
uses AS (SELECT g, x, coalesce(c, 0) AS c FROM (SELECT g, unnest(g) AS x FROM (SELECT DISTINCT g FROM wins)) LEFT JOIN counts USING (x)),
rare AS (SELECT g, arg_min(x, (c, x)) AS x FROM uses GROUP BY g HAVING min(c) > 0),
words AS (SELECT doc_id, w, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM docs),
runs AS (SELECT DISTINCT doc_id, g, s FROM (SELECT doc_id, g, unnest(range(greatest(1, p - 19), p + 1)) AS s FROM words JOIN rare USING (x))),
near AS (SELECT DISTINCT doc_id, g FROM runs JOIN docs USING (doc_id) WHERE list_has_all(list_slice(w, s, s + 19), g)),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN wins USING (g) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN close USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda k: array_to_string(list_slice(w, k, k + 2), ' '))) END AS s FROM docs),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
FROM sets s LEFT JOIN least USING (doc_id)
"""
