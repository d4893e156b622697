"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

MINHASH = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_FOLD}, ''), {_WORDS}) AS a FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))
    WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE []::VARCHAR[] END) AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u
), c AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.u
"""


def licenses(notices) -> str:
    """Containment of every notice in the whole of every text."""
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(notices))
    words = rf"regexp_extract_all(coalesce({_FOLD}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    shingles = "list_distinct(list_transform(range(1, greatest(len(a) - 3, 1)), lambda i: array_to_string(a[i:i+4], ' ')))"
    return f"""
WITH n AS (SELECT i, license, {words} AS a FROM (VALUES {rows}) AS v(i, license, text)),
t AS (SELECT i, license, unnest({shingles}) AS x FROM n),
size AS (SELECT i, count(*) AS k FROM t GROUP BY i),
d AS (SELECT doc_id, {words} AS a FROM documents),
e AS (SELECT doc_id, unnest({shingles}) AS x FROM d WHERE len(a) >= 5)
SELECT doc_id, license, max(c) AS containment FROM (
  SELECT doc_id, t.i, license, count(*) / min(k) AS c FROM e JOIN t USING (x) JOIN size ON size.i = t.i
  GROUP BY doc_id, t.i, license) AS g
WHERE c >= 0.75 GROUP BY doc_id, license
"""


VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT reach.u, p.w FROM reach JOIN p ON reach.w = p.u
), c AS (SELECT u, min(w) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
