"""SQL for the operators that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
dg AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS k
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, lens WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN win ON win.k = dg.k AND win.m = dg.m),
pos AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS t FROM g),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE t > 1)),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT e.doc_id, count(r.p) AS n_removed, string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY e.p) AS kept FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.p = e.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

JACCARD_JOIN = (
    "WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '"
    + _UPPER
    + "', '"
    + _LOWER
    + r"""'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ln AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT a, b FROM ln UNION SELECT r.a, l.b FROM reach r JOIN ln l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) g USING (doc_id)
"""
)

#: SHA-1 in base 32: each ten hex digits are eight digits of five bits.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), '')"

WARC_ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM r
"""
