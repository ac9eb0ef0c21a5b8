"""DuckDB SQL for operators that find exactly what comparing everything finds."""

from lakeloom.llm.common import UPPER

#: Every distance, by brute force: op4_nearest searches whole tables of up to 2000 vectors, so also that of scale 0.01.
NEAREST = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(x, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(x, lambda a: a <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
      FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10"""

#: Every string of 50 bytes of every text, as hexadecimal digits; runs of removed bytes; what is between them.
PASSAGES = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM t),
w AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 100) AS part FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS pos FROM s WHERE n >= 50)),
f AS (SELECT part, min(doc_id) AS least FROM w GROUP BY part),
g AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM w JOIN f USING (part) WHERE least < doc_id),
i AS (SELECT doc_id, pos, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
r AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
p AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM s LEFT JOIN p USING (doc_id)"""

#: Every pair of documents with a shingle in common, and what links reach.
NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n_shingles + q.n_shingles - common)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT m.b, c.reach FROM c JOIN m ON m.a = c.doc_id)
SELECT n.doc_id, n_shingles, min(reach) AS component_id, n.doc_id = min(reach) AS kept FROM n JOIN c USING (doc_id) GROUP BY n.doc_id, n_shingles"""

#: Every window of an item's size around the shingles that a document has of the item.
LEAKS = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, w, len(w) AS words, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS size FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, k, x, count(*) AS c FROM (SELECT item_id, k, unnest(list_transform(range(1, size + 1), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS x FROM i) GROUP BY 1, 2, 3),
d AS (SELECT doc_id, k, w, len(w) - k + 1 AS n FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
dsh AS (SELECT doc_id, k, u.pos, u.x FROM (SELECT doc_id, k, unnest(list_transform(range(1, n + 1), lambda j: {{'pos': j, 'x': array_to_string(w[j:j + k - 1], ' ')}})) AS u FROM d)),
hit AS (SELECT doc_id, item_id, ish.k, pos FROM dsh JOIN ish ON dsh.k = ish.k AND dsh.x = ish.x),
pair AS (SELECT h.doc_id, h.item_id, i.k, size, least(size, n) AS wide, n, min(pos) AS lo, max(pos) AS hi FROM hit h JOIN i USING (item_id) JOIN d ON d.doc_id = h.doc_id AND d.k = i.k
         GROUP BY h.doc_id, h.item_id, i.k, size, n HAVING count(*) >= 0.8 * size - 1e-9),
win AS (SELECT doc_id, item_id, k, size, wide, unnest(range(greatest(1, lo - wide + 1), least(hi, n - wide + 1) + 1)) AS s FROM pair),
cnt AS (SELECT win.doc_id, win.item_id, win.k, size, wide, s, dsh.x, count(*) AS c FROM win JOIN dsh ON dsh.doc_id = win.doc_id AND dsh.k = win.k AND dsh.pos >= s AND dsh.pos < s + wide GROUP BY ALL),
sim AS (SELECT doc_id, cnt.item_id, size, wide, s, sum(least(cnt.c, ish.c)) AS common FROM cnt JOIN ish ON ish.item_id = cnt.item_id AND ish.x = cnt.x GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(common / CAST(size + wide - common AS DOUBLE)) AS like_ FROM sim GROUP BY 1, 2 HAVING max(common / CAST(size + wide - common AS DOUBLE)) >= 0.8 - 1e-12)
SELECT doc_id, arg_min(item_id, struct_pack(l := -like_, i := item_id)) AS item_id, max(like_) AS similarity, CAST(count(*) AS INTEGER) AS n_items, true AS contaminated FROM best GROUP BY doc_id"""
