"""SQL of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, ls WHERE len(w) >= l)),
h AS (SELECT dw.r, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN it ON d.r = it.r"""

RLZ = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS win FROM (SELECT *, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM l),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT p.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS win FROM (SELECT *, unnest(generate_series(1, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
l AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS k FROM w) WHERE k > 1),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
k AS (SELECT r.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * prev - 1, 2 * (a - prev)), '' ORDER BY a) AS kept, max(b) AS tail
FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS prev FROM r) r JOIN d ON d.doc_id = r.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(coalesce(kept || substr(h, 2 * tail - 1), h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
