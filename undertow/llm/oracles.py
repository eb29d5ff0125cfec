"""DuckDB SQL of the queries that SQL can express."""

A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP8 = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, {A_Z}), {WORDS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item, m, list_aggregate(w[k:k + m - 1], 'string_agg', ' ') AS x
        FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), {WORDS}) AS w FROM documents),
dw AS (SELECT doc_id, m, k, list_aggregate(w[k:k + m - 1], 'string_agg', ' ') AS x
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT doc_id, k, dw.m, item FROM dw JOIN win ON dw.x = win.x AND dw.m = win.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
runs AS (SELECT doc_id, max(n) AS longest_match FROM (SELECT doc_id, item, g, max(k + m) - min(k) AS n FROM
  (SELECT doc_id, item, k, m, k - row_number() OVER (PARTITION BY doc_id, item, diag ORDER BY k) AS g, diag FROM
    (SELECT DISTINCT dw.doc_id, w2.item, dw.k, dw.m, dw.k - w2.off AS diag FROM dw JOIN
      (SELECT item, m, off, list_aggregate(w[off:off + m - 1], 'string_agg', ' ') AS x FROM
        (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS off FROM i WHERE len(w) > 0)) w2
      ON dw.x = w2.x AND dw.m = w2.m)) GROUP BY doc_id, item, g, diag) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN runs USING (doc_id)"""

OP9 = r"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), AZ) AS host,
       regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1) AS qs FROM u),
k AS (SELECT *, list_sort(list_filter(string_split(qs, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|mc_[ce]id)(=|$)'))) AS kept FROM p),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
       || CASE WHEN len(kept) > 0 THEN '?' || list_aggregate(kept, 'string_agg', '&') ELSE '' END END AS canon FROM k),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND canon IS NOT NULL),
j AS (SELECT page_id, host, path, l.canon IS NOT NULL AS listed,
       CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
     FROM c LEFT JOIN l ON c.canon = l.canon)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM j""".replace("AZ", A_Z)

def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"


# The stored pages hold one article each, in marked form.
OP11 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
     FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("s")} % 6 AS h FROM i),
heads AS (SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h),
have AS (SELECT conv_id, count(*) AS have FROM heads GROUP BY 1),
own AS (SELECT conv_id, coalesce(have, 0) + pos - h AS depth, role, text FROM c JOIN t USING (conv_id) LEFT JOIN have USING (conv_id) WHERE pos > h),
r AS (SELECT conv_id, depth, length(text) AS chars, md5(length(role)::VARCHAR || ':' || role || text) AS x FROM (SELECT * FROM heads UNION ALL SELECT * FROM own)),
l AS (SELECT conv_id, depth, chars, list(x) OVER (PARTITION BY conv_id ORDER BY depth) AS xs FROM r),
p AS (SELECT conv_id, depth, chars, array_to_string(xs, '') AS key, array_to_string(xs[1:len(xs) - 1], '') AS parent FROM l),
nodes AS (SELECT key, max(parent) AS parent, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY key
          UNION ALL SELECT '', NULL, 0, min(conv_id), count(*), 0 FROM c HAVING count(*) > 0),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
paths AS (SELECT conv_id, depth, key FROM p UNION ALL SELECT conv_id, 0, '' FROM c),
sums AS (SELECT a.key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
         FROM nodes b JOIN paths a ON a.conv_id = b.conv_id AND a.depth <= b.depth LEFT JOIN kids k ON k.key = b.key GROUP BY 1),
last AS (SELECT conv_id, max_by(key, depth) AS key FROM paths GROUP BY 1),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums ON sums.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN ends ON ends.key = n.key LEFT JOIN nodes u ON u.key = n.parent"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, doc_id::VARCHAR AS s, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT id, doc_id, w, len(w) AS n, {crc32("s")} AS h FROM d),
g AS (SELECT *, (h // 10) % n AS a, h // 10 AS g FROM h WHERE n > 0 AND h % 10 = 0 AND doc_id IS NOT NULL),
v AS (SELECT id, list_concat(w[1:a], list_transform(range(0, n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1])) AS w FROM g
      UNION ALL SELECT id, w FROM h WHERE id NOT IN (SELECT id FROM g)),
e AS (SELECT id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM v),
grams AS (SELECT id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o) AS x6, lead(x, 5) OVER o AS full6
          FROM e WINDOW o AS (PARTITION BY id ORDER BY i)),
pairs AS (SELECT a.id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.id = b.id AND a.x6 = b.x6 AND a.i < b.i WHERE a.full6 IS NOT NULL AND b.full6 IS NOT NULL),
isles AS (SELECT id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS k FROM pairs) GROUP BY id, q, k),
big AS (SELECT * FROM isles WHERE length >= greatest(12, 2 * q)),
runs AS (SELECT * FROM big x WHERE NOT EXISTS (SELECT 1 FROM big y WHERE y.id = x.id AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
best AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS s,
         arg_min(struct_pack(start := start, length := length, period := q), struct_pack(a := -length, b := start, c := q)) AS top FROM runs GROUP BY id),
cut AS (SELECT DISTINCT id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS s FROM e ANTI JOIN cut USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
       (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(best.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (id) LEFT JOIN kept USING (id)"""

ORACLES: dict[str, str] = {
    "op8_suffix_arrays": OP8,
    "op9_bloom_urls": OP9,
    "op11_html_clusters": OP11,
    "op12_time_forward_trie": OP12,
    "op13_periodic_runs": OP13,
}
