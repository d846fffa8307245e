"""DuckDB SQL of the operators that SQL can express, over the same tables."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i AS pos, array_to_string(w[i:i + 19], ' ') AS s
        FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
ord AS (SELECT doc_id, pos, dense_rank() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, pos + j AS i FROM ord, unnest(range(0, 20)) AS t(j) WHERE k > 1),
lists AS (SELECT doc_id, list(i ORDER BY i) AS bad FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(bad), 0) AS r,
                CASE WHEN bad IS NULL THEN w ELSE
                [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(bad, i)] END AS k
         FROM d LEFT JOIN lists USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, {SPACED}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)
         UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
pair AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN pair e ON r.b = e.x)
SELECT a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, {ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, {ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
       FROM d, (SELECT DISTINCT size FROM bw) z, unnest(range(1, len(w) - size + 2)) AS t(i)),
hit AS (SELECT doc_id, i, dw.size AS size, item FROM dw JOIN bw ON dw.s = bw.s AND dw.size = bw.size),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, size)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
                           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                           ('allow', 'org', '/fr/')),
f AS (SELECT page_id, host, path, h || q AS rule, action,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) AS k
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE k = 1
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c
        FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win, unnest(range(0, 8)) AS t(j) WHERE c > 1 GROUP BY doc_id),
line AS (SELECT doc_id, l FROM d, unnest(string_split(t, chr(10))) AS x(l) WHERE len(regexp_extract_all(l, {SPACED})) > 0),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM line GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             len(t) - len(regexp_replace(t, '[A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_letters
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 2 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 4 * n_letters < word_chars
            OR 10 * n_upper > 7 * greatest(n_letters, 1)) AS kept
FROM v
"""

#: Ties between rows of one turn go by role and md5 of the text, as in the operator.
REPAIR = r"""
WITH RECURSIVE step(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b)
    UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
              coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
sums(key, i, v) AS (SELECT DISTINCT key, 0, CAST(4294967295 AS BIGINT) FROM c0
    UNION ALL SELECT key, i + 1, xor(v // 256, t[xor(v % 256, ascii(substr(key, i + 1, 1))) + 1]) FROM sums, crc WHERE i < length(key)),
h AS (SELECT key, xor(v, 4294967295) % 20 AS h FROM sums WHERE i = length(key)),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' WHEN role = '' THEN ' ' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
      FROM c0 JOIN h USING (key), (VALUES (0), (1)) x(copy) WHERE h <> 0 AND (copy = 0 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
e AS (SELECT conv_id, turn, role, text, i, role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS p,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
             regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM o),
f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen THEN 'd' WHEN shown[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM e),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
best(conv_id, i, o, s, u, a) AS (
    SELECT conv_id, 0, {'c': 0, 'w': ''}, NULL::STRUCT(c INTEGER, w VARCHAR), NULL::STRUCT(c INTEGER, w VARCHAR), NULL::STRUCT(c INTEGER, w VARCHAR) FROM stats
    UNION ALL
    SELECT conv_id, i + 1, {'c': o.c + 3, 'w': o.w || 'D'},
           list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'w': s.w || 'D'} END,
                     CASE WHEN x = 0 AND r = 's' THEN {'c': o.c + t, 'w': o.w || 'K'} END]),
           list_min([CASE WHEN u IS NOT NULL THEN {'c': u.c + 3, 'w': u.w || 'D'} END,
                     CASE WHEN x = 0 THEN {'c': v.c + t + CASE WHEN r = 'u' THEN 0 ELSE 2 END, 'w': v.w || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END} END]),
           list_min([CASE WHEN a IS NOT NULL THEN {'c': a.c + 3, 'w': a.w || 'D'} END,
                     CASE WHEN x = 0 AND u IS NOT NULL THEN {'c': u.c + t + CASE WHEN r = 'a' THEN 0 ELSE 2 END,
                                                            'w': u.w || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END} END])
    FROM (SELECT q.conv_id, q.i, o, s, u, a, list_min([o, s, a]) AS v, f.r,
                 CASE WHEN f.fault IN ('b', 'd') THEN 1 ELSE 0 END AS x, CASE WHEN f.fault = 't' THEN 1 ELSE 0 END AS t
          FROM (SELECT conv_id, i, o, s, u, list_min([a, CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'w': u.w || 'I'} END]) AS a
                FROM (SELECT conv_id, i, o, s, a, list_min([u, {'c': o.c + 2, 'w': o.w || 'I'}, CASE WHEN s IS NOT NULL THEN {'c': s.c + 2, 'w': s.w || 'I'} END,
                       CASE WHEN a IS NOT NULL THEN {'c': a.c + 2, 'w': a.w || 'I'} END]) AS u FROM best)) q
          JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i + 1)),
ends AS (SELECT b.conv_id, list_min([o, a, CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'w': u.w || 'I'} END,
                                     CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'w': s.w || 'II'} END]) AS e
         FROM best b JOIN stats t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = t.n),
edits AS (SELECT conv_id, k, e.w[k] AS op, length(replace(e.w[1:k], 'I', '')) AS i, length(replace(e.w[1:k], 'D', '')) AS place
          FROM ends, unnest(range(1, length(e.w) + 1)) x(k) WHERE e.w[k] <> 'D'),
lines AS (SELECT x.conv_id, place, op, f.role, f.text,
                 max(CASE WHEN place = 1 AND op = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS led
          FROM edits x LEFT JOIN f ON op <> 'I' AND f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i),
made AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS body FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.w, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""
