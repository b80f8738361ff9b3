"""DuckDB SQL for the corpus queries that SQL can express."""

_URL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fits AS (
  SELECT page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.rule) AS rn
  FROM split s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
), listed(h) AS (VALUES ('spam-farm.example.org'), ('cheap-pills.example.com'))
SELECT s.page_id, s.host, s.path, f.rule,
       coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE s.host = l.h OR ends_with(s.host, '.' || l.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.rn = 1
"""

_UP, _LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), '{_UP}', '{_LO}') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""

#: Base measures: words by ASCII white space, and words that lie in a 5-word window found twice or more.
_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), chr(32)) AS k FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(0, 5) AS r(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS line FROM d
), keyed AS (
  SELECT doc_id, host, t, line, translate(trim(line, {_BLANKS}), '{_UP}', '{_LO}') AS k,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM lines
), worded AS (SELECT * FROM keyed WHERE w > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT md5(text)) AS host_docs FROM d GROUP BY host),
frequent AS (
  SELECT s.host, s.k FROM (SELECT host, k, count(DISTINCT t) AS n FROM worded GROUP BY host, k) s JOIN hosts USING (host)
  WHERE s.n > 20 AND s.n > host_docs * 0.1
), lost AS (SELECT doc_id, sum(w) AS lost FROM worded JOIN frequent USING (host, k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (lost > 0 AND (n_words - lost < 10 OR n_words - lost < 0.3 * n_words)) AS kept
FROM m
"""

#: Words of windows of 35 that start at two or more places.
_REPEATS = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), chr(32))) AS k FROM (
    SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), twice AS (
  SELECT doc_id, i FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)
), gone AS (SELECT DISTINCT doc_id, i + j AS i FROM twice, range(0, 35) AS r(j)),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(sha, sha256('')) AS kept_sha256
FROM d LEFT JOIN (
  SELECT w.doc_id, count(g.i) AS n_removed, sha256(coalesce(string_agg(word, chr(32) ORDER BY w.i) FILTER (g.i IS NULL), '')) AS sha
  FROM w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
) k ON d.doc_id = k.doc_id
"""

#: Benchmark items of which a document holds four fifths of the distinct shingles; short items are one shingle.
_LEAKS = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark
), items AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), chr(32)) AS s
  FROM (SELECT item_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), docs AS (
  SELECT DISTINCT doc_id, k, array_to_string(list_slice(ws, i, i + k - 1), chr(32)) AS s
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM items) WHERE len(ws) >= k)
), n AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
found AS (SELECT doc_id, item_id, count(*) AS f FROM docs JOIN items USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f / n AS containment FROM found JOIN n USING (item_id) WHERE f / n >= 0.8
"""

#: Bytes of 50-byte strings that also start in a document with a smaller number; a hex digit pair is a byte.
_BYTES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT k, min(doc_id) AS m FROM win GROUP BY k) USING (k) WHERE m < doc_id),
step AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
span AS (SELECT doc_id, r, min(i) AS lo, max(i) + 50 AS hi FROM run GROUP BY 1, 2),
gap AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM span UNION ALL SELECT doc_id, max(hi), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS k FROM gap JOIN n USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM n LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op3_decontaminate": _LEAKS, "op5_url_filter": _URL, "op6_quality_rules": _QUALITY, "op7_substring_dedup": _REPEATS, "op8_line_dedup": _LINES, "op10_suffix_dedup": _BYTES}
