"""DuckDB SQL of the queries that SQL can express. Written apart from the operators: no pattern is imported."""

LINE_RUNS = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM split),
hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, coalesce(doc_id < top, false) AS gone FROM keyed LEFT JOIN hot ON hot.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT x) AS n_distinct
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS x FROM w, unnest(range(1, len(ws) - 6)) AS r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, text
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols > 0.25 * n_words
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR n_dup_lines > 0.6 * len(string_split(text, chr(10)))
    OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 0.5 * word_chars
    OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 0.5 * word_chars
    OR (length(text) - length(replace(text, '!!', ''))) / 2 > 0.3 * n_words
    OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[-*•]'))) > 0.9 * len(string_split(text, chr(10)))
    OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.3 * len(string_split(text, chr(10)))
  ) AS kept
FROM b
"""

SECRETS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pat(kind, rank, p) AS (VALUES
  ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'),
  ('hex', 2, '[0-9a-f]+'),
  ('id', 3, '(?i:client_?id|access_?key(?:_?id)?|account_?id|user_?name|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]{3,}'),
  ('key', 4, '[A-Za-z0-9+/]{20,}={0,2}'),
  ('endpoint', 5, 'https?://[^\x00-\x20"''<>]+')),
found AS (
  SELECT doc_id, kind, rank, regexp_extract_all(text, p) AS m, string_split_regex(text, p) AS b
  FROM t, pat WHERE regexp_matches(text, p)),
each AS (SELECT doc_id, kind, rank, unnest(range(1, len(m) + 1)) AS i, m, b FROM found),
one AS (SELECT doc_id, kind, rank, i, m[i] AS m, length(m[i]) AS n, length(b[i]) AS b FROM each),
placed AS (SELECT *, sum(b + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM one),
part AS (
  SELECT doc_id, kind, rank, (e - n)::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
    WHEN 'access' THEN n >= 20 WHEN 'hex' THEN n >= 24
    WHEN 'key' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') ELSE true END),
met AS (
  SELECT w.doc_id, w.kind, w.rank, w.s, w.e, bool_or(o.kind = 'access') AS sure_id, bool_or(o.kind = 'id') AS weak_id,
    bool_or(o.kind IN ('assign', 'hex')) AS sure_secret, bool_or(o.kind = 'key') AS weak_secret,
    bool_or(o.kind = 'endpoint') AS place, bool_or(o.rank < 3 AND o.s < w.e AND o.e > w.s) AS inside
  FROM part w JOIN part o ON o.doc_id = w.doc_id AND o.e > w.s - 200 AND o.s < w.e + 200
  WHERE w.rank > 2 GROUP BY ALL),
linked AS (
  SELECT doc_id, kind, rank, s, e FROM met WHERE CASE kind
    WHEN 'id' THEN sure_secret OR (weak_secret AND place)
    WHEN 'key' THEN (sure_id OR (weak_id AND place)) AND NOT inside
    ELSE (sure_id OR weak_id) AND (sure_secret OR weak_secret) END),
every AS (SELECT doc_id, kind, rank, s, e FROM part WHERE rank < 3 UNION ALL SELECT * FROM linked),
doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM every GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN doc ON doc.doc_id = t.doc_id
"""

WARC = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS five FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

DECONTAMINATE = r"""
WITH i AS (
  SELECT item_id, w, least(5, len(w)) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j+k-1], ' ') AS g FROM i, unnest(range(1, len(w) - k + 2)) AS t(j)),
q AS (SELECT item_id, k, count(*) AS n FROM ig GROUP BY item_id, k),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
dg AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[j:j+k-1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len(w) - k + 2)) AS t(j))
SELECT doc_id, item_id, count(*) AS n_shared, max(n) AS n_shingles, count(*) / max(n) AS containment
FROM dg JOIN ig USING (k, g) JOIN q USING (item_id, k)
GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * max(n) - 1e-9)
"""

#: CTEs: ``tab`` is the table of crc32, by its rule; crc32 of a list b of bytes is then the fold below.
_CRC_TABLE = r"""tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""
_CRC = "xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1])), 4294967295)"
_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || hex(encode({0}))[2 * i - 1:2 * i])::BIGINT)"

MERKLE = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT *, {_BYTES.format("doc_id::VARCHAR")} AS b,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
e AS (
  SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN low ELSE text END AS other,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d, tab),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS altered FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
tree AS (
  SELECT 0 AS lvl, lang, pos, leaf AS h, (count(*) OVER (PARTITION BY lang)) AS n FROM placed
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8
  FROM tree WHERE n > 1 GROUP BY lvl, lang, pos // 8),
sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, lvl AS height FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS h, (count(*) OVER ()) AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
walk AS (
  SELECT 0 AS lvl, p.doc_id, p.lang, p.leaf, p.pos, s.height, s.pos AS part, s.subroot, '' AS proof, p.altered AS fold
  FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT lvl + 1, doc_id, lang, leaf, pos // 8, height, part, subroot, proof || l || r, sha256(l || fold || r)
  FROM (
    SELECT w.*, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < w.pos), '') AS l,
      coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > w.pos), '') AS r
    FROM walk w JOIN tree t ON t.lvl = w.lvl AND t.lang IS NOT DISTINCT FROM w.lang AND t.pos // 8 = w.pos // 8
    WHERE w.lvl < w.height GROUP BY ALL)),
up AS (
  SELECT 0 AS lvl, doc_id, leaf, part AS pos, subroot, proof, fold FROM walk WHERE lvl = height
  UNION ALL
  SELECT lvl + 1, doc_id, leaf, pos // 8, subroot, proof || l || r, sha256(l || fold || r)
  FROM (
    SELECT w.*, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < w.pos), '') AS l,
      coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > w.pos), '') AS r
    FROM up w JOIN top t ON t.lvl = w.lvl AND t.pos // 8 = w.pos // 8
    WHERE t.n > 1 GROUP BY ALL))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM up, (SELECT h AS root, lvl AS height FROM top WHERE n = 1) WHERE up.lvl = height
"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS c FROM run GROUP BY ALL),
coded AS (SELECT w, c, {_BYTES.format("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS b FROM each),
hashed AS (SELECT w, c, {_CRC} AS h FROM coded, tab),
word AS (
  SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1),
v AS (SELECT * FROM word WHERE length(word) >= 5 AND n >= 3),
-- Words one edit apart: both, or one and the other less a code point, are alike but for one place.
cut AS (
  SELECT word, n, i, word[1:i - 1] AS a, word[i + 1:] AS z FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
pair AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.a || x.z = y.word
  UNION
  SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.a || x.z = y.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, hex(encode(near)))) AS near FROM pair GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN near END AS form,
    CASE WHEN top >= 2 * v.n THEN top END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
chain AS (
  SELECT word, word AS here, 0 AS step FROM f
  UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word
"""

SQL: dict[str, str] = {
    "op10_decontaminate": DECONTAMINATE,
    "op11_spelling_variants": SPELLING,
    "op12_merkle_manifest": MERKLE,
    "op1_warc_index_merge": WARC,
    "op3_secret_linking": SECRETS,
    "op8_line_runs": LINE_RUNS,
    "op9_quality_cascade": QUALITY,
}
