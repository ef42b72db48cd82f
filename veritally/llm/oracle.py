"""The operators' results in DuckDB SQL, where SQL can express them."""

URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), best AS (
  SELECT page_id, u.host, u.path,
         (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.host || r.path)) FROM rules r
          WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS hit
  FROM urls u
)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?(adult|ads|bets|casino|pills|porn|spam|viagra)[.-]')
                                  THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

#: Line dedup with runs of 25 words: every run that would lose them without its first or its last line, by its text.
LINE_DEDUP = r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM docs),
real AS (
  SELECT doc_id, text, value, line, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS i,
         len(regexp_extract_all(value, '[^\x20\x09-\x0D]+')) AS w
  FROM split WHERE regexp_matches(value, '[^\x20\x09-\x0D]')
), summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY i) AS after FROM real),
runs AS (
  SELECT a.doc_id, a.text, a.i AS s, min(b.i) AS e FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.text = b.text AND b.i >= a.i AND b.after - a.after + a.w >= 25 GROUP BY ALL
  UNION
  SELECT b.doc_id, b.text, max(a.i), b.i FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.text = b.text AND b.i >= a.i AND b.after - a.after + a.w >= 25 GROUP BY b.doc_id, b.text, b.i
), named AS (
  SELECT r.doc_id, r.text, r.s, r.e, string_agg(x.value, chr(10) ORDER BY x.i) AS name
  FROM runs r JOIN real x ON x.doc_id = r.doc_id AND x.text = r.text AND x.i BETWEEN r.s AND r.e GROUP BY ALL
), firsts AS (SELECT name, min((doc_id, s)) AS first FROM named GROUP BY name),
gone AS (
  SELECT DISTINCT x.doc_id, x.text, x.line FROM named n JOIN firsts f ON f.name = n.name AND (n.doc_id, n.s) > f.first
  JOIN real x ON x.doc_id = n.doc_id AND x.text = n.text AND x.i BETWEEN n.s AND n.e
), removed AS (SELECT doc_id, text, count(*) AS n FROM gone GROUP BY ALL),
left_over AS (
  SELECT s.doc_id, s.text, string_agg(s.value, chr(10) ORDER BY s.line) AS rest
  FROM split s ANTI JOIN gone g ON g.doc_id = s.doc_id AND g.text = s.text AND g.line = s.line GROUP BY ALL
)
SELECT d.doc_id, coalesce(r.n, 0) AS removed_lines, CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(l.rest, '') END AS text
FROM documents d LEFT JOIN removed r ON r.doc_id = d.doc_id AND r.text = d.text LEFT JOIN left_over l ON l.doc_id = d.doc_id AND l.text = d.text
"""

#: Decontamination by comparing every item with every document at every shift that has enough equal words.
DECONTAMINATION = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
tested AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lowered),
t AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM tested WHERE len(ws) >= 9),
counted AS (
  SELECT doc_id, item_id, i - j AS shift, n, count(*) AS n_equal, list(j ORDER BY j) AS js FROM d JOIN t ON d.w = t.w
  GROUP BY ALL HAVING 100 * count(*) >= 80 * least(15, n)
), windows AS (
  SELECT *, unnest(generate_series(1, n - least(15, n) + 1)) AS s FROM counted
), fits AS (
  SELECT DISTINCT doc_id, item_id, n, n_equal, shift FROM windows
  WHERE 100 * len(list_filter(js, lambda x: x >= s AND x < s + least(15, n))) >= 80 * least(15, n)
)
SELECT doc_id, item_id, max(n_equal) AS n_equal, any_value(n) AS n_item FROM fits GROUP BY doc_id, item_id
"""

#: Documents that share four fifths of their five-word shingles, and the smallest id that links lead to.
NGRAM_JACCARD = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingled AS (
  SELECT DISTINCT doc_id, ws[i:i + 4] AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM lowered WHERE len(ws) > 0)
), sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized z ON z.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

#: The hash trees level by level, crc32 by its table, and each leaf's siblings folded one after another.
MERKLE_MANIFEST = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), fields AS (
  SELECT doc_id, lang, n_chars IS NOT NULL AND xor(list_reduce(
           list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS before,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n0, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
         coalesce(strlen(text) || ':' || text, '-') AS after
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, lang, sha256(before || n0 || after) AS leaf, sha256(before || CASE WHEN hit THEN n1 ELSE n0 END || after) AS other FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves
), nodes(g, lvl, pos, d) AS (
  SELECT g, 0, pos, leaf FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, lvl, pos // 2
), tops AS (SELECT g, max(lvl) AS height, arg_max(d, lvl) AS subroot FROM nodes GROUP BY g),
above(lvl, pos, d) AS (
  SELECT 0, g, subroot FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY lvl, pos // 2
), root AS (SELECT max(lvl) AS height, arg_max(d, lvl) AS root FROM above),
tree AS (
  SELECT n.g, n.lvl, n.pos, n.d FROM nodes n JOIN tops USING (g) WHERE n.lvl < tops.height
  UNION ALL
  SELECT t.g, t.height + a.lvl, a.pos, a.d FROM tops t, above a, root r WHERE a.lvl < r.height
), paths AS (
  SELECT p.g, p.pos AS leaf_at, t.lvl, CASE WHEN t.lvl < h.height THEN p.pos >> t.lvl ELSE p.g >> (t.lvl - h.height) END AS at
  FROM placed p JOIN tops h ON h.g = p.g JOIN (SELECT DISTINCT g, lvl FROM tree) t ON t.g = p.g
), steps AS (
  SELECT p.g, p.leaf_at, p.lvl, p.at, s.d FROM paths p LEFT JOIN tree s ON s.g = p.g AND s.lvl = p.lvl AND s.pos = xor(p.at, 1)
), folded(g, leaf_at, lvl, now, proof) AS (
  SELECT g, pos, 0, other, '' FROM placed
  UNION ALL
  SELECT f.g, f.leaf_at, f.lvl + 1, sha256(CASE WHEN s.d IS NULL THEN f.now WHEN s.at % 2 = 1 THEN s.d || f.now ELSE f.now || s.d END), f.proof || coalesce(s.d, '')
  FROM folded f JOIN steps s ON s.g = f.g AND s.leaf_at = f.leaf_at AND s.lvl = f.lvl
), ends AS (SELECT g, leaf_at, arg_max(now, lvl) AS now, arg_max(proof, lvl) AS proof FROM folded GROUP BY ALL)
SELECT p.doc_id, p.leaf, t.subroot, r.root, sha256(e.proof) AS proof_sha256, e.now AS folded_root, e.now = r.root AS verified
FROM placed p JOIN tops t USING (g) JOIN ends e ON e.g = p.g AND e.leaf_at = p.pos, root r
"""

#: Every phrase of up to five words counted as it stands, every cut of it, and every longer one that holds it.
PHRASE_MINING = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM worded),
counted AS (
  SELECT lang, m, ws[i:i + m - 1] AS p, count(*) AS f FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100
), sizes AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang),
cand AS (SELECT * FROM counted WHERE m > 1),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, CAST(s.n AS BIGINT) AS n, (1000::HUGEINT * c.f::HUGEINT * s.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM cand) c JOIN counted x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN counted y ON y.lang = c.lang AND y.p = c.p[c.k + 1:c.m] JOIN sizes s ON s.lang = c.lang
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, p[i:i + j - 1] AS p, f FROM (SELECT *, unnest(generate_series(1, m - j + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS j FROM cand WHERE m > 2))
), left_over AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inside o WHERE o.lang = c.lang AND o.p = c.p AND 100 * o.f >= 100 * c.a))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM left_over)
WHERE rank <= 2000
"""
