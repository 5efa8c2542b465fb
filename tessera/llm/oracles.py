"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import collocations, embedding_dedup, line_dedup, manifest, quality_rules, substring_dedup

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

LINE_DEDUP = rf"""
WITH each AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, md5(text) AS body, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN line ELSE '' END AS word_line FROM each),
boiler AS (
  SELECT word_line AS line FROM marked WHERE word_line <> '' GROUP BY word_line
  HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES} AND count(DISTINCT body) >= {line_dedup.MIN_SITES}),
judged AS (
  SELECT f.doc_id, f.i, f.line, f.word_line, b.line IS NOT NULL AS gone
  FROM marked f LEFT JOIN boiler b ON f.word_line = b.line),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE word_line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_BITS = " + ".join(f"CASE WHEN {cond} THEN {1 << k} ELSE 0 END" for k, cond in enumerate(quality_rules.RULES.values()))
_BASE = quality_rules.mask(quality_rules.POLICIES["base"])
_ALL = quality_rules.mask(quality_rules.POLICIES["v2"])

QUALITY_RULES = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
five AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {quality_rules.WINDOW - 1}), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {quality_rules.WINDOW - 2})) AS i FROM t WHERE len(w) >= {quality_rules.WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM five) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality_rules.WINDOW})) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
         (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN covered c ON t.doc_id = c.doc_id),
f AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {_BASE}) <> 0 AS base_failed,
       (fail_bits & {_ALL}) = 0 AS kept, fail_bits, n_capitals, n_lines, n_stutter
FROM f
"""

RULE_ABLATIONS = f"""
WITH led AS ({QUALITY_RULES}), r(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << k})" for k, r in enumerate(quality_rules.RULES))})
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits = bit) AS failed_alone
FROM led, r GROUP BY rule
"""

JACCARD = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN either x ON r.b = x.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_WIDTH = substring_dedup.WIDTH

SUBSTRING_DEDUP = rf"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {_WIDTH - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_WIDTH - 2})) AS i FROM t WHERE len(w) >= {_WIDTH})),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_WIDTH})) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (
  SELECT w.doc_id, count(g.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def _crc32(text: str) -> str:
    """The usual CRC of a text's bytes, bit by bit; DuckDB has no function for it."""
    step = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {step}), 4294967295)"


def _leaf(text: str) -> str:
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || ({c}::VARCHAR) END"
    return f"sha256({' || '.join(map(value, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _tree(name: str, start: str, n: int = manifest.FAN) -> str:
    """Common tables {name}: nodes of all levels of the trees over `start` (g, pos, m, h)."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, pos, m, h FROM {start}
  UNION ALL
  SELECT g, lvl + 1, pos // {n}, ((any_value(m) + {n - 1}) // {n})::BIGINT, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE m > 1 GROUP BY g, lvl, pos // {n})"""


def _siblings(tree: str, g: str, pos: str, n: int = manifest.FAN) -> str:
    """Condition: node t of a tree is in a run on the path of leaf `pos` of group g."""
    return f"{tree}.g = {g} AND {tree}.m > 1 AND {tree}.pos // {n} = {pos} // power({n}, {tree}.lvl + 1)::BIGINT"


_OWN = f"({{t}}.pos = {{p}} // power({manifest.FAN}, {{t}}.lvl)::BIGINT)"

MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS seen
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m, leaf AS h FROM d),
{_tree("inner_", "leaves")},
subroots AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place FROM inner_ WHERE m = 1),
over AS (SELECT '' AS g, place AS pos, count(*) OVER () AS m, subroot AS h FROM subroots),
{_tree("outer_", "over")},
ours AS (SELECT l.doc_id, l.g, l.pos, l.leaf, l.seen, s.subroot, s.place FROM leaves l JOIN subroots s ON s.name = l.g),
steps AS (
  SELECT o.g, o.pos, i.lvl AS k, coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (WHERE i.pos < o.pos // power({manifest.FAN}, i.lvl)::BIGINT), '') AS lo,
         coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (WHERE i.pos > o.pos // power({manifest.FAN}, i.lvl)::BIGINT), '') AS hi
  FROM ours o JOIN inner_ i ON {_siblings("i", "o.g", "o.pos")} GROUP BY o.g, o.pos, i.lvl
  UNION ALL
  SELECT o.g, o.pos, 1000 + i.lvl, coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (WHERE i.pos < o.place // power({manifest.FAN}, i.lvl)::BIGINT), ''),
         coalesce(string_agg(i.h, '' ORDER BY i.pos) FILTER (WHERE i.pos > o.place // power({manifest.FAN}, i.lvl)::BIGINT), '')
  FROM ours o JOIN outer_ i ON {_siblings("i", "''", "o.place")} GROUP BY o.g, o.pos, i.lvl),
paths AS (SELECT g, pos, list({{'lo': lo, 'hi': hi}} ORDER BY k) AS p, sha256(string_agg(lo || hi, '' ORDER BY k)) AS proof FROM steps GROUP BY g, pos),
folded AS (
  SELECT o.g, o.pos, 0 AS k, o.seen AS h, p.p FROM ours o LEFT JOIN paths p ON p.g = o.g AND p.pos = o.pos
  UNION ALL
  SELECT g, pos, k + 1, sha256(p[k + 1].lo || h || p[k + 1].hi), p FROM folded WHERE k < len(p)),
last AS (SELECT g, pos, arg_max(h, k) AS folded_root FROM folded GROUP BY g, pos)
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = r.h AS verified
FROM ours o JOIN last f ON f.g = o.g AND f.pos = o.pos LEFT JOIN paths p ON p.g = o.g AND p.pos = o.pos, (SELECT h FROM outer_ WHERE m = 1) r
"""

COLLOCATIONS = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '{collocations.UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, row_number() OVER () AS k, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(m))),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM g GROUP BY lang, m, phrase),
part AS (SELECT lang, phrase, f FROM f),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= {collocations.MIN_COUNT}) c),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ({collocations.SCALE}::HUGEINT * c.a * c.a) // (x.f * y.f) AS score, k
  FROM cut c JOIN part x ON x.lang = c.lang AND x.phrase = c.head JOIN part y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM f WHERE m = 3 AND f >= {collocations.MIN_COUNT})
  GROUP BY lang, phrase),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN around x ON x.lang = l.lang AND x.phrase = l.phrase
  WHERE x.f IS NULL OR 100 * x.f < {collocations.COVERED} * l.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n.n, score::BIGINT AS score
FROM kept k JOIN n ON n.lang = k.lang
QUALIFY rank <= {collocations.TOP}
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (
  SELECT vec_id, v, len(v) AS n, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND a.n = b.n
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= {embedding_dedup.THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, x.b FROM reach r JOIN links x ON r.b = x.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

MIXING_TARGETS = rf"""
WITH s AS (SELECT source, sum(len({_WORDS.format("coalesce(text, '')")}))::DOUBLE AS size FROM documents GROUP BY source),
o AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w FROM s),
r AS (
  SELECT *, 2 * size / w AS level, sum(2 * size) OVER q - 2 * size AS closed, sum(w) OVER () - (sum(w) OVER q - w) AS open, 1.5 * sum(size) OVER () AS goal
  FROM o WINDOW q AS (ORDER BY 2 * size / w, source IS NULL, encode(source) ROWS UNBOUNDED PRECEDING)),
water AS (SELECT arg_min((goal - closed) / open, level) AS level FROM r WHERE (goal - closed) / open <= level)
SELECT source, size::BIGINT AS source_size, round(least(2 * size, water.level * w), 3) AS target FROM r, water
"""
