"""DuckDB texts for the queries whose rows SQL can express."""

from scenesift.llm import quality as q
from scenesift.llm.line_dedup import MIN_WORDS
from scenesift.llm.mixing import CYCLE

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH rows AS (
  SELECT doc_id, source, len({WORDS}) AS size,
    -ln((('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
      / greatest(CAST(0.1 AS DOUBLE) + CAST(length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS DOUBLE) / greatest(length(coalesce(text, '')), 1), CAST(1e-6 AS DOUBLE)) AS rank
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM rows GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE nth % 3 WHEN 0 THEN {CYCLE[0]} WHEN 1 THEN {CYCLE[1]} ELSE {CYCLE[2]} END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM sizes
), ordered AS (
  SELECT *, most / weight AS full_at, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place FROM weighed
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER upto, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS level
  FROM ordered WINDOW upto AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= full_at) * weight, most)) AS target FROM levels
), dealt AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-12) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY r.source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + CASE WHEN target - epochs * source_size > 0 AND upto - size / CAST(2 AS DOUBLE) <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken
FROM dealt
"""

OP4 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT a, min(b) AS least_b FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least_b, d.doc_id)) AS component_id, d.doc_id <= coalesce(r.least_b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN reach r ON d.doc_id = r.a
"""

OP6 = rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
every_ AS (SELECT d, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM docs),
l AS (
  SELECT d, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER o AS seq,
    sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER o AS upto
  FROM every_ WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY d ORDER BY pos)
), ends AS (
  SELECT a.d, a.seq AS first, min(b.seq) AS last FROM l a JOIN l b ON a.d = b.d AND b.seq BETWEEN a.seq AND a.seq + {MIN_WORDS - 1} AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.d, max(a.seq), b.seq FROM l a JOIN l b ON a.d = b.d AND a.seq BETWEEN b.seq - {MIN_WORDS - 1} AND b.seq AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY b.d, b.seq
), runs AS (
  SELECT e.d, e.first, e.last, string_agg(l.line, chr(10) ORDER BY l.seq) AS run FROM ends e JOIN l ON e.d = l.d AND l.seq BETWEEN e.first AND e.last GROUP BY ALL
), later AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY d, first) > 1),
gone AS (SELECT DISTINCT l.d, l.pos FROM later r JOIN l ON r.d = l.d AND l.seq BETWEEN r.first AND r.last),
kept AS (SELECT e.d, string_agg(e.line, chr(10) ORDER BY e.pos) AS kept FROM every_ e ANTI JOIN gone g ON e.d = g.d AND e.pos = g.pos GROUP BY e.d)
SELECT doc_id, len(lines) AS n_lines, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d) LEFT JOIN (SELECT d, count(*) AS n FROM gone GROUP BY d) g USING (d)
"""


def _js(p: str, ref: str) -> str:
    """Jensen-Shannon distance of two count lists, or null if one is all zero."""
    term = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    shares = f"list_transform(range(1, len({ref}) + 1), lambda i: [{p}[i] / list_sum({p}), {ref}[i] / list_sum({ref})])"
    parts = f"list_transform({shares}, lambda s: {term.format(x='s[1]', y='s[2]')} + {term.format(x='s[2]', y='s[1]')})"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({ref}) > 0 THEN round(sqrt(abs(list_sum({parts}) / 2)), 6) END"


def _class(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))".replace("?'\"", "?''\"")


_COUNTS = [_class(c) for c in q.CLASSES]

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang FROM documents),
b AS (
  SELECT rid, doc_id, lang, {WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_transform([{', '.join(_COUNTS)}, length(text) - ({' + '.join(_COUNTS)})], lambda x: CAST(x AS DOUBLE)) AS c
  FROM d
), win AS (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS k FROM win) WHERE k > 1) GROUP BY rid),
classes AS (SELECT lang, [{', '.join(f'sum(c[{k + 1}])' for k in range(len(_COUNTS) + 1))}] AS rc FROM b GROUP BY lang),
tally AS (SELECT lang, lower(x) AS x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM b) GROUP BY ALL),
common AS (
  SELECT lang, list(x ORDER BY nth) AS rw, list_append(list(CAST(n AS DOUBLE) ORDER BY nth), CAST(any_value(every_n) - sum(n) AS DOUBLE)) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS nth, sum(n) OVER (PARTITION BY lang) AS every_n FROM tally) WHERE nth <= {q.COMMON_WORDS} GROUP BY lang
), j AS (
  SELECT b.*, rc, rn, coalesce(rep.n, 0) AS n_rep, list_transform(rw, lambda r: CAST(len(list_filter(w, lambda x: lower(x) = r)) AS DOUBLE)) AS m0, list_append(m0, len(w) - list_sum(m0)) AS m
  FROM b LEFT JOIN rep USING (rid) JOIN classes k ON b.lang IS NOT DISTINCT FROM k.lang LEFT JOIN common o ON b.lang IS NOT DISTINCT FROM o.lang
), f AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_rep AS n_repeat_words,
    len(w) < 50 OR 100 * n_rep > 50 * len(w) AS base_failed, {_js('c', 'rc')} AS class_distance, CASE WHEN len(w) > 0 AND list_sum(m0) = 0 THEN CAST(1 AS DOUBLE) ELSE {_js('m', 'rn')} END AS word_distance
  FROM j
)
SELECT *, NOT base_failed AND NOT coalesce((n_words >= {q.MIN_WORDS_CLASSES} AND class_distance > {q.MAX_CLASS_DISTANCE}) OR (n_words >= {q.MIN_WORDS_COMMON} AND word_distance > {q.MAX_COMMON_DISTANCE}), false) AS kept
FROM f
"""

OP9 = rf"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host0 FROM u),
x AS (SELECT rid, page_id, {LOWER.format('host0')} AS host, regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT x.*, r.h || r.p AS rule, v FROM x LEFT JOIN r ON (host = r.h OR host LIKE '%.' || r.h) AND starts_with(path, r.p) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(r.h || r.p) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT d, i, array_to_string(w[i : i + 19], ' ') AS x FROM (SELECT d, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT d, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, i) > 1),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT d, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT d, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (d, p) GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (d) LEFT JOIN (SELECT d, count(*) AS n FROM gone GROUP BY d) g USING (d)
"""

OP12 = rf"""
WITH bytes AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
seen AS (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(w) AS x FROM d) GROUP BY ALL),
aims AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM b) GROUP BY x),
words AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM seen UNION SELECT x FROM aims)),
crc AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295) % 10000 AS bucket FROM words, bytes
), counts AS (
  SELECT bucket, sum(s) AS s, sum(t) AS t FROM (
    SELECT bucket, n AS s, 0 AS t FROM seen JOIN crc USING (x) UNION ALL SELECT bucket, 0, n FROM aims JOIN crc USING (x)) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts
), weights AS (SELECT rid, sum(n * gain) AS weight FROM seen JOIN crc USING (x) JOIN gains USING (bucket) GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (rid)
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

_CHAT_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"

OP13 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, length('<|im_start|>' || {_CHAT_ESCAPED.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_CHAT_ESCAPED.format('text')} || '<|im_end|>' || chr(10)) AS n FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP11 = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT arid, anchor_id, rid AS prid, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.arid = n.arid AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW o AS (PARTITION BY p.arid, prid ORDER BY n.score DESC, n.vec_id NULLS LAST) QUALIFY row_number() OVER o <= 3
"""

ORACLES = {
    "op3_mix_sources": OP3,
    "op4_near_dedup": OP4,
    "op6_line_dedup": OP6,
    "op8_quality_rules": OP8,
    "op9_url_filter": OP9,
    "op10_substring_dedup": OP10,
    "op11_hard_negatives": OP11,
    "op12_importance": OP12,
    "op13_chat_format": OP13,
}
