"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

import string

from .licenses import COMMON, LEAST as LEAST_WEIGHT, PHRASES, TEMPLATES
from .quality import METRICS, PRIOR
from .url_filters import GLOBS, RULES

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
SPACED = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WORDS = rf"list_filter(string_split_regex({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def components() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACED.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a)
SELECT s.doc_id, coalesce(n_links, 0) AS n_links, len(g) AS n_shingles, CASE WHEN len(g) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY list_sort(g)) END AS class_id, c.component_id
FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) USING (doc_id)"""


def decontamination(width: int = 10) -> str:
    return f"""WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents), iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, g, size FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {width} + 1, 1) + 1), lambda i: array_to_string(w[i:i+{width - 1}], ' '))) AS g, least(len(w), {width}) AS size FROM iw WHERE len(w) > 0)),
c AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT size FROM ig)),
h AS (SELECT doc_id, i, size, array_to_string(w[i:i+size-1], ' ') AS g FROM c WHERE array_to_string(w[i:i+size-1], ' ') IN (SELECT g FROM ig)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h JOIN ig USING (g)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""


def urls() -> str:
    ranked = sorted(RULES, key=lambda r: (-len(r[1].encode()), r[1]))

    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = {_q(host)} OR ends_with(host, {_q('.' + host)})) AND starts_with(path, {_q('/' + path)})"

    def pattern(glob: str) -> str:
        out, rest = "(?s)", glob
        while rest:
            if rest.startswith("**"):
                out, rest = out + ".*", rest[2:]
            elif rest[0] == "*":
                out, rest = out + "[^/]*", rest[1:]
            else:
                out, rest = out + (rest[0] if rest[0].isalnum() or rest[0] in "/_" else "\\" + rest[0]), rest[1:]
        return out

    rule = " ".join(f"WHEN {fits(r)} THEN {_q(r)}" for _, r in ranked)
    effect = " ".join(f"WHEN rule = {_q(r)} THEN {_q(v)}" for v, r in ranked)
    glob = " ".join(f"WHEN regexp_full_match(s, {_q(pattern(g))}) THEN {_q(g)}" for g in GLOBS)
    return rf"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
e AS (SELECT *, string_split(translate(url_decode(path), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '/')[2:] AS seg, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS bare FROM b),
f AS (SELECT *, list_reduce(list_concat([''], seg), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) || CASE WHEN seg[-1] IN ('.', '..') THEN '/' ELSE '' END AS clean FROM e),
c AS (SELECT page_id, host, path, CASE WHEN host = '' AND path = '' THEN '' ELSE '.' || bare || CASE WHEN clean = '' THEN '/' ELSE clean END END AS s, CASE {rule} END AS rule FROM f),
d AS (SELECT *, CASE {glob} END AS "glob" FROM c)
SELECT page_id, host, path, rule, CASE {effect} WHEN "glob" IS NOT NULL OR (host = '' AND path = '') THEN 'block' ELSE 'allow' END AS verdict, "glob" FROM d"""


def quality() -> str:
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, {_q(k)} AS metric, ({m.value(div='//')})::BIGINT AS v, ({m.value(m.slack, '//')})::BIGINT AS less FROM m WHERE NOT base_failed" for k, m in METRICS.items())
    of = lambda field: "CASE metric " + " ".join(f"WHEN {_q(k)} THEN {getattr(m, field)}" for k, m in METRICS.items()) + " END"
    shrunk = lambda own, parent, keys, on: f"""SELECT {", ".join("g." + c for c in keys)}, p.metric, p.b, coalesce(o.n, 0) * 1000 + (p.n * {1000 * PRIOR}) // p.whole AS n
  FROM (SELECT DISTINCT {", ".join(keys)}, metric FROM {own}) g JOIN (SELECT *, sum(n) OVER (PARTITION BY {", ".join([*on, "metric"])}) AS whole FROM {parent}) p ON {" AND ".join(f"g.{c} IS NOT DISTINCT FROM p.{c}" for c in [*on, "metric"])}
  LEFT JOIN {own} o ON {" AND ".join(f"g.{c} IS NOT DISTINCT FROM o.{c}" for c in keys)} AND o.metric = p.metric AND o.b = p.b"""  # noqa: E731

    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {SPACED.format("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS c FROM u),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
  len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed FROM t JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS ({values}), k AS (SELECT *, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS b FROM v),
g3 AS (SELECT lang, source, metric, b, count(*) AS n FROM k GROUP BY ALL), g2 AS (SELECT lang, metric, b, sum(n) AS n FROM g3 GROUP BY ALL), g1 AS (SELECT metric, b, sum(n) AS n FROM g2 GROUP BY ALL),
s2 AS ({shrunk("g2", "g1", ["lang"], [])}), s3 AS ({shrunk("g3", "s2", ["lang", "source"], ["lang"])}),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY b) AS seen, sum(n) OVER (PARTITION BY lang, source, metric) AS whole FROM s3),
q AS (SELECT lang, source, metric, min(CASE WHEN seen * 100 >= whole * 25 THEN b END) AS lo, min(CASE WHEN seen * 100 >= whole * {of('upper')} THEN b END) AS hi FROM c GROUP BY ALL),
f AS (SELECT *, greatest({of('spread')} * (hi - lo), {of('tolerance')}) AS reach, {of('both_sides')} AS both_sides FROM q),
bad AS (SELECT DISTINCT v.doc_id FROM v JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source AND v.metric = f.metric WHERE v.less > hi + reach OR (both_sides AND v.v < lo - reach))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m"""


def licenses() -> str:
    rows = ", ".join(f"({t}, {_q(label)}, {_q(key)}, {_q(w)}, {at})" for t, (label, notice, key) in enumerate(TEMPLATES) for at, w in enumerate(notice.split()) if w not in COMMON)
    phrase = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, {_q(label)} AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) AS i FROM d) WHERE array_to_string(w[i:i+{len(p.split()) - 1}], ' ') = {_q(p)}" for p, label in PHRASES.items())
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), post(template, label, key, word, pos) AS (VALUES {rows}),
base AS ({phrase}), b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM base GROUP BY doc_id),
seen AS (SELECT * FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE word IN (SELECT word FROM post)),
idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 0.1::DOUBLE AS idf FROM (SELECT DISTINCT word FROM post) LEFT JOIN seen USING (word) GROUP BY word),
wt AS (SELECT post.*, idf.idf AS idf, idf.idf / sum(idf.idf) OVER (PARTITION BY template) AS weight FROM post JOIN idf USING (word)),
rare AS (SELECT template, word FROM (SELECT template, word, round(coalesce(sum(weight) OVER (PARTITION BY template ORDER BY idf DESC, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS seen_before FROM (SELECT template, word, max(idf) AS idf, sum(weight) AS weight FROM wt GROUP BY ALL)) WHERE seen_before <= {1 - LEAST_WEIGHT}::DOUBLE),
cand AS (SELECT DISTINCT doc_id, template FROM seen JOIN rare USING (word)),
sh AS (SELECT s.doc_id, wt.template, label, s.pos - wt.pos AS shift, round(sum(weight), 9) AS weight FROM seen s JOIN wt ON wt.word = s.word JOIN cand ON cand.doc_id = s.doc_id AND cand.template = wt.template JOIN d ON d.doc_id = s.doc_id WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || key || ' ') GROUP BY ALL),
best AS (SELECT doc_id, max(weight) AS best FROM sh GROUP BY doc_id),
lab AS (SELECT DISTINCT doc_id, label FROM base UNION SELECT doc_id, label FROM sh WHERE weight >= {LEAST_WEIGHT}),
agg AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM lab GROUP BY doc_id), bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, least(1.0::DOUBLE, coalesce(round(best, 6), 0)) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN agg USING (doc_id) LEFT JOIN best USING (doc_id)"""


def fixity() -> str:
    head = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || repeat('0', 64) || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)"
    size = f"strlen({head}) + strlen(html) + 4"
    laid = f"SELECT page_id, page_id // 100 AS nr, sha256(html) AS h, copy, sum({size}) OVER (PARTITION BY page_id // 100 ORDER BY page_id, copy) - ({size}) AS start FROM"
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), a AS ({laid} (SELECT *, 1 AS copy FROM p)),
c AS (SELECT page_id, url, CASE WHEN page_id % 97 = 7 AND length(html) > 0 THEN left(html, length(html) - 1) || chr(0) ELSE html END AS html FROM p WHERE page_id % 1000 <> 60),
b AS ({laid} (SELECT *, 1 AS copy FROM c UNION ALL SELECT *, 2 FROM c WHERE page_id % 1000 = 110)),
k AS (SELECT a.page_id, a.nr, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.h <> b.h THEN 'changed' WHEN a.start <> b.start THEN 'moved' END AS kind, a.start AS l, b.start AS r
  FROM a LEFT JOIN (SELECT * FROM b WHERE copy = 1 AND page_id % 1000 <> 230) b USING (page_id)
  UNION ALL SELECT page_id, nr, 'extra', NULL, start FROM b WHERE copy = 2 UNION ALL SELECT NULL, nr, 'broken', NULL, start FROM b WHERE page_id % 1000 = 230)
SELECT page_id, 'pages-' || nr || '.warc' AS file, kind, l::BIGINT AS left_start, r::BIGINT AS right_start FROM k WHERE kind IS NOT NULL"""


def vector_codes(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """For vectors of parts * width components, as the given tables have."""
    xs = [f"x{i}" for i in range(width)]
    apart = " + ".join(f"(p.{x} - b.{x}) * (p.{x} - b.{x})" for x in xs)
    near = f"SELECT p.vec_id, p.label, p.part, min((({apart}) * {entries} + b.k)) AS best FROM p JOIN b{{0}} b USING (part) GROUP BY ALL"
    mean = ", ".join(f"floor(sum(p.{x}) / count(*))::BIGINT AS {x}" for x in xs)
    steps = ""
    for r in range(rounds):
        steps += f"""a{r} AS MATERIALIZED ({near.format(r)}), m{r} AS (SELECT p.part, best % {entries} AS k, {mean} FROM a{r} JOIN p USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.k, {", ".join(f"coalesce(m.{x}, b.{x}) AS {x}" for x in xs)} FROM b{r} b LEFT JOIN m{r} m USING (part, k)),
"""
    return f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, {", ".join(f"floor(256 * embedding[part * {width} + {i + 1}]::DOUBLE)::BIGINT AS {x}" for i, x in enumerate(xs))} FROM e, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, {", ".join(xs)} FROM p QUALIFY k < {entries}),
{steps}z AS MATERIALIZED ({near.format(rounds)}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM z GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, k, i)) AS codebooks_sha256 FROM (SELECT part, k, unnest([{", ".join(xs)}]) AS x, unnest(range({width})) AS i FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h"""


def importance(buckets: int = 10_000, least: int = 20, percent: int = 25, seed: int = 7) -> str:
    """CRC-32 is computed bit by bit, once for each distinct feature."""
    runs = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f"
    byte = "('0x' || substr(x, 2 * (i // 8) + 1, 2))::BIGINT"
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT {WORDS} AS w FROM benchmark),
fd AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, {runs} FROM d) GROUP BY ALL), fb AS (SELECT f, count(*) AS n FROM (SELECT {runs} FROM b) GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
bits AS (SELECT f, list_transform(range(4 * length(x)), lambda i: ({byte} >> (i % 8)) & 1) AS bits FROM x),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda c, z: xor(c >> 1, 3988292384 * (xor(c, z) & 1))), 4294967295) % {buckets} AS k FROM bits),
s AS (SELECT k, sum(n) AS n FROM fd JOIN k USING (f) GROUP BY k), t AS (SELECT k, sum(n) AS n FROM fb JOIN k USING (f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {buckets})::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM fd JOIN k USING (f) JOIN g USING (k) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || doc_id::VARCHAR), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM c WHERE n_words >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * able // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)"""


def near_duplicates(width: int = 2) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {SPACED.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i+{width - 1}], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
