"""Registered queries over names, scripts, pages, packages and prompts, and DuckDB SQL for the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import html as fh
from lexiloom.functions import seo
from lexiloom.functions import text as ft
from lexiloom.operators import cleaning, coverage, dom, editorial, packages, replies, search, similarity
from lexiloom.operators import statistics as st
from lexiloom.plans import prompts
from lexiloom.queries import SQL_HREFS, SQL_LEGACY, SQL_LINES, SQL_SAFETY, SQL_SHINGLES, SQL_STRIPPED, _index, register, sql_half_up, sql_similarity_words, sql_words, table
from lexiloom.session import shared_folder
from lexiloom.sources import files as sources
from lexiloom.sources import sinks

SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def sql_q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{SPACES}+|{SPACES}+$', '', 'g')"


def sql_slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({sql_strip(c)}), '^/+|/+$', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def sql_units(c: str) -> str:
    """UTF-16 units: characters, and one more for each beyond the basic plane."""
    return f"(length({c}) + len(regexp_extract_all({c}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def sql_compact(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


# --- names and texts -------------------------------------------------------


@register(rf"""SELECT doc_id, len({sql_words('text')}) AS words, len({sql_similarity_words('text')}) AS similarity_words, md5({sql_slug('text')}) AS slug_md5,
md5(regexp_replace(lower({sql_strip('text')}), '\s+', ' ', 'g')) AS topic_md5,
CASE WHEN length({sql_strip('text')}) > 80 THEN {sql_strip("left(" + sql_strip('text') + ", 80)")} || '…' ELSE {sql_strip('text')} END AS short,
md5(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5,
greatest(1, ceil(length(coalesce(text, '')) / 1000))::BIGINT AS n_pieces, {SQL_LEGACY.format('text')} AS legacy_hits FROM documents""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        ft.word_count(t).alias("words"),
        F.size(ft.similarity_words(t)).alias("similarity_words"),
        _md5(ft.slugify(t)).alias("slug_md5"),
        _md5(ft.normalize_topic(t)).alias("topic_md5"),
        ft.truncate(t, 80).alias("short"),
        _md5(ft.escape_html(t)).alias("escaped_md5"),
        F.size(ft.split_fixed(ft.text_or_empty(t), 1000)).alias("n_pieces"),
        ft.legacy_hits(t).alias("legacy_hits"),
    )


@register(rf"""WITH a AS (SELECT p_partkey, p_name, p_brand, p_size, ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' – अंग्रेजी ' WHEN p_size % 3 = 1 THEN ' (' || p_size || ')' ELSE '!? ' || p_brand END AS folder FROM part),
b AS (SELECT *, regexp_replace({sql_strip("regexp_replace(regexp_replace(folder, '\\s*[–-]\\s*अंग्रेजी\\s*$', ''), '\\s*\\(\\d+\\)$', '')")}, '[^\p{{L}}\p{{N}}_\s()-]', '', 'g') AS bare FROM a)
SELECT p_partkey, lower(regexp_replace(regexp_replace(bare, '\s+', '-', 'g'), '^-+|-+$', '', 'g')) AS book, {sql_slug("p_name || ' ' || p_brand || ' notes 2026'")} AS candidate,
CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS chapter, translate(replace(p_name, ' ', '-'), '-()', ' ') AS title FROM b""")
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as folder names of books, topics, files of chapters and slugs."""
    size = F.col("p_size")
    folder = F.concat(F.lit(" "), "p_name", F.when(size % 3 == 0, " – अंग्रेजी ").when(size % 3 == 1, F.concat(F.lit(" ("), size.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("!? "), "p_brand")))
    name = F.concat(F.lit("book_"), size.cast("string"), F.when(size % 2 == 0, ".epub").otherwise(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", ft.slugify_unicode(folder).alias("book"), ft.candidate_slug(F.col("p_name"), F.col("p_brand")).alias("candidate"), ft.chapter_number(name).alias("chapter"), ft.title_from_folder(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("title"))


#: Latin letters and the Devanagari ones that stand for them in texts of one language, so that scripts mix.
LATIN, DEVANAGARI = "abcdefghijklmnopqrstuvwxyz", "अबचदएफगहइजकलमनओपणरसतउवयषङझ"
SQL_SCRIPT = f"CASE WHEN lang = 'fr' THEN translate(coalesce(text, ''), '{LATIN}', '{DEVANAGARI}') WHEN lang = 'de' THEN translate(coalesce(text, ''), 'aeiou', 'अएइओउ') || ' 2ण्3 वेफ esa gSa fd fd' ELSE coalesce(text, '') END"


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ft.text_or_empty(F.col("text"))
    mixed = F.when(F.col("lang") == "fr", F.translate(t, LATIN, DEVANAGARI)).when(F.col("lang") == "de", F.concat(F.translate(t, "aeiou", "अएइओउ"), F.lit(" 2ण्3 वेफ esa gSa fd fd"))).otherwise(t)
    return table(spark, sf_dir, "documents").withColumn("text", mixed)


SQL_FIXED = "regexp_replace(" + "".join("replace(" for _ in ft.GLYPH_FIXES) + "s" + "".join(f", '{a}', '{b}')" for a, b in ft.GLYPH_FIXES) + r", '(\d)ण्(\d)', '\1.\2', 'g')"
SQL_UNICODE_HITS = r"len(list_filter(string_split_regex(s, '[^\p{L}\p{N}_]+'), lambda w: w IN ('esa', 'gSa', 'osQ', 'fd', 'dks', 'gS')))"


@register(rf"""WITH t AS (SELECT doc_id, {SQL_SCRIPT} AS s FROM documents), u AS (SELECT doc_id, s, regexp_replace(s, '{SPACES}', '', 'g') AS solid, left(s, 2000) AS head, {SQL_LEGACY.format('s')} AS hits, len({sql_words('s')}) AS words FROM t)
SELECT doc_id, md5({SQL_FIXED}) AS fixed_md5, CASE WHEN solid = '' THEN 1 ELSE round(len(regexp_extract_all(solid, '[ऀ-ॿ]')) / length(solid), 9) END AS ratio,
CASE WHEN regexp_replace(head, '{SPACES}', '', 'g') = '' THEN true ELSE len(regexp_extract_all(head, '[ऀ-ॿ]')) / length(regexp_replace(head, '{SPACES}', '', 'g')) > 0.15 END AS devanagari,
regexp_matches(s, '\b(?:esa|gSa|osQ|fd)\b') AS legacy, hits > 0 AND hits >= greatest(2, floor(greatest(words, 1) / 50)) AS suspicious FROM u""")
def script_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with Devanagari letters and legacy words in them: glyph repair, script ratio, script and font guesses."""
    s = F.col("text")
    return _script(spark, sf_dir).select("doc_id", _md5(ft.fix_glyphs(s)).alias("fixed_md5"), F.round(ft.devanagari_ratio(s), 9).alias("ratio"), ft.is_unicode_devanagari(s).alias("devanagari"), ft.looks_legacy(s).alias("legacy"), ft.legacy_suspicious(s).alias("suspicious"))


@register(rf"""WITH t AS (SELECT source, lang, {SQL_SCRIPT} AS s FROM documents), u AS (SELECT source, lang, s, len({sql_words('s')}) AS w, regexp_replace(s, '{SPACES}', '', 'g') AS solid FROM t),
f AS (SELECT *, w < 100 OR (solid <> '' AND len(regexp_extract_all(solid, '[ऀ-ॿ]')) / length(solid) < 0.5) OR {SQL_UNICODE_HITS} >= 3 AS flagged FROM u)
SELECT source, lang, count(*) AS files, sum(w)::BIGINT AS words, floor(sum(w) / count(*))::BIGINT AS avg_words, count_if(flagged)::BIGINT AS flagged FROM f GROUP BY source, lang""")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus figures by source and language, over texts of mixed scripts."""
    return cleaning.corpus_stats(_script(spark, sf_dir), ["source", "lang"])


#: Names of exams that the rules meet in all their branches.
EXAMS = ("CTET Paper 1", "CTET Paper II", "BPSC TRE Class 6-8", "DSSSB TGT", "KVS PGT", "Bihar TRE", "RAS", "", "UPTET class 11", "nvs", "Primary Teacher", "bpsc")


def _sql_contains(words: tuple[str, ...], c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {sql_q(w)})" for w in words) + ")"


SQL_SUBJECT = "CASE " + " ".join((f"WHEN contains(f, 'science') AND NOT contains(f, 'social') THEN {sql_q(s)}" if s == "Science" else f"WHEN regexp_matches(f, {sql_q(p)}) THEN {sql_q(s)}") for s, p in ft.SUBJECT_RULES) + " ELSE 'General' END"
SQL_LEVEL = "CASE " + " ".join(f"WHEN {_sql_contains(words, 'lower(e)')} THEN {sql_q(level)}" for level, words in ft.LEVEL_WORDS) + f" ELSE {sql_q(ft.LEVEL_UNSTATED)} END"
SQL_PROFILE = "CASE WHEN trim(e) = '' THEN 'ctet' " + " ".join(f"WHEN contains(lower(e), {sql_q(k)}) THEN {sql_q(k)}" for k in sorted(editorial.EXAM_KEYS, key=lambda k: -len(k))) + " WHEN contains(lower(e), 'bihar') AND contains(lower(e), 'tre') THEN 'bpsc tre' END"


@register(rf"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS f, [{', '.join(map(sql_q, EXAMS))}][(doc_id % {len(EXAMS)} + 1)::INT] || ' ' || coalesce(source, '') AS e FROM documents),
b AS (SELECT doc_id, {SQL_SUBJECT} AS subject, {SQL_LEVEL} AS level, {SQL_PROFILE} AS profile FROM a)
SELECT doc_id, subject, level, profile, CASE WHEN starts_with(level, 'Primary') THEN 'primary' WHEN starts_with(level, 'Upper') THEN 'upper_primary_secondary' WHEN starts_with(level, 'Senior') THEN 'senior_secondary_pgt' END AS level_key FROM b""")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over texts as folder names, and over names of exams with the source behind them."""
    exam = F.concat(F.element_at(F.array(*map(F.lit, EXAMS)), (F.col("doc_id") % len(EXAMS) + 1).cast("int")), F.lit(" "), F.coalesce("source", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", ft.guess_subject(F.col("text")).alias("subject"), ft.teaching_level(exam).alias("level"), editorial.exam_profile(exam)["key"].alias("profile"))
    return docs.withColumn("level_key", ft.level_key(F.col("level")))


@register(rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '([A-Za-z]+)', 1) AS k, split_part(coalesce(text, ''), chr(10), 1) AS head FROM documents),
b AS (SELECT *, lower(k) AS n, regexp_replace(lower({sql_strip('head')}), '\s+', ' ', 'g') AS h FROM a),
c AS (SELECT *, CASE WHEN n = '' THEN 0 ELSE len(regexp_extract_all(regexp_replace(lower({sql_strip('t')}), '\s+', ' ', 'g'), '\b' || n || '\b')) END AS exact FROM b)
SELECT doc_id, n <> '' AND starts_with(h, n) AND length(head) <= 60 AS title_ok, n <> '' AND starts_with(h, n) AS h1_ok, length(left(t, 150 + doc_id % 8)) BETWEEN 150 AND 155 AND (CASE WHEN n = '' THEN 0 ELSE len(regexp_extract_all(regexp_replace(lower({sql_strip('left(t, 150 + doc_id % 8)')}), '\s+', ' ', 'g'), '\b' || n || '\b')) END) = 1 AS meta_ok,
regexp_matches({sql_slug('head')}, '^[a-z0-9-]{{1,74}}$') AND (n = '' OR list_contains(string_split({sql_slug('head')}, '-'), n)) AS slug_ok, exact, 0::BIGINT AS variant FROM c""")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a text as title, heading and slug, its beginning as description, and its first word as key phrase."""
    t = ft.text_or_empty(F.col("text"))
    k, head = F.regexp_extract(t, "([A-Za-z]+)", 1), F.element_at(F.split(t, "\n"), 1)
    counts = fh.keyphrase_counts(t, k)
    start = F.left(t, (150 + F.col("doc_id") % 8).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", seo.title_ok(head, k).alias("title_ok"), seo.heading_ok(head, k, 0).alias("h1_ok"), seo.meta_ok(start, k).alias("meta_ok"), seo.slug_ok(ft.slugify(head), k).alias("slug_ok"), counts["exact"].alias("exact"), counts["variant"].alias("variant"))


# --- pages -----------------------------------------------------------------

SQL_TITLE = "regexp_extract(html, '<h1>([A-Za-z]+)', 1)"
SQL_PARAGRAPHS = rf"list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: len(list_filter(string_split_regex(regexp_replace(p, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')))"
SQL_WORDS = rf"len(list_filter(string_split_regex({SQL_STRIPPED}, '\s+'), lambda w: w <> ''))"
SQL_BARE_H3 = "len(regexp_extract_all(html, '(?i)<h3[^>]*>')) > len(regexp_extract_all(html, '(?i)<h3[^>]*style=[^>]*>'))"
SQL_STUFFED = f"({SQL_TITLE} <> '' AND {SQL_WORDS} > 0 AND len(regexp_extract_all({SQL_STRIPPED}, '(?i)' || {SQL_TITLE})) / {SQL_WORDS} > 0.02)"
SQL_WARNINGS = f"(({SQL_BARE_H3})::INT + {SQL_STUFFED}::INT + len(list_filter({SQL_PARAGRAPHS}, lambda n: n > 130)) + (length({sql_strip('url')}) < 20)::INT + 1)"


def _seo_of_page() -> Column:
    """Search fields of a page: its first word as key phrase, its heading and its URL."""
    t = F.col("html")
    title = F.regexp_extract(t, "<h1>([A-Za-z]+)", 1)
    fields = {"focusKeyword": title, "seoTitle": F.regexp_extract(t, "(?s)<title>(.*?)</title>", 1), "slug": ft.slugify(F.col("url")), "metaDescription": F.lit(""), "h1": F.lit(None).cast("string"), "imageAltText": F.lit("a"), "imagePrompt": F.lit("p")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _no_memory() -> Column:
    kinds = ", ".join(f"{f}: array<string>" for f in fh.MEMORY_FIELDS)
    return F.lit(None).cast(f"struct<{kinds}, flavour: string>")


SQL_CLICHES = f"list_sum(list_transform([{', '.join(sql_q(c) for c in fh.CLICHES)}], lambda c: contains(lower({SQL_STRIPPED}), c)::INT))"


@register(rf"""WITH w AS (SELECT page_id, {SQL_WORDS} AS words, regexp_matches(html, '(?i)<script\b')::INT + regexp_matches(html, '\{{[A-Za-z][A-Za-z0-9_]*\([^)]*\)\}}')::INT AS e, {SQL_WARNINGS} AS n_warnings, {SQL_CLICHES} AS c, len(regexp_extract_all(html, 'id="ad-slot-\d+"')) AS ads FROM pages)
SELECT page_id, n_warnings::BIGINT AS n_warnings, {sql_half_up('1 - least(1.0::DOUBLE, least(1.0::DOUBLE, e * 0.25::DOUBLE) + least(0.3::DOUBLE, n_warnings * 0.03::DOUBLE) + CASE WHEN words < 3000 OR words > 6500 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ads <> 3 THEN 0.1::DOUBLE ELSE 0 END + least(0.2::DOUBLE, c * 0.05::DOUBLE))', 3)} AS quality FROM w""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of pages, with leftover marks and scripts as errors, the URL as notes and no memory."""
    h = F.col("html")
    warnings = F.size(fh.bundle_warnings(_seo_of_page(), h, F.col("url"), _no_memory()))
    return table(spark, sf_dir, "pages").select("page_id", warnings.alias("n_warnings"), fh.quality_score(F.size(fh.artifact_issues(h)), warnings, ft.word_count(ft.strip_tags(h)), fh.ad_slots(h), fh.cliche_count(h)).alias("quality"))


@register(rf"""WITH f AS (SELECT page_id, html, {SQL_TITLE} AS k, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, {sql_slug('url')} AS s FROM pages),
p AS (SELECT *, len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z]+;', ' ', 'g'), '\s+'), lambda w: w <> '')) AS words FROM f)
SELECT page_id, array_to_string({sql_compact("CASE WHEN " + sql_units(sql_strip('html')) + " < 200 THEN 'EMPTY_BODY' END", "CASE WHEN regexp_matches(html, '(?i)<script[\\s>]') THEN 'SCRIPT_TAG' END", "CASE WHEN k = '' THEN 'MISSING_FOCUS_KEYWORD' END", "CASE WHEN t = '' THEN 'MISSING_TITLE' END", "CASE WHEN s = '' THEN 'MISSING_SLUG' END", "CASE WHEN words < 400 THEN 'TOO_FEW_WORDS' END")}, ',') AS failures,
array_to_string({sql_compact("'PARSER'", "CASE WHEN words < 800 THEN 'SHORT_ARTICLE' END")}, ',') AS warnings FROM p""")
def long_article_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and soft tier of the gate for long articles, over pages, with limits that pages reach."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fh.hard_failures(_seo_of_page(), h, 400), ",").alias("failures"), F.array_join(fh.soft_warnings(h, F.array(F.lit("PARSER")), 800), ",").alias("warnings"))


@register(rf"""SELECT page_id, array_to_string(list_concat([CASE WHEN k = '' THEN 'MISSING_SEO_FIELD' END, CASE WHEN t = '' THEN 'MISSING_SEO_FIELD' END, CASE WHEN s = '' THEN 'MISSING_SEO_FIELD' END, 'MISSING_SEO_FIELD', 'MISSING_SEO_FIELD'], [CASE WHEN {sql_units('html')} < 200 THEN 'MISSING_BODY' END]), ',') AS required,
len(list_filter({SQL_PARAGRAPHS}, lambda n: n > 130))::BIGINT AS long_paragraphs, length({sql_strip('url')}) < 40 AS thin_notes, {SQL_STUFFED} AS stuffed, regexp_matches(html, '(?i)lorem ipsum') AS lorem
FROM (SELECT page_id, html, url, {SQL_TITLE} AS k, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, {sql_slug('url')} AS s FROM pages)""")
def bundle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields, paragraphs, notes, key phrase and template text of pages as bundles."""
    h, made = F.col("html"), _seo_of_page()
    warnings = fh.bundle_warnings(made, h, F.left(F.col("url"), F.when(F.length(ft.strip(F.col("url"))) < 40, 5).otherwise(60)), _no_memory())
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.array_join(fh.required_issues(made, h), ",").alias("required"),
        F.size(F.filter(warnings, lambda w: w == "LONG_PARAGRAPH")).alias("long_paragraphs"),
        F.array_contains(warnings, "THIN_PUBLISHER_NOTES").alias("thin_notes"),
        F.array_contains(warnings, "POSSIBLE_STUFFING").alias("stuffed"),
        F.array_contains(seo.template_leftovers(h, F.to_json(made)), "LOREM_IPSUM").alias("lorem"),
    )


SQL_ARTICLE = r"""regexp_replace(replace(replace(html, '<h1>', '<h2 id="' || CASE WHEN page_id % 5 = 0 THEN 'toc' ELSE 'Part' || page_id % 7 END || '">★ '), '</h1>', '</h2>'), '(?s)<div class="ad">(.*?)</div>', '<div style="border-left:6px solid red"><p id="c' || page_id % 3 || '">\1</p></div>', 'g') || '<i id="c1"></i><a href="#c2">x</a>'"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles: the heading becomes a section, advert boxes become cards, and an id and an anchor are added."""
    i = F.col("page_id")
    h = F.replace(F.replace("html", F.lit("<h1>"), F.concat(F.lit('<h2 id="'), F.when(i % 5 == 0, "toc").otherwise(F.concat(F.lit("Part"), (i % 7).cast("string"))), F.lit('">★ '))), F.lit("</h1>"), F.lit("</h2>"))
    h = F.regexp_replace(h, F.lit(r'(?s)<div class="ad">(.*?)</div>'), F.concat(F.lit('<div style="border-left:6px solid red"><p id="c'), (i % 3).cast("string"), F.lit('">$1</p></div>')))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(h, F.lit('<i id="c1"></i><a href="#c2">x</a>')))


@register(rf"""WITH a AS (SELECT page_id, {SQL_ARTICLE} AS h FROM pages),
ids AS (SELECT page_id, regexp_extract_all(h, '\sid="([^"]+)"', 1) AS ids, regexp_extract_all(h, 'href="#([^"]*)"', 1) AS refs, regexp_extract_all(h, '(?is)<h2[^>]*id="([^"]+)"[^>]*>(?:.*?)</h2>', 1) AS heads, regexp_extract_all(h, '(?is)<h2[^>]*>(.*?)</h2>', 1) AS inner_,
  regexp_extract_all(h, '(?i)<a[^>]+href="(https?://[^"]+)"', 1) AS urls, list_concat(regexp_extract_all(h, '(?is)<div\b[^>]*style="[^"]*border-left:\s*\d+px\s+solid[^"]*"[^>]*>(.*?)</div>', 1), []) AS cards FROM a)
SELECT page_id AS id, array_to_string(list_filter(list_transform(inner_, lambda x: {sql_strip("regexp_replace(" + sql_strip("regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')") + ", '^[^\\p{L}\\p{N}]+', '')")}), lambda x: x <> ''), '|') AS concepts,
array_to_string(list_filter(list_transform(heads, lambda x: lower(x)), lambda x: x NOT IN ('toc', 'table-of-contents')), '|') AS shape,
array_to_string(list_sort(list_distinct(list_filter(list_transform(urls, lambda u: regexp_replace(lower(regexp_extract(u, '(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '')), lambda x: x = 'example.com' OR ends_with(x, '.example.com')))), '|') AS sources,
md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(cards, lambda c: regexp_extract_all(c, '(?is)<p\b[^>]*>(.*?)</p>', 1))), lambda p: {sql_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&quot;', chr(34), 'g'), '\\s+', ' ', 'g')")}), lambda x: x <> ''))), '|')) AS cards_md5,
(len(list_distinct(list_filter(ids, lambda i: len(list_filter(ids, lambda j: j = i)) > 1))) + len(list_filter(refs, lambda r: r = '' OR NOT list_contains(ids, r))))::BIGINT AS n_issues FROM ids""")
def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History records derived from the HTML of pages as articles."""
    made = _articles(spark, sf_dir).select(F.col("page_id").alias("id"), F.lit("note").alias("type"), F.col("url").alias("topic"), F.lit("s").alias("subject"), F.lit("e").alias("exam"), "html", F.lit("2026").alias("published"))
    records = similarity.derive_records(made, ["example.com"]).join(made.select("id", "html"), "id")
    return records.select("id", F.array_join("concepts_taught", "|").alias("concepts"), F.array_join("article_shape", "|").alias("shape"), F.array_join(F.sort_array("sources"), "|").alias("sources"), _md5(F.array_join(F.sort_array(fh.card_sentences(F.col("html"))), "|")).alias("cards_md5"), F.size(fh.integrity_issues(F.col("html"))).alias("n_issues"))


@register(rf"""WITH RECURSIVE t AS (SELECT page_id, list_filter(regexp_extract_all(coalesce(html, ''), '</?[a-zA-Z][a-zA-Z0-9-]*\b[^>]*>'), lambda x: NOT ends_with(x, '/>')) AS tags FROM pages),
n AS (SELECT page_id, list_filter(list_transform(tags, lambda x: CASE WHEN starts_with(x, '</') THEN '/' ELSE '' END || lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1))), lambda x: ltrim(x, '/') NOT IN ({', '.join(map(sql_q, fh.VOID_ELEMENTS))})) AS names FROM t),
r AS (SELECT page_id, names, 1 AS i, []::VARCHAR[] AS stack, []::VARCHAR[] AS codes FROM n
  UNION ALL SELECT page_id, names, i + 1, CASE WHEN NOT starts_with(names[i], '/') THEN list_append(stack, names[i]) WHEN d > 0 THEN stack[1:len(stack) - d] ELSE stack END,
    CASE WHEN NOT starts_with(names[i], '/') OR d = 1 THEN codes WHEN d > 1 THEN list_append(codes, 'UNCLOSED_TAG') ELSE list_append(codes, 'UNMATCHED_CLOSING_TAG') END
    FROM (SELECT *, coalesce(list_position(list_reverse(stack), names[i][2:]), 0) AS d FROM r WHERE i <= len(names)))
SELECT page_id, array_to_string(list_concat(codes, CASE WHEN len(stack) > 0 THEN ['UNCLOSED_TAG_AT_END'] ELSE [] END), ',') AS issues FROM r WHERE i = len(names) + 1""")
def tag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(fh.tag_issues(F.col("html")), ",").alias("issues"))


# --- packages --------------------------------------------------------------

SQL_PACKAGE = "SELECT doc_id // 10 AS nr, doc_id, coalesce(text, '') AS t, trim(coalesce(text, ''), ' ') AS bare FROM documents"
SQL_PACK_SAFETY = SQL_SAFETY.replace("coalesce(text, '')", "s")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ten documents as one package file, every second of JSON lines; ids that leave 13 when divided by 40 are not text, and every seventh file has no title."""
    i = F.col("doc_id")
    body = F.regexp_replace(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))), r"^\{|\}$", "")
    chunk = F.concat(F.lit('{"id":"d'), i.cast("string"), F.lit('",'), F.when(i % 40 == 13, '"text":5').otherwise(body), F.lit(',"topics":["t"]}'))
    made = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("nr"), i, chunk.alias("chunk")).groupBy("nr").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "chunk"))), lambda x: x["chunk"]).alias("c"))  # ten chunks
    title = F.when(F.col("nr") % 7 == 3, "").otherwise(F.concat(F.lit('"title":"T'), F.col("nr").cast("string"), F.lit('"')))
    head = F.concat(F.lit('{"schema_version":"1","source":{'), title, F.lit("}"))
    lines = F.col("nr") % 2 == 1
    content = F.when(lines, F.concat(head, F.lit("}\n"), F.array_join("c", "\n"))).otherwise(F.concat(head, F.lit(',"chunks":['), F.array_join("c", ","), F.lit("]}")))
    return made.select(F.concat(F.lit("p"), F.col("nr").cast("string"), F.when(lines, ".jsonl").otherwise(".json")).alias("file"), content.cast("binary").alias("content"))


SQL_FILE = "'p' || nr || CASE WHEN nr % 2 = 1 THEN '.jsonl' ELSE '.json' END"
SQL_CHUNK = """'{"id":"d' || doc_id || '",' || CASE WHEN doc_id % 40 = 13 THEN '"text":5' ELSE '"text":' || to_json(t)::VARCHAR END || ',"topics":["t"]}'"""
SQL_HEAD = """'{"schema_version":"1","source":{' || CASE WHEN nr % 7 = 3 THEN '' ELSE '"title":"T' || nr || '"' END || '}'"""
SQL_CONTENT = f"{SQL_HEAD} || CASE WHEN nr % 2 = 1 THEN '}}' || chr(10) || string_agg({SQL_CHUNK}, chr(10) ORDER BY doc_id) ELSE ',\"chunks\":[' || string_agg({SQL_CHUNK}, ',' ORDER BY doc_id) || ']}}' END"
SQL_VERDICTS = f"""WITH d AS ({SQL_PACKAGE}), c AS (SELECT *, doc_id % 40 <> 13 AND bare <> '' AS has, length(bare) AS n FROM d),
g AS (SELECT nr, count(*) AS chunks, count_if(has AND n BETWEEN 10 AND 20000) AS usable, count_if(NOT has) AS no_text, count_if(has AND n < 10) AS short, count_if(has AND n > 20000) AS too_long, count_if(has AND n BETWEEN 8001 AND 20000) AS warned,
  '1' || chr(10) || CASE WHEN nr % 7 = 3 THEN '' ELSE 'T' || nr || chr(10) END || string_agg('d' || doc_id || chr(10) || CASE WHEN doc_id % 40 = 13 THEN '' ELSE t || chr(10) END || 't', chr(10) ORDER BY doc_id) AS s, sha256({SQL_CONTENT}) AS content_hash FROM c GROUP BY nr),
v AS (SELECT *, list_concat(CASE WHEN nr % 7 = 3 THEN ['MISSING_SOURCE_TITLE'] ELSE [] END, list_filter([{SQL_PACK_SAFETY}], lambda x: x IS NOT NULL)) AS own FROM g)"""


@register(SQL_VERDICTS + f""" SELECT {SQL_FILE} AS file, content_hash, CASE WHEN len(own) + no_text + short + too_long = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN nr % 7 <> 3 THEN 'T' || nr END AS source, chunks, usable::BIGINT AS usable_chunks, (len(own) + no_text + short + too_long)::BIGINT AS n_errors,
array_to_string(list_sort(list_distinct(list_concat(own, CASE WHEN no_text > 0 THEN ['MISSING_CHUNK_TEXT'] ELSE [] END, CASE WHEN short > 0 THEN ['CHUNK_TOO_SHORT'] ELSE [] END, CASE WHEN too_long > 0 THEN ['CHUNK_WAY_TOO_LONG'] ELSE [] END))), ',') AS codes, warned::BIGINT AS long_chunks FROM v""")
def package_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over package files made of documents."""
    out = packages.validate(_packages(spark, sf_dir))
    return out.select("file", "content_hash", "status", "source", "chunks", "usable_chunks", F.size("errors").alias("n_errors"), F.array_join(F.sort_array(F.array_distinct("errors")), ",").alias("codes"), F.size(F.filter("warnings", lambda w: w == "CHUNK_LONG")).alias("long_chunks"))


@register(SQL_VERDICTS + """ SELECT 'T' || nr AS source, 'd' || doc_id AS id, md5(t) AS text_md5, 't' AS topics FROM d JOIN (SELECT nr FROM v WHERE len(own) + no_text + short + too_long = 0) USING (nr)""")
def approved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of approved packages, as they are indexed."""
    docs = packages.approved_docs(_packages(spark, sf_dir))
    return docs.select("source", "id", _md5(F.col("text")).alias("text_md5"), F.array_join("topics", ",").alias("topics"))


@register(SQL_VERDICTS + """ SELECT CASE WHEN len(own) + no_text + short + too_long = 0 THEN 'approved' ELSE 'rejected' END AS status, count(*) AS files, sum(chunks)::BIGINT AS chunks FROM v GROUP BY status""")
def package_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and verdicts routed to folders by status, and read back from there."""
    made, target = _packages(spark, sf_dir), f"{shared_folder(spark)}/lexiloom/routed-{uuid.uuid4().hex}"
    sinks.route(made, packages.validate(made), target, "first")
    verdicts = spark.read.json(f"{target}/verdicts").select("file", "chunks", F.col("status").alias("verdict"))
    routed = spark.read.parquet(f"{target}/packages").join(verdicts, "file").where("status = verdict")
    return routed.groupBy("status").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


@register("SELECT nr AS package, left(sha256(string_agg(doc_id || chr(0) || t || chr(0), '' ORDER BY doc_id::VARCHAR)), 16) AS index_version FROM (" + SQL_PACKAGE + ") GROUP BY nr")
def package_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain digest over ids and texts of every ten documents."""
    docs = table(spark, sf_dir, "documents").withColumn("package", F.expr("doc_id div 10"))
    return search.content_version(docs, "doc_id", by=["package"], whole=True)


@register("""SELECT count(*) > 0 AS has_corpus, CASE WHEN count(*) = 0 THEN 'EMPTY_INDEX' WHEN count_if(trim(coalesce(text, '')) = '') > 0 THEN 'BLANK_TEXT' WHEN count(DISTINCT doc_id) <> count(*) THEN 'DUPLICATE_ID' ELSE 'NONE' END AS failure, count(*) AS doc_count FROM documents""")
def index_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first invariant of the published index that does not hold."""
    index = _index(spark, sf_dir)
    failure = packages.index_failure(index.docs.withColumnRenamed("doc_id", "id"), index.df, index.meta)
    return index.meta.select(F.lit(search.has_corpus(index.docs)).alias("has_corpus"), F.lit(failure or "NONE").alias("failure"), "doc_count")


# --- evaluation ------------------------------------------------------------

#: The words of a text that stand for each array field of a record: from and to.
FIELDS = {"concepts_taught": (0, 6), "examples_used": (6, 12), "misconceptions_used": (12, 16), "question_types": (16, 18), "card_sentences_used": (18, 24), "article_shape": (0, 4)}


def _bundles(docs: DataFrame, key: str) -> DataFrame:
    words = ft.similarity_words(F.col("text"))
    fields = [F.slice(words, a + 1, F.lit(b - a)).alias(f) for f, (a, b) in FIELDS.items()]
    return docs.select(F.col(key).alias("id"), *fields, F.coalesce("text", F.lit("")).alias("html"))


def _sql_overlap(field: str) -> str:
    cut = f"list_distinct(w[{FIELDS[field][0] + 1}:{FIELDS[field][1]}])"
    return f"""SELECT x.id, max(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))) AS o FROM (SELECT item_id AS id, {cut} AS s FROM bw) x JOIN (SELECT {cut} AS s FROM dw) y ON len(list_intersect(x.s, y.s)) > 0 GROUP BY x.id"""


SQL_OVERLAPS = ", ".join(f"o{n} AS ({_sql_overlap(f)})" for n, f in enumerate(similarity.NOVELTY_FIELDS))


@register(f"""WITH {SQL_SHINGLES}, {SQL_OVERLAPS}, lex AS (SELECT item_id AS id, max(similarity) AS l FROM sim GROUP BY item_id),
q AS (SELECT h AS item, count(*) / sum(count(*)) OVER () AS q FROM (SELECT unnest(w[1:4]) AS h FROM dw) GROUP BY h), p AS (SELECT id, h AS item, count(*) / sum(count(*)) OVER (PARTITION BY id) AS p FROM (SELECT item_id AS id, unnest(w[1:4]) AS h FROM bw) GROUP BY id, h),
j AS (SELECT k.id, coalesce(p.p, 0) AS x, q.q AS y FROM (SELECT DISTINCT id FROM p) k CROSS JOIN (SELECT item, q FROM q UNION ALL SELECT DISTINCT item, 0 FROM p WHERE item NOT IN (SELECT item FROM q)) q LEFT JOIN p ON p.id = k.id AND p.item = q.item),
d AS (SELECT id, sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2 AS d FROM j GROUP BY id),
r AS (SELECT item_id AS id, {", ".join(f"{sql_half_up(f'coalesce(o{n}.o, 0.0)', 3)} AS v{n}" for n in range(5))}, coalesce(l, 0.0) AS lexical, {sql_half_up('d', 3)} AS divergence FROM bw {" ".join(f"LEFT JOIN o{n} ON o{n}.id = item_id" for n in range(5))} LEFT JOIN lex ON lex.id = item_id LEFT JOIN d ON d.id = item_id)
SELECT id AS cand_id, {", ".join(f"v{n} AS overlap_{f}" for n, f in enumerate(similarity.NOVELTY_FIELDS))}, lexical, divergence, {sql_half_up('1 - divergence', 3)} AS repetitiveness,
{sql_half_up('1 - least(1.0::DOUBLE, v0 * 0.25::DOUBLE + v1 * 0.2::DOUBLE + v2 * 0.15::DOUBLE + v3 * 0.1::DOUBLE + v4 * 0.15::DOUBLE + lexical * 0.15::DOUBLE)', 3)} AS novelty FROM r""")
def candidate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as candidates against documents as history: five overlaps, lexical and structural similarity, novelty."""
    seo_type = "struct<" + ", ".join(f"{f}: string" for f in fh.SEO_FIELDS) + ">"
    cand = _bundles(table(spark, sf_dir, "benchmark"), "item_id").select("*", F.lit(None).cast(seo_type).alias("seo"), F.lit("").alias("publisher_notes"), _no_memory().alias("memory"))
    out = similarity.evaluate(cand, _bundles(table(spark, sf_dir, "documents"), "doc_id"))
    return out.select("cand_id", *[f"overlap_{f}" for f in similarity.NOVELTY_FIELDS], "lexical", "divergence", "repetitiveness", "novelty")


# --- prompts ---------------------------------------------------------------


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a long prompt: a turn is a section for its role, which needs the turn after it."""
    section = F.concat(F.lit("## H"), F.col("turn").cast("string"), F.lit("\n<!-- module: id=m"), F.col("turn").cast("string"), F.lit(" subject="), "role", F.lit(" depends_on=m"), (F.col("turn") + 1).cast("string"), F.lit(" -->\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n## ", "\n# "))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("prompt_id")).agg(F.array_sort(F.collect_list(F.struct("turn", section.alias("s")))).alias("t"))  # the turns of one conversation
    return turns.select("prompt_id", F.array_join(F.transform("t", lambda x: x["s"]), "\n").alias("text"))


SQL_TURNS = r"""t AS (SELECT conv_id, turn, role = 'user' AS fits, '## H' || turn || chr(10) || '<!-- module: id=m' || turn || ' subject=' || role || ' depends_on=m' || (turn + 1) || ' -->' || chr(10) || replace(coalesce(text, ''), chr(10) || '## ', chr(10) || '# ') AS s FROM conversations),
f AS (SELECT conv_id, min(turn) AS first FROM t WHERE fits GROUP BY conv_id), u AS (SELECT t.*, coalesce(turn >= first, false) AS chosen FROM t LEFT JOIN f USING (conv_id))"""


@register(f"""WITH {SQL_TURNS} SELECT conv_id AS prompt_id, coalesce(string_agg('m' || turn, ',' ORDER BY NOT fits, turn) FILTER (WHERE chosen), '') AS selected, coalesce(string_agg('m' || turn, ',' ORDER BY 'm' || turn) FILTER (WHERE NOT chosen), '') AS excluded,
md5(coalesce(string_agg(s, chr(10) ORDER BY NOT fits, turn) FILTER (WHERE chosen), '')) AS prompt_md5, {sql_units("string_agg(s, chr(10) ORDER BY turn)")} AS master_length FROM u GROUP BY conv_id""")
def prompt_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts cut down to the sections for one subject and what those need."""
    out = prompts.assemble(_prompts(spark, sf_dir), subject="user")
    return out.select("prompt_id", F.array_join("selected", ",").alias("selected"), F.array_join("excluded", ",").alias("excluded"), _md5(F.col("prompt")).alias("prompt_md5"), "master_length")


@register(f"""WITH {SQL_TURNS} SELECT conv_id AS prompt_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'H' || turn AS heading, md5(s) AS body_md5, 'm' || turn AS id, 'm' || (turn + 1) AS needs FROM t""")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda name: F.try_element_at(F.try_element_at("meta", F.lit(name)), F.lit(1))
    return prompts.sections(_prompts(spark, sf_dir)).select("prompt_id", "pos", "heading", _md5(F.col("body")).alias("body_md5"), first("id").alias("id"), first("depends_on").alias("needs"))


SQL_STEPS = ", ".join(f"c{k + 1} AS (SELECT *, greatest(1, ceil(n / greatest(1, 400 - (length('[' || c{k} || '/' || c{k} || ']')) - 1)))::BIGINT AS c{k + 1} FROM c{k})" for k in range(5))


@register(f"""WITH c0 AS (SELECT doc_id, coalesce(text, '') AS t, {sql_units("coalesce(text, '')")} AS n, greatest(1, ceil({sql_units("coalesce(text, '')")} / 400))::BIGINT AS c0 FROM documents), {SQL_STEPS},
s AS (SELECT doc_id, t, n, coalesce({", ".join(f"CASE WHEN c{k} = c{k + 1} THEN c{k} END" for k in range(5))}) AS c FROM c5), r AS (SELECT *, greatest(1, 400 - length('[' || c || '/' || c || ']') - 1) AS room FROM s)
SELECT doc_id, i AS index, c AS count, md5('[' || i || '/' || c || ']' || chr(10) || substr(t, (i - 1) * room + 1, room)) AS piece_md5 FROM (SELECT *, unnest(range(1, c + 1)) AS i FROM r)""")
def marked_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to pieces of at most 400 units with a marker in each."""
    out = prompts.marked_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", 400, embed=True)
    return out.select("doc_id", "index", "count", _md5(F.col("piece")).alias("piece_md5"))


@register(rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
b AS (SELECT *, CASE n % 3 WHEN 1 THEN '- **Maths:** ' || line WHEN 2 THEN '- **Hindi:** ' || line ELSE '  ' || line END AS s FROM l), k AS (SELECT * FROM b WHERE n % 3 = 1 OR (n % 3 = 0 AND trim(s) = ''))
SELECT doc_id, count(k.n) AS lines, md5(coalesce(string_agg(s, chr(10) ORDER BY k.n), '')) AS text_md5 FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id HAVING count(k.n) > 0""")
def subject_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts as bullets of two subjects with lines that carry them on: those of one subject stay."""
    lines = F.transform(F.split(ft.text_or_empty(F.col("text")), "\n"), lambda x, i: F.concat(F.when(i % 3 == 0, "- **Maths:** ").when(i % 3 == 1, "- **Hindi:** ").otherwise("  "), x))
    df = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))
    out = prompts.filter_bullets(df, prompts.keep_subject("Maths"), ["doc_id"])
    return out.select("doc_id", F.size(F.split("body", "\n")).alias("lines"), _md5(F.col("body")).alias("text_md5"))


@register("""SELECT p_partkey, 'T: ' || p_name || ' for ' || p_brand || ' / ' || p_name AS filled, 'TOPIC: ' || p_name || chr(10) || 'EXAM TYPE: ' || p_brand || chr(10) || 'SUBJECT: ' || p_type || chr(10) || 'TARGET_YEAR: 2026' || chr(10) || 'LANGUAGE MIX: Hindi ' || p_size || '% + English ' || (100 - p_size) || '%' AS header,
CASE p_type WHEN 'ECONOMY' THEN 'g1,g2,e1' WHEN 'SMALL' THEN 'g1,g2,s1,s2' ELSE 'g1,g2' END AS sources FROM part""")
def prompt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, headers and lists of reference sources for parts as topics."""
    filled = prompts.fill_template(F.lit("T: {{TOPIC}} for {{EXAM}} / {{TOPIC}}"), {"TOPIC": F.col("p_name"), "EXAM": F.col("p_brand")})
    header = prompts.run_header(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"), F.lit(2026))
    own = prompts.reference_sources(F.col("p_type"), ["g1", "g2"], {"ECONOMY": ["e1"], "SMALL": ["s1", "s2"]})
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("filled"), header.alias("header"), F.array_join(own, ",").alias("sources"))


# --- replies, gates of publishing, dashboards ------------------------------


@register(rf"""WITH t AS (SELECT conv_id || '-' || turn AS reply_id, '{{* def: ' || turn || ' *}}' || {sql_strip('text')} || ' [[AD]]{{* end *}}{{*tip*}}x [[WC: 5]][[AD]]' AS raw, {sql_strip('text')} AS s, turn FROM conversations WHERE role = 'assistant')
SELECT reply_id, md5('<div class="block-def"><b>' || turn || '</b><div>' || s || ' <ins id="ad-slot-1"></ins></div></div>' || chr(10) || chr(10) || '<div class="block-tip"><div>x <ins id="ad-slot-2"></ins></div></div>' || chr(10)) AS html_md5, 2::BIGINT AS blocks, 1::BIGINT AS unclosed FROM t""")
def expanded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with block, advert and word count marks around them."""
    raw = F.concat(F.lit("{* def: "), F.col("turn").cast("string"), F.lit(" *}"), ft.strip(F.col("text")), F.lit(" [[AD]]{* end *}{*tip*}x [[WC: 5]][[AD]]"))
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), replies.expand_blocks(raw).alias("x"))
    return turns.select("reply_id", _md5(F.col("x.html")).alias("html_md5"), "x.blocks", "x.unclosed")


@register("""SELECT p_partkey, p_name AS topic, p_brand AS exam FROM part WHERE (p_name, p_brand) NOT IN (SELECT (p_name, p_brand) FROM part WHERE p_size > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def dedupe_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates: large ones are pending by topic and exam, those sold in bulk are published by slug."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("topic"), F.col("p_brand").alias("exam"), F.col("p_partkey").cast("string").alias("slug"), "p_size")
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("slug")).distinct()
    return coverage.not_duplicates(parts, parts.where("p_size > 45"), sold).select("p_partkey", "topic", "exam")


@register("""SELECT 'files_rows' AS check, (SELECT count(*) FROM pages) = (SELECT count(*) FROM documents) AS ok UNION ALL SELECT 'rows_index', true UNION ALL SELECT 'books_present', (SELECT count(*) FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)) = 0""")
def corpus_cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, documents as rows of the corpus, and the published index."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("book"))
    return cleaning.cross_checks(files, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book")), search.index_info(_index(spark, sf_dir)))


@register(f"""WITH c AS (SELECT DISTINCT trim(p_name) AS concept FROM part), t AS (SELECT lower(coalesce(text, '')) AS h FROM documents), s AS (SELECT concept, count_if(contains(h, split_part(concept, ' ', 1))) AS s FROM c CROSS JOIN t GROUP BY concept),
p AS (SELECT concept, {sql_half_up('(1.0 + s) / (2.0 + (SELECT count(*) FROM t))', 2)} AS p FROM s)
SELECT count(*) > 0 AS data_available, {sql_half_up('avg(p)', 2)} AS average_coverage, array_to_string(list_sort(list(concept) FILTER (WHERE p < 0.35)), ',') AS gaps FROM p""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of parts as concepts, looked for in all documents."""
    names = table(spark, sf_dir, "part").select(F.trim("p_name").alias("name")).distinct()
    colours = names.withColumn("concept", F.element_at(F.split("name", " "), 1))
    found = st.coverage_probability(colours, table(spark, sf_dir, "documents").select(F.array("text").alias("concepts_taught")))
    items = colours.join(found, "concept").select(F.col("name").alias("concept"), "coverage_probability")
    return st.coverage_summary(items).select("data_available", "average_coverage", F.array_join("gaps", ",").alias("gaps"))


@register("""SELECT DISTINCT strftime(ts::DATE - INTERVAL 31 DAY, '%Y-%m-%d') AS start, strftime(ts::DATE - INTERVAL 3 DAY, '%Y-%m-%d') AS "end" FROM events""")
def report_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of a search report for every day of events."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.select(sources.search_window(F.col("day")).alias("w")).select("w.start", "w.end")


@register("""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id) <= 30""")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty latest events as files last modified (a top-k report)."""
    files = table(spark, sf_dir, "events").select(F.col("ts").alias("file_modification_time"), F.col("event_id").alias("file_name"), "user_id")
    return similarity.most_recent(files).select(F.col("file_name").alias("event_id"), "user_id")


@register(f"""WITH hist AS (SELECT user_id, event_type AS kind, floor(value)::BIGINT::VARCHAR AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, count(*) AS n, {sql_half_up('(1.0 + count_if(value > 5)) / (2.0 + count(*))', 2)} AS ex, {sql_half_up("(1.0 + count_if(kind <> 'view')) / (2.0 + count(*))", 2)} AS mis, {sql_half_up("(1.0 + count_if(kind = 'click')) / (2.0 + count(*))", 2)} AS qt FROM hist GROUP BY user_id),
c AS (SELECT user_id, {sql_half_up("least(1.0, count(*) / 10.0) * (1.0 + avg(CASE WHEN kind <> 'view' THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END)) / 3", 2)} AS sc FROM hist WHERE seq < 10 GROUP BY user_id),
m AS (SELECT user_id, k, min(seq) AS first FROM hist WHERE kind <> 'view' GROUP BY ALL), u AS (SELECT user_id, count_if(first >= 10) > 0 AS underused FROM m GROUP BY user_id),
g AS (SELECT f.user_id, n, ex, mis, qt, sc, coalesce(underused, false) AS underused, least(1.0::DOUBLE, n / 10.0) AS sample FROM f JOIN c USING (user_id) LEFT JOIN u USING (user_id)),
i AS (SELECT user_id, seq, least(n, 10) AS m, unnest([kind, k]) AS item, unnest([0, 1]) AS pos FROM hist WHERE seq < 10),
aw AS (SELECT user_id, item, sum(m - seq) AS w, min(seq * 10 + pos) AS f FROM i GROUP BY ALL), av AS (SELECT user_id, string_agg(item, ',' ORDER BY w DESC, f) AS avoid, count(*) AS na FROM (SELECT * FROM aw WHERE w >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, f) <= 5) GROUP BY user_id),
h AS (SELECT *, least(1.0::DOUBLE, {sql_half_up('least(1.0::DOUBLE, mis + CASE WHEN underused THEN 0.2::DOUBLE ELSE 0 END)', 2)}) AS depth FROM g)
SELECT user_id, sc AS signature_confidence, {sql_half_up('(sc + sample) / 3', 2)} AS confidence, CASE WHEN underused THEN 'misconception' ELSE 'concept' END AS opening, CASE WHEN underused THEN 'misconception_to_rule' ELSE 'definition_to_application' END AS concept_order,
ex AS example_density, depth AS misconception_depth, qt AS question_integration, {sql_half_up('(ex + depth) / 2 * 0.8', 2)} AS analogy_use, 2.0::DOUBLE AS section_count, 2.0::DOUBLE AS section_count_ewma, CASE WHEN na = 5 THEN avoid END AS avoid_repeating, 'full' AS mode FROM h LEFT JOIN av USING (user_id)""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision document of every user's history, read back from its JSON."""
    from lexiloom.queries import _records

    made = editorial.brief(editorial.genome(editorial.topic_state(_records(spark, sf_dir), ["user_id"]), "user_id"))
    out = editorial.decision_documents(made, ["user_id"])
    doc = F.from_json("document", "mode string, confidence double, statistics struct<section_count_ewma: double>, editorial_brief struct<avoid_repeating: array<string>>, editorial_genome struct<opening: string, concept_order: string, example_density: double, misconception_depth: double, question_integration: double, analogy_use: double, section_count: double>")
    return out.join(made.select("user_id", "signature_confidence"), "user_id").withColumn("d", doc).select("user_id", "signature_confidence", "d.confidence", "d.editorial_genome.*", "d.statistics.section_count_ewma", F.when(F.size("d.editorial_brief.avoid_repeating") == 5, F.array_join("d.editorial_brief.avoid_repeating", ",")).alias("avoid_repeating"), "d.mode")


# --- variety ---------------------------------------------------------------

#: Words of topics and subjects that speak for strategies.
TOPIC_WORDS = ("definition", "vs difference", "history timeline", "process stages cycle", "quiz", "")
SUBJECT_WORDS = ("Maths", "History", "Hindi", "EVS", "CDP", "Art")


def _sql_pick(c: str, words: tuple[str, ...]) -> str:
    return f"[{', '.join(map(sql_q, words))}][{c} % {len(words)} + 1]"


def _sql_selection(name: str, options: tuple[str, ...], score: str, suffix: str, chosen: str) -> str:
    values = ", ".join(f"({n}, {sql_q(o)})" for n, o in enumerate(options))
    return f"""{name}_u AS (SELECT exam, subject, k::VARCHAR AS id, [{', '.join(map(sql_q, options))}][{chosen} + 1] AS v FROM ctx),
{name}_r AS (SELECT k, list(v ORDER BY rn) AS recent FROM (SELECT c.k, u.v, row_number() OVER (PARTITION BY c.k ORDER BY u.id DESC) AS rn FROM ctx c JOIN {name}_u u USING (exam, subject) QUALIFY rn <= {editorial.USED_WINDOW}) GROUP BY k),
{name}_s AS (SELECT k, pos, o, {score} - CASE WHEN list_position(recent, o) > 0 THEN (len(recent) - list_position(recent, o) + 1) * {editorial.REPEAT_PENALTY}::DOUBLE ELSE 0 END AS score, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(topic || '|' || exam || '|' || subject || '{suffix}', ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h
  FROM ctx JOIN {name}_r USING (k) CROSS JOIN (VALUES {values}) t(pos, o)),
{name}_t AS (SELECT *, CASE WHEN h >= 2147483648 THEN abs(h - 4294967296) ELSE h END AS hash, max(score) OVER (PARTITION BY k) AS best, row_number() OVER (PARTITION BY k ORDER BY score DESC, pos) AS rn FROM {name}_s),
{name} AS (SELECT k, list(o ORDER BY rn) FILTER (WHERE score >= best - {editorial.TIE}) AS tied, any_value(hash) AS hash, array_to_string(list(o || '=' || round(score, 3) ORDER BY rn) FILTER (WHERE rn <= 3), ',') AS candidates FROM {name}_t GROUP BY k)"""


_flavours = tuple(f for f, _ in editorial.FLAVOURS)
_hits = "CASE o " + " ".join(f"WHEN {sql_q(f)} THEN len(list_filter([{', '.join(map(sql_q, words))}], lambda w: contains(lower(topic), w)))" for f, words in editorial.FLAVOURS) + " END"
_leaning = " + ".join(f"CASE WHEN {_sql_contains(words, 'lower(subject)')} AND o IN ({', '.join(map(sql_q, options))}) THEN {points}.0::DOUBLE ELSE 0 END" for words, options, points in editorial.SUBJECT_LEANINGS)
_score = f"({_hits} * 3.0::DOUBLE + CASE WHEN o = 'concept-first' THEN 0.1::DOUBLE ELSE 0 END + {_leaning})"


@register(f"""WITH ctx AS (SELECT p_partkey AS k, p_name || ' ' || {_sql_pick('p_size', TOPIC_WORDS)} AS topic, p_brand AS exam, {_sql_pick('p_size', SUBJECT_WORDS)} AS subject, p_size FROM part),
{_sql_selection("f", _flavours, _score, "", f"p_size % {len(_flavours)}")}, {_sql_selection("g", editorial.OPENINGS, "0.0::DOUBLE", "|opening", f"p_size % {len(editorial.OPENINGS)}")}
SELECT f.k AS ctx_id, f.tied[(f.hash % len(f.tied) + 1)::INT] AS flavour, f.candidates, g.tied[(g.hash % len(g.tied) + 1)::INT] AS opening FROM f JOIN g USING (k)""")
def flavour_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teaching strategy and opening for every part as a topic, with the parts of its exam and subject as the history of choices."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_size") % len(words) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ctx_id"), F.concat_ws(" ", "p_name", pick(TOPIC_WORDS)).alias("topic"), F.col("p_brand").alias("exam"), pick(SUBJECT_WORDS).alias("subject"), key.alias("id"), key.alias("published"), pick(_flavours).alias("flavour"), pick(editorial.OPENINGS).alias("openingStyle"))
    contexts = named.select("ctx_id", "topic", "exam", "subject")
    a = editorial.select_flavour(contexts, named).select("ctx_id", F.col("selected").alias("flavour"), F.array_join(F.transform("candidates", lambda c: F.concat(c["id"], F.lit("="), F.round(c["score"], 3).cast("string"))), ",").alias("candidates"))
    b = editorial.select_opening(contexts, named).select("ctx_id", F.col("selected").alias("opening"))
    return a.join(b, "ctx_id")


# --- replies and document trees --------------------------------------------

SQL_BODY = f"'<p>' || replace({sql_strip('text')}, '<', '(') || '</p>'"


@register(rf"""WITH t AS (SELECT conv_id || '-' || turn AS reply_id, turn % 4 AS kind, {SQL_BODY} AS b, turn FROM conversations)
SELECT reply_id, CASE WHEN kind = 3 THEN '' ELSE 'key ' || turn END AS phrase, CASE WHEN kind = 3 THEN '' ELSE 's-' || turn END AS slug, md5(CASE kind WHEN 2 THEN '<h2>A</h2>' || b ELSE b END) AS html_md5,
md5(CASE kind WHEN 0 THEN 'notes' WHEN 1 THEN '=== PUBLISHER NOTES ===' || chr(10) || 'n' WHEN 2 THEN 'END OF NOTES tail' ELSE '' END) AS notes_md5,
CASE kind WHEN 0 THEN 'sentinel-json + sentinel-html' WHEN 1 THEN 'json-fence + body-comments' WHEN 2 THEN 'label-text + h2-scan' ELSE 'label-text + sentinel-html' END AS method, kind = 3 AS truncated FROM t""")
def reply_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw replies in four forms: marked, fenced with comments, labelled with headings, and cut off; each cascade takes another step."""
    n = F.col("turn").cast("string")
    body = F.concat(F.lit("<p>"), F.replace(ft.strip(F.col("text")), F.lit("<"), F.lit("(")), F.lit("</p>"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    json = text('{"focusKeyword":"key ', n, '","seoTitle":"T","slug":"s-', n, '"}')
    forms = (
        text("<<<SEO_JSON>>>{}<<<END_SEO_JSON>>><<<SEO_JSON>>>", json, "<<<END_SEO_JSON>>><<<NOTES_BODY_HTML>>>", body, "<<<END_NOTES_BODY_HTML>>><<<PUBLISHER_NOTES>>>notes<<<END_PUBLISHER_NOTES>>>"),
        text("```json\n", json, "\n```\n<!-- NOTES BODY START -->", body, "<!-- NOTES BODY END -->\n=== PUBLISHER NOTES ===\nn"),
        text("Focus Keyword: **key ", n, "**\nSlug: /S ", n, "/\n<h2>A</h2>", body, "END OF NOTES tail"),
        text("<<<NOTES_BODY_HTML>>>", body),
    )
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, forms[0]).when(kind == 1, forms[1]).when(kind == 2, forms[2]).otherwise(forms[3])
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), raw.alias("raw"))
    out = replies.parse_replies(turns)
    return out.select("reply_id", F.coalesce("seo.focusKeyword", F.lit("")).alias("phrase"), F.coalesce("seo.slug", F.lit("")).alias("slug"), _md5(F.col("html")).alias("html_md5"), _md5(F.col("publisher_notes")).alias("notes_md5"), "method", "truncated")


SQL_OWN = r"regexp_replace(regexp_extract(h, '(?i)^https?://(?:[^/@?#]*@)?([^/:?#]*)', 1), '^www\.', '') = 'example.com'"


@register(rf"""WITH a AS (SELECT page_id, html, {SQL_HREFS} AS hs, regexp_extract_all(html, '(?i)<[a-z][^>]*\sid="([^"]*)"', 1) AS ids, len(regexp_extract_all(html, '(?i)<script[\s>]')) AS scripts, len(regexp_extract_all(html, '(?i)<img[\s>]')) AS imgs, len(regexp_extract_all(html, '(?i)<h3[\s>]')) AS h3 FROM pages),
b AS (SELECT *, len(list_filter(hs, lambda h: trim(h) = '#')) AS bare, len(list_filter(hs, lambda h: starts_with(trim(h), '/') OR (regexp_matches(h, '(?i)^https?://') AND {SQL_OWN}))) AS own, len(list_filter(hs, lambda h: regexp_matches(h, '(?i)^https?://') AND NOT {SQL_OWN})) AS web FROM a)
SELECT page_id, unnest(['image-alt', 'links', 'dup-ids', 'bare-h3', 'no-script', 'citations', 'toc', 'ad-slots']) AS check, unnest([false, own >= 5 AND web >= 2 AND bare = 0, len(ids) = len(list_distinct(ids)), h3 = 0, scripts = 0, false, false, false]) AS ok,
unnest([imgs || ' images', own || ' internal, ' || web || ' external, ' || bare || ' bare', '', h3 || ' bare', scripts || ' scripts', '0 citations, 0 references, 0 and 0 orphans', '0 anchors', '']) AS detail FROM b""")
def dom_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of document trees that SQL can count in the given pages: all but the longest paragraph and the first words, which need a tree."""
    made = dom.checks(table(spark, sf_dir, "pages"), "page_id", own_host="example.com")
    return made.where(~F.col("check").isin("paragraphs", "first-100")).select("page_id", "check", "ok", "detail")


@register(None)
def dom_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of document trees; tests/test_operators.py has the plain version of those that need a tree."""
    return dom.checks(table(spark, sf_dir, "pages"), "page_id", own_host="example.com")


_LINKS = "".join(f'<a href="/p{i}">i</a>' for i in range(5)) + '<a href="https://o.org/">o</a><a href="https://n.org/">n</a>'
_CITES = "".join(f'<sup id="cite-{i}"><a href="#ref-{i}">x</a></sup>' for i in range(4)) + "<ol>" + "".join(f'<li id="ref-{i}">r</li>' for i in range(4)) + "</ol>"
_IMAGE = '<img alt="Number System">'
_NOTE_SEO = '{"focusKeyword":"number system","seoTitle":"Number System Notes","slug":"number-system","metaDescription":"number system ' + "x" * 137 + '","h1":"संख्या पद्धति क्या है"}'


@register(f"""WITH b AS (SELECT page_id, '<p>number system ' || url || '</p>' || CASE WHEN page_id % 3 = 1 THEN '' ELSE '{_IMAGE}' END || '{_LINKS}' || CASE WHEN page_id % 4 = 2 THEN '<script>x</script>' ELSE '' END || '{_CITES}' AS h FROM pages)
SELECT page_id, page_id % 3 <> 1 AND page_id % 4 <> 2 AS publishable, array_to_string({sql_compact("CASE WHEN page_id % 3 = 1 THEN 'image-alt' END", "CASE WHEN page_id % 4 = 2 THEN 'no-script' END")}, ',') AS failed, CASE WHEN page_id % 3 <> 1 AND page_id % 4 <> 2 THEN md5(h) END AS bundle_md5 FROM b""")
def note_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages in notes of which some lack an image and some hold a script, through parser, gate and bundling."""
    i = F.col("page_id")
    body = F.concat(F.lit("<p>number system "), "url", F.lit("</p>"), F.when(i % 3 == 1, "").otherwise(_IMAGE), F.lit(_LINKS), F.when(i % 4 == 2, "<script>x</script>").otherwise(""), F.lit(_CITES))
    raw = F.concat(F.lit(f"<<<SEO_JSON>>>{_NOTE_SEO}<<<END_SEO_JSON>>><<<NOTES_BODY_HTML>>>"), body, F.lit("<<<END_NOTES_BODY_HTML>>>"))
    made = dom.note_bundles(table(spark, sf_dir, "pages").select(i.alias("reply_id"), raw.alias("raw")))
    return made.select(F.col("reply_id").alias("page_id"), "publishable", F.array_join("failed", ",").alias("failed"), _md5(F.col("bundle.html")).alias("bundle_md5"))


# --- sources and sinks -----------------------------------------------------


@register("SELECT doc_id, source AS subject, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a corpus and read back from its CSV; a corpus holds no null texts."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("source").alias("subject"), "doc_id", "text")
    target = f"{shared_folder(spark)}/lexiloom/corpus-{uuid.uuid4().hex}"
    sinks.corpus(docs, target)
    back = sources.csv_rows(spark, f"{target}/csv")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "subject", _md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@register("SELECT trim(p_brand) AS subject, trim(p_name || ', \"' || p_type || '\" ' || p_partkey) AS topic FROM part")
def topic_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a topic list with quotes and commas, and read back."""
    target = f"{shared_folder(spark)}/lexiloom/topics-{uuid.uuid4().hex}"
    topic = F.concat("p_name", F.lit(', "'), "p_type", F.lit('" '), F.col("p_partkey").cast("string"))
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("S.No."), F.col("p_brand").alias("Subject"), topic.alias("Topic")).write.csv(target, header=True, quote='"', escape='"')
    return sources.topic_bank(spark, target)


@register("""SELECT p_name || ' ' || p_type AS query, count_if(l_returnflag = 'R')::DOUBLE AS clicks, count(*)::DOUBLE AS impressions, round(count_if(l_returnflag = 'R') / count(*), 4) AS ctr, round(avg(l_linenumber) * 6, 1) AS position FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search report over sold parts, landed as JSON and read back."""
    target = f"{shared_folder(spark)}/lexiloom/report-{uuid.uuid4().hex}"
    sold = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("q")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("clicks"), F.count("*").cast("double").alias("impressions"), F.avg("l_linenumber").alias("a"))
    rows.select(F.array("q").alias("keys"), "clicks", "impressions", (F.col("clicks") / F.col("impressions")).alias("ctr"), (F.col("a") * 6).alias("position")).write.json(target)
    return sources.search_rows(spark, target)


@register("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of which a manifest lists those labelled as good."""
    records = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name"))
    listed = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("slug"))
    return sources.by_manifest(records, listed).select("doc_id", "lang")


@register("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, the newest first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"))
    return coverage.newest_first(rows)


@register(rf"""SELECT page_id, md5({sql_strip("regexp_replace(html, '(?s)<!--.*?-->', '', 'g')")}) AS comments_md5, md5({sql_strip("replace(regexp_replace('```html ' || chr(10) || html || '```', '```(?:json|html)?\\s*', '', 'g'), '```', '')")}) AS fences_md5 FROM pages""")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without comments, and without the fences that are put around them."""
    fenced = F.concat(F.lit("```html \n"), "html", F.lit("```"))
    return table(spark, sf_dir, "pages").select("page_id", _md5(ft.strip_comments(F.col("html"))).alias("comments_md5"), _md5(ft.strip_fences(fenced)).alias("fences_md5"))
