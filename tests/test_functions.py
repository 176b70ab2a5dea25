"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import html as fh
from lexiloom.functions import numbers as fn
from lexiloom.functions import seo
from lexiloom.functions import text as ft
from lexiloom.operators import editorial


def value(spark, column, text=None, **more):
    fields = {"t": text, **more}
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>' if v and isinstance(v[0], float) else 'array<string>'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("x")).first()[0]


T = F.col("t")


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (ft.search_tokens(T), "कोशिका a Big-Cell 42", ["कोशिका", "big", "cell", "42"]),
        (ft.search_tokens(T), None, []),
        (ft.similarity_words(T), "<b>कोशिका</b>&amp;X y", ["क", "श", "क", "x", "y"]),
        (ft.slugify(T), "/Number System: CTET!/", "number-system-ctet"),
        (ft.slugify_unicode(T), "Science 7 (2) – अंग्रेजी", "science-7"),
        (ft.slugify_unicode(T), "!!", "book"),
        (ft.chapter_number(T), "x_12.epub", 12),
        (ft.chapter_number(T), "x.epub", 0),
        (ft.title_from_folder(T), "a-b(c)", "a bc"),
        (ft.fix_glyphs(T), "2ण्3ण्4 वूफ अधय", "2.3.4 कू अध्य"),
        (ft.devanagari_ratio(T), "", 1.0),
        (ft.devanagari_ratio(T), "क a", 0.5),
        (ft.is_unicode_devanagari(T), "hello world", False),
        (ft.looks_legacy(T), "rke esa gSa", True),
        (ft.legacy_hits(T), "esa gS xesa esax", 2),
        (ft.quality_flags(T), "short", ["TOO_SHORT", "LOW_DEVANAGARI"]),
        (ft.truncate(T, 5), "abcdefgh", "abcde…"),
        (ft.escape_html(T), "<a & \"b\">", "&lt;a &amp; &quot;b&quot;&gt;"),
        (ft.normalize_topic(T), "  A  b\tC ", "a b c"),
        (ft.guess_subject(T), "social-science-7", "Political Science"),
        (ft.guess_subject(T), "science-7", "Science"),
        (ft.guess_subject(T), "misc", "General"),
        (ft.teaching_level(T), "CTET Paper 1", ft.PRIMARY),
        (ft.teaching_level(T), "KVS PGT", ft.SENIOR),
        (ft.level_key(F.lit(ft.UPPER)), None, "upper_primary_secondary"),
        (ft.split_fixed(T, 3), "abcdefg", ["abc", "def", "g"]),
        (ft.split_fixed(T, 3), "a😀😀b", ["a😀", "😀b"]),
        (ft.split_fixed(T, 3), "", [""]),
        (ft.word_ngrams(F.split(T, " "), 5), "a b c", []),
        (ft.word_ngrams(F.split(T, " "), 2), "a b a b", ["a b", "b a"]),
        (ft.strip_comments(T), "a<!-- x\ny -->b", "ab"),
        (ft.strip_fences(T), "```json\n{}\n```", "{}"),
        (fn.units(T), "😀a", 3),
        (fn.code_unit_hash(T), "hello", 99162322),
        (fn.code_unit_hash(T), "polygenelubricants", 2147483648),
        (fn.code_unit_hash(T), "", 0),
        (fn.code_unit_seed(T), "ab", 196),
        (editorial.exam_profile(T)["key"], "DSSSB TGT Maths", "dsssb tgt"),
        (editorial.exam_profile(T)["key"], "Bihar TRE", "bpsc tre"),
        (editorial.exam_profile(T)["key"], " ", "ctet"),
        (editorial.exam_profile(T)["key"], "RAS", None),
    ],
)
def test_text(spark, column, text, want):
    assert value(spark, column, text) == want


def test_numbers(spark):
    ones = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert ones(fn.round_half_up(F.lit(-0.5))) == 0.0 and ones(fn.round_half_up(F.lit(0.125), 2)) == 0.13
    assert ones(fn.kl_term(F.lit(0.5), F.lit(0.0))) == float("inf") and ones(fn.kl_term(F.lit(0.0), F.lit(0.0))) == 0
    assert ones(fn.beta_posterior(F.lit(0), F.lit(8))["mean"]) == pytest.approx(0.1)
    assert ones(fn.beta_posterior(F.lit(0), F.lit(0))["mean"]) == 0.5
    assert 0.5 + ones(fn.exploration_bonus(F.lit(69), F.lit(0))) == pytest.approx(2.567062091905214)
    assert value(spark, fn.ewma(F.col("v")), v=[3.0, 5.0, 4.0]) == pytest.approx(3.72)
    assert value(spark, fn.ewma_series(F.col("v")), v=[3.0, 5.0]) == pytest.approx([3.0, 3.6])


def test_item_overlap(spark):
    j = fn.jaccard(F.col("a"), F.col("b"))
    assert value(spark, j, a=["X ", "y"], b=["x", "Y"]) == 1
    assert value(spark, j, a=["x"], b=["y"]) == 0
    assert value(spark, j, a=[" "], b=[" "]) == 0


BROKEN = '<p id="a">x</p><p id="a">y</p><a href="#gone">z</a><a href="#">q</a><script>1</script><sup id="cite-1">1</sup>'


def test_html_issues(spark):
    assert set(value(spark, fh.integrity_issues(T), BROKEN)) == {"DUPLICATE_ID", "BROKEN_ANCHOR", "BARE_HASH_HREF", "ORPHAN_CITATION"}
    assert value(spark, fh.artifact_issues(T), BROKEN + '{C("a","b")} <<<SEO_JSON>>>') == ["UNEXPANDED_MACRO_PLACEHOLDER", "LEAKED_SENTINEL", "SCRIPT_TAG"]
    assert value(spark, fh.bare_h3(T), "<h3 style='x'>a</h3>") is False
    assert value(spark, fh.bare_h3(T), "<h3>a</h3>") is True
    assert value(spark, fh.paragraph_words(T), "<p>" + "w " * 131 + "</p><P class=x>a <b>b</b></P>") == [131, 2]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<br>b<img src=x></p>", []),
        ("<div><p>a</div>", ["UNCLOSED_TAG"]),
        ("a</b>", ["UNMATCHED_CLOSING_TAG"]),
        ("<div><p>", ["UNCLOSED_TAG_AT_END"]),
        ("<div/><ins></ins>", []),
        ("<div><p><b></div></p>", ["UNCLOSED_TAG", "UNMATCHED_CLOSING_TAG"]),
        (None, []),
    ],
)
def test_tag_balance(spark, html, want):
    assert value(spark, fh.tag_issues(T), html) == want


def test_html_extraction(spark):
    card = '<div style="border-left:6px solid red"><p>One &amp; <b>two</b></p><p> </p><p>One &amp; two</p></div><div style="x"><p>no</p></div>'
    assert value(spark, fh.card_sentences(T), card) == ["One & two"]
    heads = '<h2 id="TOC">Contents</h2><h2 class="x" id="Part-1">★ Part <b>one</b></h2>'
    assert value(spark, fh.heading_shape(T), heads) == ["part-1"]
    assert value(spark, fh.heading_concepts(T), heads) == ["Contents", "Part one"]
    links = '<a href="https://www.ncert.nic.in/x">a</a><a href="http://sub.cbse.gov.in">b</a><a href="https://evil-cbse.gov.in">c</a>'
    assert value(spark, fh.cited_hosts(T, ["ncert.nic.in", "cbse.gov.in"]), links) == ["ncert.nic.in", "sub.cbse.gov.in"]
    counts = value(spark, fh.keyphrase_counts(T, F.lit("number system")), "Number system, number-system; xnumber system")
    assert (counts.exact, counts.total) == (1, 2)
    assert value(spark, fh.stuffing(T, F.lit("a.b")), "a.b " * 3) is True


def test_scores(spark):
    row = spark.createDataFrame([(1, 2, 3200, 3, 0)], "e int, w int, n int, a int, c int")
    assert row.select(fh.quality_score(F.col("e"), F.col("w"), F.col("n"), F.col("a"), F.col("c"))).first()[0] == 0.69
    assert row.select(fh.novelty_score(*[F.lit(1.0)] * 6)).first()[0] == 0.0


def test_search_fields(spark):
    k = F.lit("number system")
    assert value(spark, seo.title_ok(T, k), "Number System Notes") is True
    assert value(spark, seo.title_ok(T, k), "Notes on Number System") is False
    assert value(spark, seo.meta_ok(T, k), "number system " + "x" * 137) is True
    assert value(spark, seo.slug_ok(T, k), "number-system-ctet") is True
    assert value(spark, seo.slug_ok(T, k), "numbers-ctet") is False
    assert value(spark, seo.heading_ok(T, k), "संख्या पद्धति क्या है") is True
    assert value(spark, seo.heading_ok(T, k, 20), "Number system") is True
    assert value(spark, seo.template_leftovers(T, F.lit("{}")), "<p>[insert x] lorem ipsum</p>") == ["TEMPLATE_PLACEHOLDER", "LOREM_IPSUM"]
