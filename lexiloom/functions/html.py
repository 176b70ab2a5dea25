"""HTML checks as native columns; what needs a document tree is in operators.dom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, round_half_up, units
from .text import plain_words, strip, strip_tags, text_or_empty, word_count

#: Fixed values.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
SEO_FIELDS = ("focusKeyword", "seoTitle", "slug", "metaDescription", "h1", "imageAltText", "imagePrompt")
MEMORY_FIELDS = ("concepts_taught", "misconceptions_used", "examples_used", "pedagogical_strategy", "article_shape", "question_types", "sources")
CLICHES = ("delve", "tapestry", "crucial role", "pivotal role", "holistic", "seamless", "comprehensive guide", "game-changer", "unlock", "it is important to note", "furthermore", "moreover")


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(group))


def ids(html: Column) -> Column:
    return find_all(html, r'\sid="([^"]+)"')


def duplicates(items: Column) -> Column:
    """Distinct items that occur more than once, sorted: those that equal their neighbour in the sorted array."""
    return let(F.sort_array(items), lambda s: F.array_distinct(F.array_compact(F.transform(s, lambda x, i: F.when((i > 0) & (x == F.element_at(s, F.greatest(i, F.lit(1)))), x)))))


def hrefs(html: Column) -> Column:
    return find_all(html, r'(?i)<a\b[^>]*href="([^"]*)"')


def prose_words(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text_or_empty(html), r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return word_count(F.regexp_replace(strip_tags(bare), "(?i)&[a-z]+;", " "))


def ad_slots(html: Column) -> Column:
    return F.regexp_count(text_or_empty(html), F.lit(r'id="ad-slot-\d+"'))


def link_counts(html: Column, own_host: str) -> Column:
    """struct(internal, external, total) of the links; own_host is a pattern of the site's host."""
    found = hrefs(html)
    own = lambda h: F.rlike(h, F.lit(f"(?i){own_host}"))
    web = lambda h: F.rlike(h, F.lit("(?i)^https?://"))
    internal = F.size(F.filter(found, lambda h: (~F.startswith(h, F.lit("#")) & ~web(h)) | own(h)))
    return F.struct(internal.alias("internal"), F.size(F.filter(found, lambda h: web(h) & ~own(h))).alias("external"), F.size(found).alias("total"))


def cliche_count(html: Column) -> Column:
    low = F.lower(strip_tags(html))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in CLICHES), F.lit(0))


def paragraph_words(html: Column) -> Column:
    """Number of words of each paragraph, tags left out."""
    return F.transform(find_all(html, r"(?is)<p[^>]*>(.*?)</p>"), lambda p: F.size(plain_words(strip_tags(p))))


def bare_h3(html: Column) -> Column:
    return F.rlike(text_or_empty(html), F.lit(r"(?i)<h3(?![^>]*style=)[^>]*>"))


def tag_issues(html: Column) -> Column:
    """Codes of the tag balance check, by a stack folded over the tags in order.

    A closing tag that finds its partner deeper down closes all that stand
    above it, which is one UNCLOSED_TAG.
    """
    tags = F.filter(find_all(html, r"</?[a-zA-Z][a-zA-Z0-9-]*\b[^>]*>", 0), lambda t: ~F.endswith(t, F.lit("/>")))
    named = F.transform(tags, lambda t: F.struct(F.startswith(t, F.lit("</")).alias("closes"), F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("name")))
    named = F.filter(named, lambda t: ~t["name"].isin(*VOID_ELEMENTS))
    strings = "array<string>"
    start = F.struct(F.array().cast(strings).alias("stack"), F.array().cast(strings).alias("codes"))

    def step(a: Column, t: Column) -> Column:
        stack, codes = a["stack"], a["codes"]
        # the position of the partner, counted from the top
        depth = F.array_position(F.reverse(stack), t["name"])
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - depth.cast("int"), F.lit(0)))
        code = F.when(depth == 0, "UNMATCHED_CLOSING_TAG").when(depth > 1, "UNCLOSED_TAG")
        opened = F.struct(F.concat(stack, F.array(t["name"])).alias("stack"), codes.alias("codes"))
        closed = F.struct(F.when(depth == 0, stack).otherwise(popped).alias("stack"), F.concat(codes, F.array_compact(F.array(code))).alias("codes"))
        return F.when(t["closes"], closed).otherwise(opened)

    return F.aggregate(named, start, step, lambda a: F.concat(a["codes"], F.when(F.size(a["stack"]) > 0, F.array(F.lit("UNCLOSED_TAG_AT_END"))).otherwise(F.array().cast(strings))))


def integrity_issues(html: Column) -> Column:
    """DUPLICATE_ID, BARE_HASH_HREF, BROKEN_ANCHOR and ORPHAN_CITATION, one for each finding."""
    own = ids(html)
    targets = find_all(html, 'href="#([^"]*)"')
    cites, refs = find_all(html, r'id="cite-(\d+)"'), find_all(html, r'id="ref-(\d+)"')
    repeat = lambda items, code: F.transform(items, lambda _: F.lit(code))
    return F.concat(
        repeat(duplicates(own), "DUPLICATE_ID"),
        F.array_compact(F.transform(targets, lambda t: F.when(t == "", "BARE_HASH_HREF").when(~F.array_contains(own, t), "BROKEN_ANCHOR"))),
        repeat(F.filter(cites, lambda n: ~F.array_contains(refs, n)), "ORPHAN_CITATION"),
        F.array_compact(F.array(F.when(F.size(F.array_distinct(refs)) < F.size(refs), "DUPLICATE_ID"))),
    )


def artifact_issues(html: Column) -> Column:
    body = text_or_empty(html)
    return F.array_compact(
        F.array(
            F.when(F.rlike(body, F.lit(r"\{\*\s*type\s*:")), "UNEXPANDED_BLOCK_TAG"),
            F.when(F.rlike(body, F.lit(r"\{[A-Za-z][A-Za-z0-9_]*\([^)]*\)\}")), "UNEXPANDED_MACRO_PLACEHOLDER"),
            F.when(F.rlike(body, F.lit("<<<[A-Z_]+>>>")), "LEAKED_SENTINEL"),
            F.when(F.rlike(body, F.lit(r"(?i)<script\b")), "SCRIPT_TAG"),
        )
    )


def stuffing(html: Column, phrase: Column) -> Column:
    """Whether the phrase makes up more than two occurrences per hundred words."""
    bare = strip_tags(html)
    quoted = F.concat(F.lit("(?i)\\Q"), phrase, F.lit("\\E"))
    return F.coalesce((strip(phrase) != "") & (word_count(bare) > 0) & (F.regexp_count(bare, quoted) / word_count(bare) > 0.02), F.lit(False))


def required_issues(seo: Column, html: Column) -> Column:
    fields = F.array_compact(F.array(*[F.when(F.coalesce(seo[f], F.lit("")) == "", "MISSING_SEO_FIELD") for f in SEO_FIELDS]))
    return F.concat(F.when(seo.isNull(), F.array(F.lit("MISSING_SEO"))).otherwise(fields), F.array_compact(F.array(F.when(units(text_or_empty(html)) < 200, "MISSING_BODY"))))


def bundle_errors(seo: Column, html: Column) -> Column:
    return F.concat(required_issues(seo, html), artifact_issues(html), integrity_issues(html), tag_issues(html))


def bundle_warnings(seo: Column, html: Column, notes: Column, memory: Column) -> Column:
    missing = F.array_compact(F.array(*[F.when(memory[f].isNull(), "MISSING_CM_FIELD") for f in MEMORY_FIELDS], F.when(F.coalesce(memory["flavour"], F.lit("")) == "", "MISSING_CM_FLAVOUR")))
    return F.concat(
        F.array_compact(F.array(F.when(bare_h3(html), "BARE_H3"), F.when(stuffing(html, seo["focusKeyword"]), "POSSIBLE_STUFFING"))),
        F.transform(F.filter(paragraph_words(html), lambda n: n > 130), lambda _: F.lit("LONG_PARAGRAPH")),
        F.array_compact(F.array(F.when(units(strip(text_or_empty(notes))) < 20, "THIN_PUBLISHER_NOTES"))),
        F.when(memory.isNull(), F.array(F.lit("MISSING_CONTENT_MEMORY"))).otherwise(missing),
    )


#: What takes from an article's quality (each error, each warning and their most, a bad length, a bad number of adverts, each cliche and their most) and the weights of overlaps in novelty.
PER_ERROR, PER_WARNING, MOST_WARNINGS, BAD_LENGTH, BAD_ADS, PER_CLICHE, MOST_CLICHES = 0.25, 0.03, 0.3, 0.1, 0.1, 0.05, 0.2
LEAST_WORDS, MOST_WORDS, AD_SLOTS = 3000, 6500, 3
CONCEPTS, EXAMPLES, MISCONCEPTIONS, QUESTIONS, CARDS, LEXICAL = 0.25, 0.2, 0.15, 0.1, 0.15, 0.15


def quality_score(n_errors: Column, n_warnings: Column, words: Column, ads: Column, cliches: Column) -> Column:
    off_length = (words < LEAST_WORDS) | (words > MOST_WORDS)
    penalty = F.least(F.lit(1.0), n_errors * PER_ERROR) + F.least(F.lit(MOST_WARNINGS), n_warnings * PER_WARNING) + F.when(off_length, BAD_LENGTH).otherwise(0.0) + F.when(ads != AD_SLOTS, BAD_ADS).otherwise(0.0) + F.least(F.lit(MOST_CLICHES), cliches * PER_CLICHE)
    return round_half_up(1 - F.least(F.lit(1.0), penalty), 3)


def novelty_score(concepts: Column, examples: Column, misconceptions: Column, questions: Column, cards: Column, lexical: Column) -> Column:
    weighted = concepts * CONCEPTS + examples * EXAMPLES + misconceptions * MISCONCEPTIONS + questions * QUESTIONS + cards * CARDS + lexical * LEXICAL
    return round_half_up(1 - F.least(F.lit(1.0), weighted), 3)


def card_sentences(html: Column) -> Column:
    """Distinct paragraph texts of side cards: divs whose style has a left border."""
    cards = find_all(html, r'(?is)<div\b[^>]*style="[^"]*border-left:\s*\d+px\s+solid[^"]*"[^>]*>(.*?)</div>')
    inner = F.flatten(F.transform(cards, lambda c: F.regexp_extract_all(c, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))))

    def plain(p: Column) -> Column:
        out = F.regexp_replace(p, "<[^>]+>", " ")
        for entity, c in (("nbsp", " "), ("amp", "&"), ("quot", '"')):
            out = F.regexp_replace(out, f"(?i)&{entity};", c)
        return strip(F.regexp_replace(out, r"\s+", " "))

    return F.array_distinct(F.filter(F.transform(inner, plain), lambda p: p != ""))


def heading_shape(html: Column) -> Column:
    found = F.transform(find_all(html, r'(?is)<h2[^>]*id="([^"]+)"[^>]*>(?:.*?)</h2>'), lambda i: F.lower(i))
    return F.filter(found, lambda i: ~i.isin("toc", "table-of-contents"))


def heading_concepts(html: Column) -> Column:
    found = F.transform(find_all(html, "(?is)<h2[^>]*>(.*?)</h2>"), lambda h: strip(F.regexp_replace(strip(F.regexp_replace(strip_tags(h), r"\s+", " ")), r"^[^\p{L}\p{N}]+", "")))
    return F.filter(found, lambda h: h != "")


def cited_hosts(html: Column, allowed: list[str]) -> Column:
    """Distinct hosts of web links that are an allowed domain or below one."""
    hosts = F.transform(find_all(html, r'(?i)<a[^>]+href="(https?://[^"]+)"'), lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)), r"^www\.", ""))
    fits = lambda h: F.lit(False) if not allowed else F.exists(F.array(*map(F.lit, allowed)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))
    return F.array_distinct(F.filter(hosts, fits))


def keyphrase_counts(text: Column, phrase: Column) -> Column:
    """struct(exact, variant, total): whole phrases, and those with hyphens for spaces or the reverse."""
    norm = lambda c: F.regexp_replace(F.lower(strip(text_or_empty(c))), r"\s+", " ")
    hay, key = F.concat(F.lit(" "), norm(text), F.lit(" ")), norm(phrase)
    quoted = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    edge = lambda p: F.concat(F.lit(r"(?<![A-Za-z0-9_])"), p, F.lit(r"(?![A-Za-z0-9_])"))
    exact = F.regexp_count(hay, edge(quoted))
    total = F.regexp_count(hay, edge(F.regexp_replace(quoted, r"[\s-]+", r"[\\s-]+")))
    zero = F.lit(0)
    return F.when(key == "", F.struct(zero.alias("exact"), zero.alias("variant"), zero.alias("total"))).otherwise(F.struct(exact.alias("exact"), F.greatest(zero, total - exact).alias("variant"), total.alias("total")))


#: Words below which a long article fails, and below which it is only flagged.
LONG_LEAST, LONG_SHORT = 2500, 6000


def soft_warnings(html: Column, parsed: Column, short: int = LONG_SHORT) -> Column:
    """Codes of a long article that may be published but should be looked at: those of its parser, and its length."""
    return F.concat(parsed, F.array_compact(F.array(F.when(prose_words(html) < short, "SHORT_ARTICLE"))))


def hard_failures(seo: Column, html: Column, least_words: int = LONG_LEAST) -> Column:
    """Codes that keep a long article from being published."""
    body = text_or_empty(html)
    empty = lambda f: F.coalesce(seo[f], F.lit("")) == ""
    return F.array_compact(
        F.array(
            F.when(units(strip(body)) < 200, "EMPTY_BODY"),
            F.when(F.rlike(body, F.lit(r"(?i)<script[\s>]")), "SCRIPT_TAG"),
            F.when(F.rlike(body, F.lit(r"(?i)\{\*\s*[a-z]+")), "UNEXPANDED_BLOCKS"),
            F.when(empty("focusKeyword"), "MISSING_FOCUS_KEYWORD"),
            F.when(empty("seoTitle"), "MISSING_TITLE"),
            F.when(empty("slug"), "MISSING_SLUG"),
            F.when(prose_words(html) < least_words, "TOO_FEW_WORDS"),
        )
    )
