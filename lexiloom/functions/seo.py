"""Checks of an article's search fields and of leftover template text, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import keyphrase_counts, strip_tags
from .numbers import units
from .text import strip, text_or_empty


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text_or_empty(c))), r"\s+", " ")


def title_ok(title: Column, phrase: Column) -> Column:
    return (_norm(phrase) != "") & F.startswith(_norm(title), _norm(phrase)) & (units(text_or_empty(title)) <= 60)


def meta_ok(meta: Column, phrase: Column) -> Column:
    return units(text_or_empty(meta)).between(150, 155) & (keyphrase_counts(meta, phrase)["total"] == 1)


def slug_ok(slug: Column, phrase: Column) -> Column:
    words = F.filter(F.split(_norm(phrase), " "), lambda w: w != "")
    parts = F.split(text_or_empty(slug), "-")
    return F.rlike(text_or_empty(slug), F.lit("^[a-z0-9-]{1,74}$")) & F.forall(words, lambda w: F.array_contains(parts, w))


def heading_ok(h1: Column, phrase: Column, hindi_percent: int = 70) -> Column:
    if hindi_percent >= 50:
        return (units(strip(text_or_empty(h1))) >= 10) & F.rlike(text_or_empty(h1), F.lit(r"[\x{0900}-\x{097F}]"))
    return (_norm(phrase) != "") & F.startswith(_norm(h1), _norm(phrase))


def template_leftovers(html: Column, seo_json: Column) -> Column:
    """Codes of template text that should have been replaced."""
    body = text_or_empty(html)
    hay = F.concat(body, F.lit(" "), text_or_empty(seo_json))
    prose = strip(F.regexp_replace(strip_tags(html), r"\s+", " "))
    images = F.regexp_count(body, F.lit(r"(?i)<img[^>]*via\.placeholder\.com[^>]*>"))
    brackets = r"(?i)\[exact keyphrase\]|\[insert[^\]]*\]|\[write here\]|\[entire notes body html\]|\[per formula above[^\]]*\]|\[\s*n\s*\]|\[\s*list[^\]]*\]"
    test = lambda pattern, code, where=body: F.when(F.rlike(where, F.lit(pattern)), code)
    return F.array_compact(
        F.array(
            test(brackets, "TEMPLATE_PLACEHOLDER", hay),
            test(r"^\[[^\]]{1,120}\]$", "ONLY_PLACEHOLDER", prose),
            F.when(images > 1, "PLACEHOLDER_IMAGES"),
            F.when(F.regexp_count(body, F.lit(r"(?i)via\.placeholder\.com")) > images, "PLACEHOLDER_HOST"),
            test("(?i)lorem ipsum", "LOREM_IPSUM"),
            F.when(prose.isin("undefined", "null"), "LITERAL_NULL"),
            test(r"(?i)^\s*(?:html|htm)\s*\n", "FENCE_WORD"),
            test(r'(?i)"kind"\s*:\s*"(grid|flow|timeline|bars|comparison|tree)"', "CHART_JSON", prose),
            test(r"\{[A-Za-z][A-Za-z0-9_]*\([^)]*\)\}", "MACRO"),
        )
    )
