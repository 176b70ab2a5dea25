"""Text functions as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import let, units

#: White space as the data model counts it: Java's class, no-break space and byte order mark.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

#: Substitutions that repair glyph damage, in order.
GLYPH_FIXES = (("वूफ", "कू"), ("वैफ", "कै"), ("वेफ", "के"), ("वुफ", "कु"), ("अधय", "अध्य"))
#: Words that show text in a legacy font.
LEGACY_WORDS = ("esa", "gSa", "osQ", "fd", "dks", "gS")
LEGACY_WORDS_SHORT = ("esa", "gSa", "osQ", "fd")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_lines(text: Column) -> Column:
    """Lines that are not blank, without spaces at both ends: all of Unicode's separators (Zs), but no tabs or other controls."""
    bare = F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|(?<!\p{Zs})\p{Zs}++\z", ""))
    return F.filter(bare, lambda x: x != "")


def search_tokens(text: Column) -> Column:
    """Lower-cased words of letters, marks and digits, longer than one character."""
    clean = F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{M}\p{N}\s]", " ")
    # longer than one UTF-16 unit: two characters, or one that UTF-8 writes in four bytes
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 1) | (F.octet_length(w) >= 4))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(text_or_empty(html), "<[^>]+>", " ")


def similarity_words(html: Column) -> Column:
    """Words for similarity: tags and named entities go, marks break words apart."""
    bare = F.regexp_replace(strip_tags(html), "(?i)&[a-z]+;", " ")
    clean = F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: w != "")


def word_ngrams(words: Column, n: int = 5) -> Column:
    """Distinct runs of n words; the guard keeps short arrays out of the sequence."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def slugify(text: Column) -> Column:
    low = F.regexp_replace(F.lower(strip(text_or_empty(text))), "^/+|/+$", "")
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify_unicode(text: Column) -> Column:
    """Folder name of a book: without language and download suffixes, words joined by '-'."""
    bare = F.regexp_replace(text_or_empty(text), r"\s*[–-]\s*अंग्रेजी\s*$", "")
    bare = strip(F.regexp_replace(bare, r"\s*\(\d+\)$", ""))
    bare = F.regexp_replace(bare, r"[^\p{L}\p{N}_\s()-]", "")
    made = F.lower(F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "^-+|-+$", ""))
    return F.when(made == "", "book").otherwise(made)


def candidate_slug(topic: Column, exam: Column, kind: str = "notes", year: str = "2026") -> Column:
    return slugify(F.concat_ws(" ", topic, exam, F.lit(kind), F.lit(year)))


def chapter_number(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"_(\d+)\.epub$", 1).try_cast("int"), F.lit(0))


def title_from_folder(slug: Column) -> Column:
    return strip(F.translate(slug, "-()", " "))


def normalize_topic(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text_or_empty(text))), r"\s+", " ")


def fix_glyphs(text: Column) -> Column:
    out = text
    for bad, good in GLYPH_FIXES:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.regexp_replace(out, r"(\d)ण्(?=\d)", "$1.")


def devanagari_ratio(text: Column) -> Column:
    """Share of Devanagari among characters that are not white space; 1 without any."""
    solid = F.regexp_replace(text_or_empty(text), SPACE, "")
    return F.when(F.length(solid) == 0, 1.0).otherwise(F.regexp_count(solid, F.lit(r"[ऀ-ॿ]")) / F.length(solid))


def is_unicode_devanagari(text: Column) -> Column:
    sample = F.substring(text_or_empty(text), 1, 2000)
    solid = F.regexp_replace(sample, SPACE, "")
    return F.when(F.length(solid) == 0, True).otherwise(F.regexp_count(sample, F.lit(r"[ऀ-ॿ]")) / F.length(solid) > 0.15)


def looks_legacy(text: Column) -> Column:
    return F.rlike(text, F.lit(_ascii_words(LEGACY_WORDS_SHORT)))


def _ascii_words(words: tuple[str, ...]) -> str:
    return r"(?<![A-Za-z0-9_])(?:" + "|".join(words) + r")(?![A-Za-z0-9_])"


def legacy_hits(text: Column, unicode_words: bool = False) -> Column:
    """Occurrences of legacy words between ASCII word boundaries, or Unicode ones."""
    edge = (r"(?<![\p{L}\p{N}_])(?:" + "|".join(LEGACY_WORDS) + r")(?![\p{L}\p{N}_])") if unicode_words else _ascii_words(LEGACY_WORDS)
    return F.regexp_count(text_or_empty(text), F.lit(edge))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(plain_words(text))


def quality_flags(text: Column) -> Column:
    """Reasons to look at a chapter: too short, low script share, legacy font."""
    return F.array_compact(F.array(F.when(word_count(text) < 100, "TOO_SHORT"), F.when(devanagari_ratio(text) < 0.5, "LOW_DEVANAGARI"), F.when(legacy_hits(text, True) >= 3, "LEGACY_FONT")))


def legacy_suspicious(text: Column) -> Column:
    hits = legacy_hits(text)
    return (hits > 0) & (hits >= F.greatest(F.lit(2), F.floor(F.greatest(word_count(text), F.lit(1)) / 50)))


def hit_reasons(text: Column, subject: Column, chapter_title: Column, chapter: Column, score: Column) -> Column:
    """Reason codes of a retrieval hit; none means that it is valid."""
    bare = strip(text_or_empty(text))
    blank = lambda c: strip(text_or_empty(c)) == ""
    return F.array_compact(
        F.array(
            F.when(bare == "", "EMPTY_TEXT").when(units(bare) < 20, "TEXT_TOO_SHORT"),
            F.when(blank(subject), "MISSING_SUBJECT"),
            F.when(blank(chapter_title) & blank(chapter), "MISSING_CHAPTER_IDENTITY"),
            F.when(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "SCORE_NOT_A_NUMBER").when(score <= 0, "SCORE_NOT_POSITIVE"),
            F.when(F.rlike(bare, F.lit(r"(?i)</?[a-z][a-z0-9]*[^>]*>")), "LOOKS_LIKE_MARKUP"),
            F.when(legacy_suspicious(bare), F.concat(F.lit("POSSIBLE_KRUTI_DEV_ARTIFACT("), legacy_hits(bare).cast("string"), F.lit(")"))),
        )
    )


def truncate(text: Column, most: int) -> Column:
    bare = strip(text_or_empty(text))
    return F.when(units(bare) > most, F.concat(strip(F.substring(bare, 1, most)), F.lit("…"))).otherwise(bare)


def escape_html(text: Column) -> Column:
    out = text_or_empty(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_fences(text: Column) -> Column:
    return strip(F.replace(F.regexp_replace(text_or_empty(text), r"```(?:json|html)?\s*", ""), F.lit("```"), F.lit("")))


def strip_comments(html: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(html), "(?s)<!--.*?-->", ""))


#: Subjects by folder name, the first rule that fits.
SUBJECT_RULES = (
    ("Hindi", "hindi|हद|कषतज|अतर|बल-रम"),
    ("Geography", "geography|paryaavaran|habitat|bhugol|भगल"),
    ("History", "history|atit|adhith|past|इतहस"),
    ("Science", "^(?!.*social).*science"),
    ("Political Science", "social|rajneeti|samanik|shaamajik|nagrik"),
    ("Maths", "math|ganit|गणत"),
    ("Biology", "biology|jeev|जव"),
    ("Chemistry", "chemistry|rasayan|रसयन"),
    ("Economics", "economics|arthashastra|aarthik|अरथशसतर"),
)


def guess_subject(folder: Column) -> Column:
    low = F.lower(text_or_empty(folder))
    out = F.lit("General")
    for subject, pattern in reversed(SUBJECT_RULES):
        out = F.when(F.rlike(low, F.lit(pattern)), F.lit(subject)).otherwise(out)
    return out


#: Teaching levels.
PRIMARY, UPPER, SENIOR = "Primary (Class 1–5)", "Upper Primary/Secondary (Class 6–10)", "Senior Secondary (Class 11–12)"
LEVEL_UNSTATED = "Not explicitly stated"


#: Words of an exam's name that state its level, the first line that fits.
LEVEL_WORDS = (
    (PRIMARY, ("class 1-5", "class 1–5", "classes 1-5", "class i-v", "primary teacher", "primary (class", "prt")),
    (UPPER, ("class 6-8", "class 6–8", "class 9-10", "class 6-10", "upper primary", "tgt")),
    (SENIOR, ("class 11", "class 12", "senior secondary", "pgt")),
    (UPPER, ("paper ii", "paper 2")),
    (PRIMARY, ("paper i", "paper 1")),
)


def teaching_level(exam: Column) -> Column:
    low = F.lower(text_or_empty(exam))
    fits = [F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), level) for level, words in LEVEL_WORDS]
    return F.coalesce(*fits, F.lit(LEVEL_UNSTATED))


def level_key(label: Column) -> Column:
    return F.when(F.startswith(label, F.lit(PRIMARY)), "primary").when(F.startswith(label, F.lit("Upper Primary/Secondary")), "upper_primary_secondary").when(F.startswith(label, F.lit("Senior Secondary")), "senior_secondary_pgt")


def split_fixed(text: Column, limit: int | Column) -> Column:
    """Pieces of at most ``limit`` UTF-16 units, in order; an astral character stays whole, so a piece may be a unit shorter."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    n = F.ceil(F.length(text) / limit).cast("int")
    plain = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * limit + 1, limit))
    chars = F.split(text, "")
    walk = F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.array().cast("array<string>"),
        lambda a, c: F.when((F.size(a) > 0) & (units(F.concat(F.try_element_at(a, F.lit(-1)), c)) <= limit), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a, F.lit(-1)), c)))).otherwise(F.concat(a, F.array(c))),
    )
    return F.when(F.length(text) == 0, F.array(F.lit(""))).when(units(text) == F.length(text), plain).otherwise(walk)
