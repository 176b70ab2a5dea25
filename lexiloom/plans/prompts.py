"""Selecting the sections of a long prompt for one context.

A prompt has a few dozen sections at most; the closure over their needs is a
loop of joins that ends when nothing is added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.numbers import let, units
from lexiloom.functions.text import split_fixed, text_or_empty
from lexiloom.session import stored

#: Section headings without metadata, their ids, and tools that they are for.
HEADING_IDS = (
    ("INPUTS", "00_CORE/inputs", None), ("TEACHING LEVEL", "20_LEVELS", None), ("WHO YOU ARE", "00_CORE/roles", None), ("SEED", "60_FLAVOURS/seed-tiebreak", None),
    ("EDITORIAL FLAVOUR", "60_FLAVOURS/selection", None), ("HARD BANS", "00_CORE/honesty", None), ("LANGUAGE", "00_CORE/language", None), ("RAG / SOURCES", "00_CORE/sources", None),
    ("LENGTH", "50_EDITORIAL/depth", None), ("STRUCTURE", "30_SUBJECTS", None), ("PREMIUM HINT", "50_EDITORIAL/misc", None), ("SEO", "40_SEO", None),
    ("VISUAL/HTML SYSTEM", "80_NOTES/html", "notes"), ("SVGs", "80_NOTES/svg", "notes"), ("AD SLOTS", "80_NOTES/ads", "notes"), ("QUESTION TYPE DIVERSITY", "50_EDITORIAL/questions", None),
    ("BEFORE YOU OUTPUT", "90_OUTPUT/prompt-checklist", None), ("OUTPUT FORMAT", "90_OUTPUT/format-pointer", None),
)
#: Words of a subject and the label of its bullet.
SUBJECT_BULLETS = (("maths", "Maths"), ("math", "Maths"), ("science", "EVS/Science"), ("evs", "EVS/Science"), ("history", "History"), ("geography", "Geography"), ("cdp", "CDP/Pedagogy"), ("pedagogy", "CDP/Pedagogy"), ("hindi", "Language"), ("english", "Language"), ("language", "Language"))


def parse_meta(line: Column) -> Column:
    """Map of names to lists from ``<!-- module: a=b,c d=e -->``; null for other lines."""
    inside = F.regexp_extract(F.trim(line), r"^<!--\s*module:\s*(.+?)\s*-->\s*$", 1)
    pairs = F.filter(F.transform(F.split(inside, r"\s+"), lambda p: F.split(p, "=")), lambda p: (F.size(p) >= 2) & (F.element_at(p, 1) != ""))
    return F.when(inside != "", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.element_at(p, 1).alias("key"), F.split(F.element_at(p, 2), ",").alias("value")))))


def sections(df: DataFrame, key: str = "prompt_id", text: str = "text") -> DataFrame:
    """key, pos, heading, body, meta of the parts that begin with '## '."""
    parts = df.select(key, F.posexplode(F.split(text_or_empty(F.col(text)), r"\n(?=## )")).alias("pos", "body"))
    heading = F.trim(F.regexp_extract("body", r"(?m)^## (.+)$", 1))
    second = F.regexp_extract("body", r"(?m)^## .+\n(.*)$", 1)
    return parts.select(key, "pos", F.when(heading == "", "(preamble)").otherwise(heading).alias("heading"), "body", F.when(heading != "", parse_meta(second)).alias("meta"))


def meta_fits(meta: Column, subject: str = "", exam: str = "", level: str = "", tool: str = "") -> Column:
    """A dimension that the section or the context leaves open fits; level and tool must be equal, subject and exam contain a value."""
    out = F.lit(True)
    for name, value in (("subject", subject), ("exam", exam), ("level", level), ("tool", tool)):
        if value:
            low = F.lit(value.lower())
            exact = name in ("level", "tool")
            test = F.exists(F.try_element_at(meta, F.lit(name)), (lambda low: lambda v: low == F.lower(v))(low) if exact else (lambda low: lambda v: F.contains(low, F.lower(v)))(low))
            out = out & F.coalesce(test, F.lit(True))
    return out


def filter_bullets(df: DataFrame, keep: Callable[[Column], Column], key: list[str], text: str = "body") -> DataFrame:
    """key, text: bullets that keep() refuses go, with the lines that continue them, up to a blank line."""
    lines = df.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    bullet, blank = F.startswith("line", F.lit("- ")), F.trim("line") == ""
    # a bullet sets the state, a blank line ends it, other lines carry it on
    state = F.when(bullet, ~keep(F.col("line"))).when(blank, False)
    carried = F.coalesce(F.last(state, ignorenulls=True).over(W.partitionBy(*key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)), F.lit(False))
    left = lines.withColumn("drop", carried).where("not drop")
    return left.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias(text))  # lines of one section


def keep_level(level: str) -> Callable[[Column], Column]:
    label = {"primary": "Primary", "upper_primary_secondary": "Upper Primary", "senior_secondary_pgt": "Senior Secondary"}.get(level)
    return lambda line: F.lit(True) if label is None else F.rlike(line, F.lit(rf"^- \*\*{label}")) | ~F.rlike(line, F.lit(r"^- \*\*(Primary|Upper Primary|Senior Secondary)"))


def keep_subject(subject: str) -> Callable[[Column], Column]:
    label = next((b for w, b in SUBJECT_BULLETS if w in subject.lower()), None)
    wanted = "Other subjects" if label is None else f"{label}|Other subjects"
    return lambda line: F.rlike(line, F.lit(rf"(?i)^- \*\*(?:{wanted}):\*\*"))


def closure(chosen: DataFrame, needs: DataFrame, places: DataFrame) -> DataFrame:
    """prompt_id, id, turn, at, nth of the chosen sections (prompt_id, id) and those that they need, directly or not.

    needs has prompt_id, id, nth and needed; places has prompt_id, id and pos.
    Sections are walked in order of pos, again and again until nothing is
    added; a section that is needed is found in turn ``turn`` by the section at
    ``at`` as its ``nth`` need, and the first way to be found counts.  Chosen
    ones have turn 0.  Cycles end, as a section is found once.  The number of
    rounds is bounded by the longest chain of needs.
    """
    by = ["prompt_id", "id"]
    zero = F.struct(F.lit(0).alias("turn"), F.lit(0).alias("at"), F.lit(0).alias("nth"))
    known = stored(chosen.select(*by).distinct().withColumn("found", zero))
    while True:
        timed = known.join(places, by).withColumn("turn", F.when((F.col("found.turn") > 0) & (F.col("pos") > F.col("found.at")), F.col("found.turn")).otherwise(F.col("found.turn") + 1))
        more = timed.join(needs, by).select("prompt_id", F.col("needed").alias("id"), F.struct("turn", F.col("pos").alias("at"), "nth").alias("found"))
        grown = stored(known.unionByName(more).groupBy(*by).agg(F.min("found").alias("found")))
        if grown.join(known, [*by, "found"], "left_anti").isEmpty():
            return grown.select(*by, "found.*")
        known = grown


def assemble(df: DataFrame, subject: str = "", exam: str = "", level: str = "", tool: str = "") -> DataFrame:
    """One row for one prompt: prompt, selected and excluded ids, master_length, prompt_length."""
    parts = sections(df)
    rule_id, rule_tool = F.lit(None).cast("string"), F.lit(None).cast("string")
    for start, name, only in reversed(HEADING_IDS):
        hit = F.startswith("heading", F.lit(start))
        rule_id, rule_tool = F.when(hit, F.lit(name)).otherwise(rule_id), F.when(hit, F.lit(only)).otherwise(rule_tool)
    own = F.coalesce(F.try_element_at(F.try_element_at("meta", F.lit("id")), F.lit(1)), F.when(F.col("meta").isNotNull(), F.col("heading")))
    preamble = F.col("heading") == "(preamble)"
    made = parts.withColumn("id", F.when(preamble, "00_CORE/title").otherwise(F.coalesce(own, rule_id, F.concat(F.lit("(unmapped): "), F.col("heading")))))
    for_tool = F.lit(True) if not tool else F.coalesce(rule_tool == tool, F.lit(True))
    fits = F.when(preamble, True).when(F.col("meta").isNotNull(), meta_fits(F.col("meta"), subject, exam, level, tool)).otherwise(for_tool)
    made = made.withColumn("fits", fits)
    trims = {"20_LEVELS": keep_level(level), "30_SUBJECTS": keep_subject(subject)}
    plain = made.where(F.col("meta").isNotNull() | ~F.col("id").isin(*trims))
    for name, keep in trims.items():
        some = made.where(F.col("meta").isNull() & (F.col("id") == name))
        cut = filter_bullets(some.select("prompt_id", "pos", "body"), keep, ["prompt_id", "pos"])
        plain = plain.unionByName(some.drop("body").join(cut, ["prompt_id", "pos"]).select(*plain.columns))
    title = F.coalesce(F.try_element_at(F.filter(F.split("body", "\n"), lambda x: F.startswith(x, F.lit("# "))), F.lit(1)), F.lit(""))
    plain = plain.withColumn("body", F.when(preamble, title).otherwise(F.col("body")))
    named = made.where("meta is not null").select("prompt_id", "id", F.posexplode(F.try_element_at("meta", F.lit("depends_on"))).alias("nth", "needed"))
    needs = named.join(made.where("meta is not null").select("prompt_id", F.col("id").alias("needed")).distinct(), ["prompt_id", "needed"], "left_semi")
    known = closure(plain.where("fits").select("prompt_id", "id"), needs, made.groupBy("prompt_id", "id").agg(F.min("pos").alias("pos")))
    marked = plain.join(known, ["prompt_id", "id"], "left").withColumn("chosen", F.col("turn").isNotNull() & (F.col("fits") | F.col("meta").isNotNull()))
    # sections that were only needed follow those that fit, in the order in which they are found
    late = F.when(F.col("fits"), F.struct(F.lit(0).alias("turn"), F.lit(0).alias("at"), F.lit(0).alias("nth"))).otherwise(F.struct("turn", "at", "nth"))
    listed = F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct(late.alias("late"), "pos", "id", "body"))))
    out = marked.groupBy("prompt_id").agg(listed.alias("l"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), F.col("id")))).alias("excluded"))
    master = df.select("prompt_id", units(F.col("text")).alias("master_length"))
    prompt = F.array_join(F.transform("l", lambda x: x["body"]), "\n")
    return out.join(master, "prompt_id").select("prompt_id", prompt.alias("prompt"), F.transform("l", lambda x: x["id"]).alias("selected"), "excluded", "master_length", units(prompt).alias("prompt_length"))


def diagnostic(assembled: DataFrame) -> DataFrame:
    saved = F.when(F.col("master_length") > 0, F.floor((1 - F.col("prompt_length") / F.col("master_length")) * 100 + 0.5)).otherwise(0)
    return assembled.select("prompt_id", F.concat_ws("\n", F.concat(F.lit("MASTER PROMPT SIZE: "), "master_length"), F.concat(F.lit("SELECTED: "), F.array_join("selected", ", ")), F.concat(F.lit("EXCLUDED: "), F.array_join("excluded", ", ")), F.concat(F.lit("RUNTIME PROMPT SIZE: "), "prompt_length", F.lit(" ("), saved.cast("string"), F.lit("% smaller)"))).alias("diagnostic"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replaces each {{NAME}} by its value; a null value is an empty text."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def run_header(topic: Column, exam: Column, subject: Column, hindi_percent: Column, year: Column) -> Column:
    """The block of input variables that stands before a prompt."""
    row = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")))
    return F.concat_ws("\n", row("TOPIC", topic), row("EXAM TYPE", exam), row("SUBJECT", subject), row("TARGET_YEAR", year), F.concat(F.lit("LANGUAGE MIX: Hindi "), hindi_percent.cast("string"), F.lit("% + English "), (100 - hindi_percent).cast("string"), F.lit("%")))


def reference_sources(subject: Column, general: list[str], by_subject: dict[str, list[str]]) -> Column:
    """The general list of sources and the subject's own."""
    own = F.create_map(*[x for k, v in by_subject.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if by_subject else F.lit(None).cast("map<string,array<string>>")
    return F.concat(F.array(*map(F.lit, general)).cast("array<string>"), F.coalesce(F.try_element_at(own, subject), F.array().cast("array<string>")))


def numbered_marker(index: Column, count: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("/"), count.cast("string"), F.lit("]"))


def marked_pieces(df: DataFrame, key: str, text: str, limit: int, marker: Callable[[Column, Column], Column] = numbered_marker, embed: bool = False) -> DataFrame:
    """key, index, count, marker, piece: each text cut to at most ``limit`` UTF-16 units, from index 1; an empty text is one piece.

    An embedded marker stands on a line of its own before the piece and takes
    room from it, so the number of pieces, on which the marker's length
    depends, is settled first, in at most five steps; it is an error if it does
    not settle.
    """
    whole = text_or_empty(F.col(text))
    size = lambda count: F.greatest(F.lit(1), F.lit(limit) - units(marker(count, count)) - 1)
    count = lambda room: F.greatest(F.lit(1), F.ceil(units(whole) / room)).cast("int")

    def settled(guess: Column, steps: int) -> Column:
        """The first count that gives itself, as the room that its markers leave."""
        failed = F.raise_error(F.lit("the number of pieces does not settle")).cast("int")
        return let(guess, lambda c: let(count(size(c)), lambda d: F.when(c == d, size(c)).otherwise(settled(d, steps - 1) if steps > 1 else failed)))

    pieces = let(settled(count(F.lit(limit)), 5), lambda room: split_fixed(whole, room)) if embed else split_fixed(whole, limit)
    cut = df.select(key, pieces.alias("pieces"))
    each = cut.select(key, F.size("pieces").alias("count"), F.posexplode("pieces").alias("index", "piece")).withColumn("index", F.col("index") + 1)
    mark = marker(F.col("index"), F.col("count"))
    return each.select(key, "index", "count", mark.alias("marker"), (F.concat(mark, F.lit("\n"), F.col("piece")) if embed else F.col("piece")).alias("piece"))
