"""Editorial decisions over histories of published records: variety, signature, state, genome and brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.numbers import clamp, code_unit_hash, round_half_up
from lexiloom.functions.text import truncate

from . import statistics as st

#: Teaching strategies and the words of a topic that speak for them.
FLAVOURS = (
    ("concept-first", ("definition", "concept", "kya hai", "परिभाषा", "अर्थ")),
    ("misconception-first", ("confusion", "galti", "गलती", "mistake", "गलतफहमी")),
    ("problem-first", ("pyq", "question", "solve", "numerical", "केस-स्टडी")),
    ("worked-example", ("calculate", "formula", "सूत्र", "solve", "steps", "method")),
    ("compare-and-contrast", ("vs", "और", "अंतर", "difference", "compare", "तुलना")),
    ("question-led", ("practice", "questions", "अभ्यास", "quiz")),
    ("exam-trap-first", ("trap", "trick", "distractor", "जाल")),
    ("classroom-situation", ("classroom", "teacher", "student", "कक्षा", "शिक्षक", "pedagogy")),
    ("classification", ("types", "kinds", "प्रकार", "classification", "category")),
    ("chronology-cause-effect", ("history", "timeline", "कब", "इतिहास", "causes", "policy")),
    ("revision-focused", ("revision", "recap", "जल्दी", "last-minute", "summary")),
    ("rule-exception", ("exception", "अपवाद", "irregular", "special case", "rule")),
    ("case-to-concept", ("case study", "उदाहरण से", "incident", "example-led")),
    ("evidence-to-conclusion", ("evidence", "प्रमाण", "data", "observation", "सबूत")),
    ("process-first", ("process", "प्रक्रिया", "stages", "mechanism", "cycle")),
)
#: Words of a subject, strategies that they favour, and by how much.
SUBJECT_LEANINGS = (
    (("math",), ("worked-example", "problem-first"), 2),
    (("cdp", "pedagog"), ("classroom-situation", "misconception-first", "case-to-concept"), 2),
    (("history",), ("chronology-cause-effect", "evidence-to-conclusion", "case-to-concept"), 2),
    (("science", "evs", "geography"), ("classification", "process-first", "evidence-to-conclusion"), 2),
    (("hindi", "english", "language"), ("classification", "compare-and-contrast", "rule-exception"), 1),
)
#: Ways to open an article.
OPENINGS = ("question-hook", "stat-or-fact-hook", "scenario-hook", "direct-definition-hook", "provocative-claim-hook", "scope-hook")
#: Exam names that have a profile of their own.
EXAM_KEYS = {"ctet": "CTET", "bpsc tre": "BPSC TRE (Bihar Teacher Recruitment Examination)", "dsssb tgt": "DSSSB TGT", "dsssb prt": "DSSSB PRT", "uptet": "UPTET", "up tgt": "UP TGT", "kvs": "KVS (Kendriya Vidyalaya Sangathan)", "nvs": "NVS (Navodaya Vidyalaya Samiti)", "pgt": "PGT (Post Graduate Teacher, generic)", "tgt": "TGT (Trained Graduate Teacher, generic)", "prt": "PRT (Primary Teacher, generic)"}
TIE, USED_WINDOW, REPEAT_PENALTY = 0.5, 5, 1.5


def exam_profile(exam: Column) -> Column:
    """struct(key, label): the longest known name inside the exam's; blank gives ctet, unknown a null key."""
    norm = F.lower(F.trim(F.coalesce(exam, F.lit(""))))
    made = lambda k: F.struct(F.lit(k).alias("key"), F.lit(EXAM_KEYS[k]).alias("label"))
    generic = F.struct(F.lit(None).cast("string").alias("key"), F.trim(exam).alias("label"))
    out = F.when(F.contains(norm, F.lit("bihar")) & F.contains(norm, F.lit("tre")), made("bpsc tre")).otherwise(generic)
    for key in sorted(reversed(EXAM_KEYS), key=len):  # the longest is tested first, then the order above
        out = F.when(F.contains(norm, F.lit(key)), made(key)).otherwise(out)
    return F.when(norm == "", made("ctet")).otherwise(out)


def flavour_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, list(s)) for n, (f, s) in enumerate(FLAVOURS)], "pos int, option string, signals array<string>")


def opening_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, []) for n, f in enumerate(OPENINGS)], "pos int, option string, signals array<string>")


def recently_used(contexts: DataFrame, records: DataFrame, field: str, n: int = USED_WINDOW) -> DataFrame:
    """ctx_id, recent: the field's values in the n latest records that fit each context, latest first."""
    named = contexts.select("ctx_id", F.col("exam").alias("c_exam"), F.col("subject").alias("c_subject"))
    some = records.where(F.coalesce(field, F.lit("")) != "").select("exam", "subject", "published", "id", F.col(field).alias("_v"))
    last = st.latest_of_contexts(named, some, [F.desc("published"), F.col("id")], n)
    return last.groupBy("ctx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_v"))), lambda x: x["_v"]).alias("recent"))  # n at most


def _select(contexts: DataFrame, catalogue: DataFrame, recent: DataFrame, score: Column, hashed: Column) -> DataFrame:
    """The options of each context by score; the hash picks among those near the best, in score order."""
    pairs = contexts.join(recent, "ctx_id", "left").withColumn("recent", F.coalesce("recent", F.array().cast("array<string>"))).crossJoin(F.broadcast(catalogue))  # a few options each
    at = F.array_position("recent", F.col("option"))
    scored = pairs.withColumn("score", score - F.when(at > 0, (F.size("recent") - at + 1) * REPEAT_PENALTY).otherwise(0.0)).withColumn("hash", hashed)
    listed = scored.groupBy("ctx_id", "recent", "hash").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "pos", "option", "score"))).alias("all"))
    best = F.element_at("all", 1)["score"]
    tied = F.filter("all", lambda x: x["score"] >= best - TIE)
    pick = F.element_at(tied, (F.col("hash") % F.size(tied) + 1).cast("int"))["option"]
    return listed.select("ctx_id", pick.alias("selected"), F.transform(F.slice("all", 1, 3), lambda x: F.struct(x["option"].alias("id"), x["score"].alias("score"))).alias("candidates"), "recent")


def _joined(suffix: str = "") -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat(blank("topic"), F.lit("|"), blank("exam"), F.lit("|"), blank("subject"), F.lit(suffix))


def select_flavour(contexts: DataFrame, records: DataFrame) -> DataFrame:
    """ctx_id, selected, candidates (best 3), recent for contexts (ctx_id, topic, exam, subject)."""
    topic, subject = F.lower(F.coalesce("topic", F.lit(""))), F.lower(F.coalesce("subject", F.lit("")))
    hits = F.size(F.filter("signals", lambda s: F.contains(topic, s)))
    score = hits * 3.0 + F.when(F.col("option") == "concept-first", 0.1).otherwise(0.0)
    for words, options, points in SUBJECT_LEANINGS:
        fits = F.lit(False)
        for w in words:
            fits = fits | F.contains(subject, F.lit(w))
        score = score + F.when(fits & F.col("option").isin(*options), float(points)).otherwise(0.0)
    return _select(contexts, flavour_catalogue(contexts.sparkSession), recently_used(contexts, records, "flavour"), score, code_unit_hash(_joined()))


def select_opening(contexts: DataFrame, records: DataFrame) -> DataFrame:
    return _select(contexts, opening_catalogue(contexts.sparkSession), recently_used(contexts, records, "openingStyle"), F.lit(0.0), code_unit_hash(_joined("|opening")))


def signature(records: DataFrame, by: list[str]) -> DataFrame:
    """by, avoid_concepts, avoid_examples, avoid_card_sentences, underused_misconceptions, confidence.

    records carry seq within each context (see statistics.with_seq).
    """
    last = st.recent(records)
    out = last.groupBy(*by).agg(F.count("*").alias("_n"), ((st.fill_rate("concepts_taught") + st.fill_rate("misconceptions_used") + st.fill_rate("examples_used")) / 3).alias("_rich"))
    for field, name in (("concepts_taught", "avoid_concepts"), ("examples_used", "avoid_examples"), ("card_sentences_used", "avoid_card_sentences")):
        top = st.top_by_weight(st.weighted_counts(last, by, field), by, st.OVERUSED)
        out = out.join(_lists(top, by, name), by, "left")
    lru = st.least_recently_used(st.weighted_counts(records, by, "misconceptions_used"), st.weighted_counts(last, by, "misconceptions_used"), by)
    out = out.join(_lists(lru, by, "underused_misconceptions"), by, "left")
    empty = F.array().cast("array<string>")
    names = ("avoid_concepts", "avoid_examples", "avoid_card_sentences", "underused_misconceptions")
    return out.select(*by, *[F.coalesce(n, empty).alias(n) for n in names], round_half_up(F.least(F.lit(1.0), F.col("_n") / st.RECENT) * F.col("_rich"), 2).alias("confidence"))


def _lists(ranked: DataFrame, by: list[str], name: str) -> DataFrame:
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(name))  # at most TOP items


def structure_state(records: DataFrame, by: list[str]) -> DataFrame:
    """by, sample_size, structural_divergence, structural_repetitiveness, section_count_ewma."""
    def shapes(part: DataFrame) -> DataFrame:
        return part.select(*by, F.explode("article_shape").alias("item"))

    p = st.probabilities(st.frequency(shapes(st.recent(records)), by), by)
    q = st.probabilities(st.frequency(shapes(st.historical(records)), by), by)
    sections = st.ewma_by(records, by, F.size("article_shape").cast("double")).withColumnRenamed("ewma", "_e")
    base = records.groupBy(*by).agg(F.count("*").alias("sample_size")).join(sections, by)
    out = base.join(st.divergence(p, q, by), by, "left").join(st.entropy(p, by).select(*by, "normalized"), by, "left")
    return out.select(*by, "sample_size", F.col("jsd").alias("structural_divergence"), (1 - F.col("normalized")).alias("structural_repetitiveness"), round_half_up(F.col("_e"), 2).alias("section_count_ewma"))


def topic_state(records: DataFrame, by: list[str], evidence: DataFrame | None = None) -> DataFrame:
    """One row for each context: signature, structures, posteriors and confidence.

    evidence (by, provenance: distinct chapters, source_confidence,
    average_coverage, gaps) is joined if given, else absent evidence is 0.
    """
    out = signature(records, by).withColumnRenamed("confidence", "signature_confidence").join(structure_state(records, by), by)
    for field in ("concepts_taught", "examples_used", "misconceptions_used", "question_types"):
        out = out.join(st.fill_posterior(records, by, field).select(*by, round_half_up(F.col("mean"), 2).alias(f"posterior_{field}")), by)
    if evidence is None:
        out = out.select("*", F.lit(0).alias("provenance"), F.lit(0.0).alias("source_confidence"), F.lit(0.0).alias("average_coverage"), F.array().cast("array<string>").alias("gaps"))
    else:
        out = out.join(evidence, by, "left").na.fill({"provenance": 0, "source_confidence": 0.0, "average_coverage": 0.0}).withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))
    sample = F.least(F.lit(1.0), F.col("sample_size") / st.RECENT)
    return out.withColumn("confidence_sample", round_half_up(sample, 2)).withColumn("confidence", round_half_up((F.col("signature_confidence") + F.col("source_confidence") + sample) / 3, 2))


def genome(states: DataFrame, subject: str = "subject") -> DataFrame:
    """states with the eleven editorial decisions derived from them."""
    underused, gap = F.size("underused_misconceptions") > 0, F.size("gaps") > 0
    density = round_half_up(clamp(F.col("posterior_examples_used")), 2)
    depth = round_half_up(clamp(F.col("posterior_misconceptions_used") + F.when(underused, 0.2).otherwise(0.0)), 2)
    repeat = F.coalesce("structural_repetitiveness", F.lit(0.0))
    pedagogy = F.rlike(F.lower(F.coalesce(F.col(subject).cast("string"), F.lit(""))), F.lit("cdp|pedagog"))
    return states.select(
        "*",
        F.when(underused, "misconception").when(gap, "problem").otherwise("concept").alias("opening"),
        F.when(underused, "misconception_to_rule").when(gap, "problem_to_concept").otherwise("definition_to_application").alias("concept_order"),
        density.alias("example_density"),
        round_half_up(clamp(0.6 * repeat + 0.4 * F.least(F.lit(1.0), F.col("provenance") / 3)), 2).alias("comparison_need"),
        round_half_up(F.least(F.lit(1.0), F.col("provenance") / 5), 2).alias("table_need"),
        round_half_up(clamp(density) * F.when(pedagogy, 5).otherwise(2)).alias("classroom_examples"),
        depth.alias("misconception_depth"),
        round_half_up(clamp(F.col("confidence_sample") * F.col("average_coverage")), 2).alias("revision_density"),
        round_half_up(clamp(F.col("posterior_question_types")), 2).alias("question_integration"),
        round_half_up(clamp((density + depth) / 2 * 0.8), 2).alias("analogy_use"),
        F.coalesce(F.greatest(F.lit(1.0), round_half_up(F.col("section_count_ewma"))), F.lit(7.0)).alias("section_count"),
    )


def brief(genomes: DataFrame) -> DataFrame:
    """genomes with teach, clarify, emphasize and avoid_repeating, at most five each, and a text block."""
    avoid = F.slice(F.concat("avoid_concepts", "avoid_examples"), 1, st.TOP)
    line = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, "; ")))
    shape = F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("opening", "concept_order", "example_density", "comparison_need", "table_need", "classroom_examples", "misconception_depth", "revision_density", "question_integration", "analogy_use", "section_count")])
    made = genomes.withColumn("clarify", F.slice("gaps", 1, st.TOP)).withColumn("emphasize", F.slice("underused_misconceptions", 1, st.TOP)).withColumn("avoid_repeating", avoid)
    return made.withColumn("block", F.concat_ws("\n", F.concat(F.lit("EDITORIAL BRIEF (confidence: "), F.col("confidence").cast("string"), F.lit(")")), line("Clarify: ", F.col("clarify")), line("Emphasize: ", F.col("emphasize")), line("Avoid repeating: ", F.col("avoid_repeating")), F.concat(F.lit("Pedagogical shape: "), shape)))


def evidence(hits: DataFrame, by: list[str], top_k: int = 5) -> DataFrame:
    """by, n_valid, n_invalid, all_valid, provenance, chapters, source_confidence, excerpts from ranked hits with reasons (see functions.text.hit_reasons).

    chapters are the distinct chapters of valid hits in the order of their rank.
    """
    valid = F.size("reasons") == 0
    chapter = F.concat_ws("::", F.coalesce("book", F.lit("")), F.coalesce("chapter", "chapter_title", F.lit("")))
    made = hits.groupBy(*by).agg(
        F.count("*").alias("_all"),
        F.count_if(valid).alias("n_valid"),
        F.array_sort(F.collect_list(F.when(valid, F.struct("rank", chapter.alias("chapter"))))).alias("_c"),
        F.array_sort(F.collect_list(F.when(valid & (F.col("rank") <= 3), F.struct("rank", chapter.alias("source"), truncate(F.col("text"), 160).alias("excerpt"))))).alias("excerpts"),
    )  # the top hits of one query
    share = F.least(F.lit(1.0), F.col("n_valid") / top_k) * F.col("n_valid") / F.col("_all")
    chapters = F.array_distinct(F.transform("_c", lambda c: c["chapter"]))
    bad = F.col("_all") - F.col("n_valid")
    return made.select(*by, "n_valid", bad.alias("n_invalid"), (bad == 0).alias("all_valid"), F.size(chapters).alias("provenance"), chapters.alias("chapters"), round_half_up(share, 2).alias("source_confidence"), "excerpts")


def next_post(pairs: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """pairs (exam, subject, used, n_open) ranked by what is least covered and least used."""
    exploit = F.lit(0.5) if coverage is None else F.coalesce(1 - F.col("average_coverage"), F.lit(0.5))
    rows = pairs if coverage is None else pairs.join(coverage, ["exam", "subject"], "left")
    totals = rows.agg(F.sum("used").alias("_t"))
    rows = rows.crossJoin(F.broadcast(totals)).withColumn("id", F.concat_ws("::", "exam", "subject")).withColumn("exploit", exploit.cast("double"))
    scored = rows.withColumn("bonus", st.exploration_bonus(F.col("_t"), F.col("used"))).withColumn("total", F.col("exploit") + F.col("bonus"))
    return scored.drop("_t")


#: The parts of a brief that make up the sections of a decision document.
GENOME = ("opening", "concept_order", "example_density", "comparison_need", "table_need", "classroom_examples", "misconception_depth", "revision_density", "question_integration", "analogy_use", "section_count")
STATISTICS = ("sample_size", "structural_divergence", "structural_repetitiveness", "section_count_ewma", "posterior_concepts_taught", "posterior_examples_used", "posterior_misconceptions_used", "posterior_question_types")


def decision_documents(briefs: DataFrame, by: list[str]) -> DataFrame:
    """by, confidence, document: state, evidence, statistics, genome and brief of each context (see ``brief``) as one JSON record."""
    group = lambda name, columns: F.struct(*columns).alias(name)
    document = F.struct(
        *by,
        F.lit("full").alias("mode"),
        group("evidence", ["provenance", "source_confidence", "average_coverage", "gaps"]),
        group("statistics", STATISTICS),
        group("editorial_genome", GENOME),
        group("editorial_brief", ["clarify", "emphasize", "avoid_repeating", "block"]),
        "confidence",
    )
    return briefs.select(*by, "confidence", F.to_json(document).alias("document"))


def recommendation(ranked: DataFrame, open_topics: DataFrame) -> DataFrame:
    """One row: the best pair of ``next_post`` (exam, subject, total), its first open topic and how many are left; the mode is recommend-only."""
    best = ranked.orderBy(F.desc("total"), "id").limit(1).select("exam", "subject", "total", "n_open")
    first = open_topics.join(F.broadcast(best.select("exam", "subject")), ["exam", "subject"]).groupBy("exam", "subject").agg(F.min("topic").alias("suggestion"))
    return best.join(first, ["exam", "subject"], "left").withColumn("mode", F.lit("recommend-only"))
