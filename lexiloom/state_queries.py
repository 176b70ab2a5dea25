"""Registered queries over stored states and tables that take changes, and DuckDB SQL for the same results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import html as fh
from lexiloom.more_queries import _bundles
from lexiloom.operators import cleaning, dom, packages, similarity, states
from lexiloom.operators import statistics as st
from lexiloom.queries import _index, register, sql_half_up, sql_words, table
from lexiloom.session import shared_folder, stored
from lexiloom.sources import buckets, sinks
from lexiloom.sources import files as sources
from lexiloom.streaming import gate


@register("SELECT c_custkey AS id, c_acctbal AS v, c_custkey % 2 = 0 AS derived FROM customer WHERE c_custkey * 1 NOT IN (SELECT s_suppkey * 20 FROM supplier) OR c_custkey % 2 <> 0 UNION ALL SELECT s_suppkey * 20, s_acctbal, true FROM supplier")
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records in buckets, then suppliers with force: they are inserted, or replace records that are derived themselves."""
    target = f"{shared_folder(spark)}/lexiloom/buckets-{uuid.uuid4().hex}"
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 2 == 0).alias("derived"))
    buckets.upsert(spark, target, old, buckets=16)
    buckets.upsert(spark, target, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_acctbal").alias("v"), F.lit(True).alias("derived")), force=True)
    return buckets.records(spark, target).select("id", "v", "derived")


_X = "date_diff('day', DATE '2020-01-01', ts::DATE)"


@register(f"""SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, round(avg(value), 6) AS average, round(regr_slope(value, {_X}), 6) AS slope, true AS distinct_close, true AS median_close FROM events GROUP BY 1, 2""")
def span_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the events of each week from daily states, and whether the estimates lie within five standard errors of the exact ones."""
    events = table(spark, sf_dir, "events")
    daily = stored(states.daily(events, "ts", ["event_type"], "user_id", "value"))
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    made = states.figures(daily, ["event_type", week])
    error = 1.04 / 2 ** (states.LG / 2)
    of_week = events.withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    exact = of_week.groupBy("event_type", "week").agg(F.countDistinct("user_id").alias("exact"))
    met = made.join(exact, ["event_type", "week"])
    below = of_week.join(met.select("event_type", "week", "median"), ["event_type", "week"]).groupBy("event_type", "week").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("rank"), F.count("*").alias("_n"))
    out = met.join(below, ["event_type", "week"])
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * error * F.col("exact"))
    return out.select("event_type", "week", "n", F.round("average", 6).alias("average"), F.round("slope", 6).alias("slope"), close.alias("distinct_close"), (F.abs(F.col("rank") - 0.5) <= 5 * 0.0133 + 1 / F.col("_n")).alias("median_close"))


@register("""SELECT strftime(DATE '2026-01-01' + n_nationkey::INTEGER, '%Y-%m-%d') AS day, s_suppkey % 3 AS page, s_name AS query, s_acctbal::DOUBLE AS clicks, false AS empty FROM nation JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT strftime(DATE '2026-01-01' + n_nationkey::INTEGER + 40, '%Y-%m-%d'), 0, NULL, NULL, true FROM nation""")
def report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages of a search report, a day for each nation, then days without rows; a stream reads what has landed and, started again, the rest."""
    target = f"{shared_folder(spark)}/lexiloom/pages-{uuid.uuid4().hex}"
    day = lambda more: F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("nation") + more), "yyyy-MM-dd")
    row = F.struct(F.array("s_name").alias("keys"), F.col("s_acctbal").cast("double").alias("clicks"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("nation"), (F.col("s_suppkey") % 3).alias("page"), row.alias("row"))
    filled = suppliers.groupBy("nation", "page").agg(F.collect_list("row").alias("rows"))  # one page
    empty = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("nation"))
    name = lambda d, p: F.concat(F.lit("day="), d, F.lit("/page-"), p, F.lit(".json"))
    land = lambda rows: sinks.write_files(rows, f"{target}/landed")
    full = filled.select("nation", name(day(0), F.col("page").cast("string")).alias("name"), F.to_json(F.struct("rows")).cast("binary").alias("content"))
    land(full.where("nation < 12"))
    _read_all(spark, target)
    land(full.where("nation >= 12"))
    land(empty.select(name(day(40), F.lit("0")).alias("name"), F.lit("{}").cast("binary").alias("content")))
    _read_all(spark, target)
    return spark.read.schema("day string, page int, query string, clicks double, empty boolean").parquet(f"{target}/read")


def _read_all(spark: SparkSession, target: str) -> None:
    """One run of the stream: all that has landed since the last one."""
    found = sources.report_pages(spark, f"{target}/landed", stream=True).select("day", "page", "query", "clicks", "empty")
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{target}/state").start(f"{target}/read")
    try:
        run.processAllAvailable()
    finally:
        run.stop()


@register("""WITH RECURSIVE c AS (SELECT o_orderpriority AS exam, (o_custkey % 50)::VARCHAR AS topic, o_orderdate::TIMESTAMP AS t, o_orderkey::VARCHAR AS slug FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY exam, topic ORDER BY t, slug) AS r FROM c),
w AS (SELECT exam, topic, t, slug, r, t AS before, true AS accepted FROM o WHERE r = 1
  UNION ALL SELECT o.exam, o.topic, o.t, o.slug, o.r, CASE WHEN o.t >= w.before + INTERVAL 30 DAY THEN o.t ELSE w.before END, o.t >= w.before + INTERVAL 30 DAY FROM w JOIN o ON o.exam = w.exam AND o.topic = w.topic AND o.r = w.r + 1)
SELECT exam, topic, strftime(t, '%Y-%m-%d') AS day, slug, CASE WHEN accepted THEN 'accepted' ELSE 'duplicate' END AS verdict FROM w""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates that come over time: the first of a topic is accepted, those within thirty days of it are duplicates; the rule of the streamed gate over a table."""
    candidates = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("exam"), (F.col("o_custkey") % 50).cast("string").alias("topic"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").cast("string").alias("slug"))
    return gate.judge(candidates).select("exam", "topic", F.date_format("at", "yyyy-MM-dd").alias("day"), "slug", "verdict")


_CASES = ("whole", "none", "blank", "twice", "fewer", "average", "vocabulary")


@register("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT count(*) AS n FROM d),
c AS (SELECT 'whole' AS kind, doc_id, text FROM d UNION ALL SELECT 'blank', doc_id, CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE text END FROM d UNION ALL SELECT 'twice', doc_id, text FROM d UNION ALL SELECT 'twice', doc_id, text FROM d WHERE doc_id % 5 = 0
  UNION ALL SELECT 'fewer', doc_id, text FROM d WHERE doc_id % 3 <> 0 UNION ALL SELECT 'average', doc_id, text FROM d UNION ALL SELECT 'vocabulary', doc_id, text FROM d),
s AS (SELECT kind, count(*) AS rows, count_if(trim(text) = '') AS blank, count(DISTINCT doc_id) AS ids FROM c GROUP BY kind UNION ALL SELECT 'none', 0, 0, 0)
SELECT kind, CASE WHEN rows = 0 THEN 'EMPTY_INDEX' WHEN blank > 0 THEN 'BLANK_TEXT' WHEN ids <> rows THEN 'DUPLICATE_ID' WHEN rows <> n THEN 'DOC_COUNT_MISMATCH' WHEN kind = 'average' THEN 'BAD_AVERAGE_LENGTH' WHEN kind = 'vocabulary' THEN 'EMPTY_VOCABULARY' ELSE 'NONE' END AS failure FROM s, n""")
def index_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published index as it is and with each of its invariants broken: no documents, blank texts, ids that repeat, a wrong count, no average, no terms."""
    index = _index(spark, sf_dir)
    docs = stored(index.docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    meta = stored(index.meta.select("doc_count", "avg_doc_len"))
    made = {
        "none": docs.limit(0), "blank": docs.withColumn("text", F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("text"))), "twice": docs.union(docs.where("id % 5 = 0")), "fewer": docs.where("id % 3 <> 0"),
    }
    rows = []
    for kind in _CASES:
        average = meta.withColumn("avg_doc_len", F.lit(0.0)) if kind == "average" else meta
        rows.append((kind, packages.index_failure(made.get(kind, docs), index.df.limit(0) if kind == "vocabulary" else index.df, average) or "NONE"))
    return spark.createDataFrame(rows, "kind string, failure string")


def _ads(n: int) -> str:
    return '<ins class="adsbygoogle x"></ins>' * n


@register("""SELECT page_id, unnest(['image-alt', 'citations', 'toc', 'ad-slots', 'dup-ids', 'paragraphs']) AS check, unnest([page_id % 2 = 0, page_id % 3 <> 1, page_id % 5 <> 2, page_id % 4 = 0, page_id % 7 <> 3, page_id % 11 <> 4]) AS ok,
unnest(['1 images', CASE page_id % 3 WHEN 1 THEN '4 citations, 4 references, 1 and 1 orphans' ELSE '4 citations, 4 references, 0 and 0 orphans' END, CASE WHEN page_id % 5 = 2 THEN '1 anchors' ELSE '2 anchors' END,
  CASE page_id % 4 WHEN 0 THEN 'early, late, late' WHEN 1 THEN '' WHEN 2 THEN 'late, late, late' ELSE 'early' END, CASE WHEN page_id % 7 = 3 THEN 'one' ELSE '' END, CASE WHEN page_id % 11 = 4 THEN 'longest 130' ELSE 'longest ' || greatest(3, len(list_filter(string_split_regex(url, '\\s+'), lambda x: x <> ''))) END]) AS detail FROM pages""")
def made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages in articles with images, citations, anchors, adverts and ids, in which each check fails by rule; all of the tree's own checks but those of links."""
    i = F.col("page_id")
    when = lambda n, r, a, b: F.when(i % n == r, F.lit(a)).otherwise(F.lit(b))
    cite = lambda k, ref: f'<sup id="cite-{k}"><a href="#ref-{ref}">x</a></sup>'
    html = F.concat(
        F.when((i % 4 == 0) | (i % 4 == 3), F.lit(_ads(1))).otherwise(""),
        F.lit('<div><h2 id="one">a</h2><h2 id="two">b</h2><a href="#one">1</a>'), when(5, 2, '<a href="#three">2</a>', '<a href="#two">2</a>'), F.lit("</div><p>"), F.col("url"), F.lit("</p>"),
        when(2, 0, '<img alt="Number  System in short">', '<img alt="a number system">'),
        F.lit("".join(cite(k, k) for k in range(3))), when(3, 1, cite(3, 9), cite(3, 3)), F.lit("<ol>" + "".join(f'<li id="ref-{k}">r</li>' for k in range(4)) + "</ol>"),
        when(7, 3, '<b id="one">c</b>', "<b>c</b>"), when(11, 4, "<p>" + "word " * 130 + "</p>", "<p>some more words</p>"),
        F.when(i % 4 == 0, F.lit(f"<div>{_ads(2)}</div>")).when(i % 4 == 2, F.lit(f"<div>{_ads(3)}</div>")).otherwise(""),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.lit("number system").alias("phrase"))
    made = dom.checks(rows, "page_id", phrase="phrase")
    return made.where(F.col("check").isin("image-alt", "citations", "toc", "ad-slots", "dup-ids", "paragraphs")).select("page_id", "check", "ok", "detail")


_KINDS = ("whole", "short", "doubled", "renamed", "unindexed")


@register("""WITH n AS (SELECT count(*) AS n, count_if(doc_id % 4 = 0) AS q FROM documents), k AS (SELECT unnest(['whole', 'short', 'doubled', 'renamed', 'unindexed']) AS kind)
SELECT kind, unnest(['files_rows', 'rows_index', 'books_present']) AS check, unnest([q = 0 OR kind NOT IN ('short', 'doubled'), q = 0 OR kind NOT IN ('short', 'doubled', 'unindexed'), q = 0 OR kind NOT IN ('short', 'renamed')]) AS ok FROM k, n""")
def corpus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, as rows of the corpus and as indexed documents: whole, with rows missing, repeated or under other names, and with an index of fewer documents."""
    index = _index(spark, sf_dir)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"))
    meta = stored(index.meta.select("doc_count"))
    some, out = F.col("book") % 4 == 0, None
    for kind in _KINDS:
        rows = {"short": files.where(~some), "doubled": files.union(files.where(some)), "renamed": files.select(F.when(some, -1 - F.col("book")).otherwise(F.col("book")).alias("book"))}.get(kind, files)
        counted = meta.crossJoin(files.agg(F.count_if(some).alias("some"))).select((F.col("doc_count") - F.col("some")).alias("doc_count")) if kind == "unindexed" else meta  # one row each
        found = cleaning.cross_checks(files, rows, counted).select(F.lit(kind).alias("kind"), "check", "ok")
        out = found if out is None else out.union(found)
    return out


_WORDS = "c AS (SELECT DISTINCT trim(p_name) AS concept, p_brand AS subject FROM part), t AS (SELECT lower(coalesce(text, '')) AS h FROM documents), s AS (SELECT subject, concept, count_if(contains(h, split_part(concept, ' ', 1))) AS s FROM c CROSS JOIN t GROUP BY ALL)"


@register(f"""WITH {_WORDS}, p AS (SELECT subject, concept, {sql_half_up('(1.0 + s) / (2.0 + (SELECT count(*) FROM t))', 2)} AS p FROM s)
SELECT subject, concept, p AS coverage_probability, row_number() OVER (PARTITION BY subject ORDER BY p, concept) AS rank FROM p WHERE p < 0.35""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts of their brands, by colour: those that few documents cover, the least covered first."""
    names = table(spark, sf_dir, "part").select(F.trim("p_name").alias("name"), F.col("p_brand").alias("subject")).distinct()
    colours = names.withColumn("concept", F.element_at(F.split("name", " "), 1))
    found = st.coverage_probability(colours, table(spark, sf_dir, "documents").select(F.array("text").alias("concepts_taught")))
    return st.coverage_gaps(colours.join(found, "concept").select("subject", F.col("name").alias("concept"), "coverage_probability"), ["subject"])


def _card(*sentences: Column) -> Column:
    return F.concat(F.lit('<div style="border-left:4px solid red">'), *[x for s in sentences for x in (F.lit("<p>"), s, F.lit("</p>"))], F.lit("</div>"))


_FILL = "word " * 3200


@register(f"""WITH h AS (SELECT 'Number ' || doc_id % 60 AS s FROM documents WHERE doc_id % 2 = 0 UNION SELECT 'Odd ' || doc_id % 10 FROM documents WHERE doc_id % 2 = 1),
b AS (SELECT item_id AS i, coalesce(text, '') AS text FROM benchmark),
f AS (SELECT i, (('Number ' || i % 80) IN (SELECT s FROM h))::BIGINT + (('Odd ' || i % 20) IN (SELECT s FROM h))::BIGINT AS repeats,
  list_filter([CASE WHEN i % 5 = 0 THEN 'MISSING_SEO' END, CASE WHEN i % 5 = 1 THEN 'MISSING_SEO_FIELD' END, CASE WHEN i % 7 = 3 THEN 'SCRIPT_TAG' END, CASE WHEN i % 6 = 4 THEN 'UNCLOSED_TAG_AT_END' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([CASE WHEN i % 4 = 1 THEN 'BARE_H3' END, CASE WHEN len({sql_words("text")}) > 130 THEN 'LONG_PARAGRAPH' END, CASE WHEN i % 3 = 0 THEN 'THIN_PUBLISHER_NOTES' END, CASE WHEN i % 2 = 0 THEN 'MISSING_CONTENT_MEMORY' END, CASE WHEN i % 8 = 3 THEN 'MISSING_CM_FLAVOUR' END], lambda x: x IS NOT NULL) AS warnings FROM b),
q AS (SELECT *, least(1.0::DOUBLE, len(errors) * 0.25::DOUBLE) + least(0.3::DOUBLE, len(warnings) * 0.03::DOUBLE) + CASE WHEN i % 2 = 1 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN i % 3 = 1 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN i % 4 = 2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM f)
SELECT i AS cand_id, repeats, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings, {sql_half_up('1 - least(1.0::DOUBLE, penalty)', 3)} AS quality FROM q""")
def evaluation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts in articles of which each lacks some parts by rule: repeated card sentences, errors, warnings and quality against documents as history."""
    i, d = F.col("id"), F.col("id")
    text = lambda c: c.cast("string")
    fields = lambda keyword: F.struct(*[(keyword if f == "focusKeyword" else F.lit("x")).alias(f) for f in fh.SEO_FIELDS])
    memory = F.struct(*[F.array(F.lit("x")).alias(f) for f in fh.MEMORY_FIELDS], F.when(i % 8 == 3, "").otherwise("plain").alias("flavour"))
    part = lambda n, r, html: F.when(i % n == r, F.lit(html)).otherwise("")
    html = F.concat(
        _card(F.concat(F.lit("Number "), text(i % 80)), F.concat(F.lit("Odd "), text(i % 20)), F.lit("Never")), F.lit("<p>"), F.col("html"), F.lit("</p>"),
        part(4, 1, "<h3>a</h3>"), part(3, 1, "".join(f'<i id="ad-slot-{k}"></i>' for k in range(3))), part(2, 1, f"<b>{_FILL}</b>"), part(7, 3, "<script>x</script>"), part(4, 2, f"<i>{fh.CLICHES[0]}</i>"), part(6, 4, "<section>"),
        F.lit('<i class="' + "x" * 200 + '"></i>'),
    )
    cand = _bundles(table(spark, sf_dir, "benchmark"), "item_id").withColumn("html", html)
    cand = cand.withColumn("seo", F.when(i % 5 != 0, fields(F.when(i % 5 == 1, "").otherwise("zz qq"))))
    cand = cand.withColumn("publisher_notes", F.when(i % 3 == 0, "").otherwise("x" * 20)).withColumn("memory", F.when(i % 2 == 1, memory))
    hist = _bundles(table(spark, sf_dir, "documents"), "doc_id").withColumn("html", _card(F.concat(F.lit("Number "), text(d % 60))))
    hist = hist.withColumn("card_sentences_used", F.when(d % 2 == 1, F.array(F.concat(F.lit("Odd "), text(d % 10)))))
    made = similarity.evaluate(cand, hist)
    return made.select("cand_id", "repeats", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "quality")
