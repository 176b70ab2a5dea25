"""All registered queries of the library, and DuckDB SQL for the same results.

Tables stand in for the concepts of the data model: documents are chunks,
benchmark texts are queries, events are a user's history of records (latest
first), parts are syllabus topics, line items are what has been published.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import html as fh
from lexiloom.functions import numbers as fn
from lexiloom.functions import text as ft
from lexiloom.operators import cleaning, coverage, editorial, packages, search, segments, similarity
from lexiloom.operators import statistics as st
from lexiloom.session import shared_folder, spread
from lexiloom.sources import sinks
from lexiloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def with_longs(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in out.dtypes])

        QUERIES[f.__name__] = with_longs
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df  # tables of texts


# --- SQL fragments ---------------------------------------------------------


def sql_tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{M}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


def sql_similarity_words(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '(?i)&[a-z]+;', ' ', 'g')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"


def sql_grams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i+4], ' ')))"


def sql_words(c: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({c}, ''), '\s+'), lambda w: w <> '')"


def sql_half_up(x: str, places: int = 0) -> str:
    k = float(10**places)
    return f"(floor(({x}) * {k} + 0.5) / {k})"


SQL_POSTINGS = f"""
tok AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
len AS (SELECT doc_id, len(t) AS doc_len FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
meta AS (SELECT count(*) AS dc, avg(doc_len) AS al FROM len)"""
SQL_BM25 = f"""{SQL_POSTINGS},
q AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark),
score AS (SELECT query_id, doc_id, round(sum(ln(1 + (dc - n + 0.5) / (n + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / al)))), 9) AS score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN meta GROUP BY ALL HAVING score > 0)"""
SQL_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


# --- retrieval -------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The published index of the documents; it is built where there is none of the same files yet."""
    docs = table(spark, sf_dir, "documents")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    state = files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("state")).first().state
    target = f"{shared_folder(spark)}/lexiloom/index-{state & (2**64 - 1):016x}"
    return search.load_index(spark, target, docs) if sinks.is_published(spark, target) else search.publish_index(docs, target)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@register(f"WITH {SQL_POSTINGS} SELECT term, n FROM df")
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).df


@register(f"WITH {SQL_POSTINGS} SELECT doc_id, term, tf, doc_len FROM post JOIN len USING (doc_id)")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.select("doc_id", "term", "tf", "doc_len")


@register(f"WITH {SQL_POSTINGS} SELECT dc AS doc_count, round(al, 9) AS avg_doc_len FROM meta")
def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_info(_index(spark, sf_dir)).select("doc_count", F.round("avg_doc_len", 9).alias("avg_doc_len"))


@register(f"WITH {SQL_BM25} SELECT query_id, doc_id, score, {SQL_RANK} AS rank FROM score QUALIFY rank <= 5")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieve(_index(spark, sf_dir), _benchmark(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


@register(f"WITH {SQL_BM25} SELECT query_id, doc_id, score, {SQL_RANK} AS rank FROM score JOIN documents USING (doc_id) WHERE lower(source) = 'src1' AND lower(lang) = 'en' QUALIFY rank <= 5")
def bm25_filtered_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = search.matches_filter({"subject": "SRC1", "language": "EN"}, {"subject": F.col("source"), "language": F.col("lang")})
    return search.retrieve(_index(spark, sf_dir), _benchmark(spark, sf_dir), 0, condition).select("query_id", "doc_id", "score", "rank")


def _sql_fallback(source: str) -> str:
    return f"SELECT '{source}' AS wanted, query_id, doc_id, score, {SQL_RANK} AS rank FROM score JOIN documents USING (doc_id) WHERE lower(source) = '{source}' OR NOT EXISTS (SELECT 1 FROM documents WHERE lower(source) = '{source}') QUALIFY rank <= 5"


@register(f"WITH {SQL_BM25} SELECT * FROM ({_sql_fallback('nowhere')}) UNION ALL SELECT * FROM ({_sql_fallback('src3')})")
def bm25_filtered_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that no document fits, so that all are searched, and one that some fit."""
    index, asked = _index(spark, sf_dir), _benchmark(spark, sf_dir)

    def one(source: str) -> DataFrame:
        condition = search.matches_filter({"subject": source}, {"subject": F.col("source")})
        return search.retrieve(index, asked, 5, condition, fallback=True).select(F.lit(source).alias("wanted"), "query_id", "doc_id", "score", "rank")

    return one("nowhere").union(one("src3"))


SQL_UPDATED = SQL_BM25.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 3)")


def updated_index(spark: SparkSession, docs: DataFrame, compacted: bool) -> search.Index:
    """An index with a history: every document was first written with its source for a text where its id is divisible by 3, then
    those were given their own texts, then ids that leave 3 when divided by 7 were deleted; after that it may have been compacted."""
    target = f"{shared_folder(spark)}/lexiloom/segments-{uuid.uuid4().hex}"
    segments.update(spark, target, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text")).alias("text")))
    segments.update(spark, target, docs.where("doc_id % 3 = 0"))
    segments.update(spark, target, deleted=docs.where("doc_id % 7 = 3"))
    if compacted:
        segments.compact(spark, target)
    return segments.load(spark, target, docs)


@register(f"WITH {SQL_UPDATED} SELECT query_id, doc_id, score, {SQL_RANK} AS rank FROM score QUALIFY rank <= 5")
def bm25_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = updated_index(spark, table(spark, sf_dir, "documents"), compacted=False)
    return search.retrieve(index, _benchmark(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


@register(f"WITH {SQL_UPDATED} SELECT term, n, dc AS doc_count, round(al, 9) AS avg_doc_len FROM df CROSS JOIN meta")
def df_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = updated_index(spark, table(spark, sf_dir, "documents"), compacted=True)
    return index.df.crossJoin(F.broadcast(index.meta)).select("term", "n", "doc_count", F.round("avg_doc_len", 9).alias("avg_doc_len"))


SQL_LEGACY = r"len(regexp_extract_all(coalesce({}, ''), '\b(?:esa|gSa|osQ|fd|dks|gS)\b'))"
SQL_REASONS = """list_filter([CASE WHEN trim(text) = '' THEN 'EMPTY_TEXT' WHEN length(trim(text)) < 20 THEN 'TEXT_TOO_SHORT' END,
  CASE WHEN trim(coalesce(source, '')) = '' THEN 'MISSING_SUBJECT' END,
  CASE WHEN lang IS NULL THEN 'MISSING_CHAPTER_IDENTITY' END,
  CASE WHEN score <= 0 THEN 'SCORE_NOT_POSITIVE' END,
  CASE WHEN regexp_matches(trim(text), '(?i)</?[a-z][a-z0-9]*[^>]*>') THEN 'LOOKS_LIKE_MARKUP' END,
  CASE WHEN {hits} > 0 AND {hits} >= greatest(2, floor(greatest({words}, 1) / 50)) THEN 'LEGACY' END], lambda r: r IS NOT NULL)""".format(hits=SQL_LEGACY.format("text"), words=f"len({sql_words('text')})")


@register(f"""WITH {SQL_BM25}, hit AS (SELECT query_id, doc_id, score, {SQL_RANK} AS rank FROM score QUALIFY rank <= 5),
checked AS (SELECT query_id, rank, lang, source, len({SQL_REASONS}) = 0 AS valid, text FROM hit JOIN documents USING (doc_id)),
chap AS (SELECT query_id, string_agg(c, ',' ORDER BY r) AS chapters FROM (SELECT query_id, source || '::' || lang AS c, min(rank) AS r FROM checked WHERE valid GROUP BY ALL) GROUP BY query_id)
SELECT query_id, count_if(valid)::BIGINT AS n_valid, count_if(NOT valid)::BIGINT AS n_invalid, bool_and(valid) AS all_valid, count(DISTINCT CASE WHEN valid THEN source || '::' || lang END) AS provenance, coalesce(any_value(chapters), '') AS chapters,
  {sql_half_up('least(1.0, count_if(valid) / 5.0) * count_if(valid) / count(*)', 2)} AS source_confidence FROM checked LEFT JOIN chap USING (query_id) GROUP BY query_id""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = bm25_top5(spark, sf_dir).join(docs, "doc_id").select("query_id", "rank", "score", "text", F.col("source").alias("book"), F.col("lang").alias("chapter"), F.lit(None).cast("string").alias("chapter_title"), "source")
    checked = hits.withColumn("reasons", ft.hit_reasons(F.col("text"), F.col("source"), F.col("chapter_title"), F.col("chapter"), F.col("score")))
    return editorial.evidence(checked, ["query_id"]).select("query_id", "n_valid", "n_invalid", "all_valid", "provenance", F.array_join("chapters", ",").alias("chapters"), "source_confidence")


@register("""WITH d AS (SELECT source, doc_id::VARCHAR AS k, sha256(doc_id::VARCHAR || chr(0) || coalesce(text, '') || chr(0)) AS h, left(md5(doc_id::VARCHAR), 2) AS b FROM documents),
f AS (SELECT source, b, sha256(string_agg(h, '' ORDER BY k)) AS h FROM d GROUP BY ALL)
SELECT source, left(sha256(string_agg(h, '' ORDER BY b)), 16) AS index_version FROM f GROUP BY source""")
def index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.content_version(table(spark, sf_dir, "documents"), "doc_id", by=["source"])


# --- statistics over histories ---------------------------------------------

SQL_HISTORY = """hist AS (SELECT user_id, event_type AS item, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
SQL_PROBS = """freq AS (SELECT user_id, trim(item) AS item, count(*) AS n FROM hist GROUP BY ALL),
prob AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM freq)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("item"), "value")
    return st.with_seq(events, ["user_id"], [F.desc("ts"), F.col("event_id")])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as history records, whose array fields hold what the event is about."""
    some = lambda ok, c: F.when(ok, F.array(c)).otherwise(F.array().cast("array<string>"))
    kind, k = F.col("item"), F.floor("value").cast("string")
    return _history(spark, sf_dir).select(
        "user_id", "seq", "value", F.col("event_id").cast("string").alias("id"),
        F.array(kind, k).alias("concepts_taught"), some(F.col("value") > 5, k).alias("examples_used"), some(kind != "view", k).alias("misconceptions_used"),
        some(kind == "click", kind).alias("question_types"), F.array().cast("array<string>").alias("card_sentences_used"), F.array(kind, F.concat(kind, F.lit("-end"))).alias("article_shape"),
    )


@register(f"WITH {SQL_HISTORY}, {SQL_PROBS} SELECT user_id, item, n FROM freq")
def freq_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.frequency(_history(spark, sf_dir), ["user_id"])


@register(f"WITH {SQL_HISTORY}, {SQL_PROBS} SELECT user_id, item, n, round(p, 9) AS p FROM prob")
def prob_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.probabilities(freq_dist(spark, sf_dir), ["user_id"]).select("user_id", "item", "n", F.round("p", 9).alias("p"))


@register(f"WITH {SQL_HISTORY}, {SQL_PROBS} SELECT user_id, round(sum(-p * log2(p)), 9) AS entropy, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * log2(p)) / log2(count(*)) END, 9) AS normalized FROM prob GROUP BY user_id")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.entropy(st.probabilities(freq_dist(spark, sf_dir), ["user_id"]), ["user_id"])
    return out.select("user_id", F.round("entropy", 9).alias("entropy"), F.round("normalized", 9).alias("normalized"))


@register(f"""WITH {SQL_HISTORY},
a AS (SELECT user_id, item, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM hist WHERE seq < 10 GROUP BY user_id, item),
b AS (SELECT user_id, item, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS q FROM hist WHERE seq >= 10 GROUP BY user_id, item),
j AS (SELECT user_id, item, p, q, coalesce(p, 0) AS x, coalesce(q, 0) AS y FROM a FULL JOIN b USING (user_id, item))
SELECT user_id, round(CASE WHEN count(p) = 0 OR count(q) = 0 THEN 1 ELSE sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2 END, 9) AS jsd FROM j GROUP BY user_id""")
def jsd_recent_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)
    part = lambda r: st.probabilities(st.frequency(r, ["user_id"]), ["user_id"])
    return st.divergence(part(st.recent(rows)), part(st.historical(rows)), ["user_id"]).select("user_id", F.round("jsd", 9).alias("jsd"))


SQL_WEIGHTS = """w AS (SELECT user_id, item, sum(n - seq) AS weight, min(seq) AS first_seq FROM hist GROUP BY ALL)"""


@register(f"WITH {SQL_HISTORY}, {SQL_WEIGHTS} SELECT user_id, item, weight::BIGINT AS weight, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first_seq) AS rank FROM w WHERE weight >= 2 QUALIFY rank <= 5")
def recency_weighted_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).withColumn("items", F.array("item"))
    return st.top_by_weight(st.weighted_counts(rows, ["user_id"], "items"), ["user_id"], st.OVERUSED).select("user_id", "item", "weight", "rank")


@register("""WITH hist AS (SELECT user_id, floor(value)::BIGINT::VARCHAR AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w AS (SELECT user_id, item, sum(n - seq) AS weight, min(seq) AS first_seq FROM hist GROUP BY ALL)
SELECT user_id, item, weight::BIGINT AS weight, row_number() OVER (PARTITION BY user_id ORDER BY weight, first_seq) AS rank FROM w
WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM hist WHERE seq < 10) QUALIFY rank <= 5""")
def least_recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).withColumn("items", F.array(F.floor("value").cast("string")))
    by = ["user_id"]
    return st.least_recently_used(st.weighted_counts(rows, by, "items"), st.weighted_counts(st.recent(rows), by, "items"), by).select("user_id", "item", "weight", "rank")


@register("SELECT user_id, round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 9) AS fill_rate FROM events GROUP BY user_id")
def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("user_id").agg(F.round(st.fill_rate("examples_used"), 9).alias("fill_rate"))


@register("""SELECT d.lang, count(*) AS observations, 1.0 + count_if(l.quality = 1) AS alpha, 1.0 + count(*) - count_if(l.quality = 1) AS beta,
round((1.0 + count_if(l.quality = 1)) / (2.0 + count(*)), 9) AS mean FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""")
def beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")).alias("good"))
    return st.fill_posterior(rows, ["lang"], "good").select("lang", "observations", "alpha", "beta", F.round("mean", 9).alias("mean"))


@register(f"""WITH c AS (SELECT DISTINCT trim(p_name) AS concept FROM part), n AS (SELECT count(*) AS n FROM documents),
h AS (SELECT lower(p_type || ' | ' || p_name) AS h FROM part), s AS (SELECT concept, count_if(contains(h, lower(concept))) AS s FROM c CROSS JOIN h GROUP BY concept)
SELECT concept, {sql_half_up('(1.0 + s) / (2.0 + t)', 2)} AS coverage_probability, t AS observations FROM s CROSS JOIN (SELECT count(*) AS t FROM part) WHERE concept <> ''""")
def coverage_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    concepts = parts.select(F.trim("p_name").alias("concept")).distinct()
    return st.coverage_probability(concepts, parts.select(F.array("p_type", "p_name").alias("concepts_taught")))


@register("""WITH h AS (SELECT user_id, list(value ORDER BY ts, event_id DESC) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) AS ewma FROM h""")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.ewma_by(_history(spark, sf_dir), ["user_id"], F.col("value")).select("user_id", F.round("ewma", 6).alias("ewma"))


@register(f"WITH {SQL_HISTORY} SELECT user_id, CASE WHEN count(*) < 2 THEN 0 ELSE {sql_half_up('coalesce(regr_slope(value, seq), 0)', 3)} END AS slope, count(*) >= 2 AS data_available FROM hist GROUP BY user_id")
def quality_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.drift(_history(spark, sf_dir), ["user_id"], "seq", "value")


@register("""WITH c AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS used, round(avg(c_acctbal) / 10000, 9) AS exploit FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT *, coalesce(exploit, 0) + sqrt(ln(sum(used) OVER (PARTITION BY n_regionkey) + 2.718281828459045) / (used + 1)) AS total FROM c)
SELECT n_regionkey, n_nationkey AS id, used, round(total, 9) AS total, row_number() OVER (PARTITION BY n_regionkey ORDER BY total DESC, n_nationkey::VARCHAR) AS rank FROM s""")
def ucb_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    options = joined.groupBy("n_regionkey", F.col("n_nationkey").alias("id")).agg(F.count("c_custkey").alias("used"), F.round(F.avg("c_acctbal") / 10000, 9).alias("exploit"))
    return st.rank_with_exploration(options, ["n_regionkey"]).select("n_regionkey", "id", "used", F.round("total", 9).alias("total"), "rank")


@register(None)
def topic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, genome and brief of every user's history."""
    made = editorial.brief(editorial.genome(editorial.topic_state(_records(spark, sf_dir), ["user_id"]), "user_id"))
    return made.select("user_id", "signature_confidence", "structural_divergence", "structural_repetitiveness", "section_count_ewma", "confidence", "opening", "concept_order", "example_density", "misconception_depth", "analogy_use", "section_count", "avoid_repeating", "block")


@register(f"""WITH hist AS (SELECT user_id, event_type, floor(value)::BIGINT::VARCHAR AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS seq FROM events)
SELECT user_id, {sql_half_up("least(1.0, count(*) / 10.0) * (1.0 + avg(CASE WHEN event_type <> 'view' THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END)) / 3", 2)} AS confidence FROM hist WHERE seq < 10 GROUP BY user_id""")
def signature_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editorial.signature(_records(spark, sf_dir), ["user_id"]).select("user_id", "confidence")


@register("""WITH w AS (SELECT p_partkey, p_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name || '|' || p_brand, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM part)
SELECT p_partkey, CASE WHEN h >= 2147483648 THEN abs(h - 4294967296) ELSE h END AS hash, list_sum(list_transform(string_split(p_name, ''), lambda c: ord(c)))::BIGINT % 999 + 1 AS seed FROM w""")
def hash_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fn.code_unit_hash(F.concat_ws("|", "p_name", "p_brand")).alias("hash"), fn.code_unit_seed(F.col("p_name")).alias("seed"))


# --- similarity ------------------------------------------------------------

SQL_SHINGLES = f"""
dw AS (SELECT doc_id, {sql_similarity_words('text')} AS w FROM documents), bw AS (SELECT item_id, {sql_similarity_words('text')} AS w FROM benchmark),
dg AS (SELECT doc_id, {sql_grams('w')} AS g FROM dw WHERE len(w) >= 5), bg AS (SELECT item_id, {sql_grams('w')} AS g FROM bw WHERE len(w) >= 5),
de AS (SELECT doc_id, len(g) AS nd, unnest(g) AS x FROM dg), be AS (SELECT item_id, len(g) AS nb, unnest(g) AS x FROM bg),
sim AS (SELECT item_id, doc_id, {sql_half_up('count(*) / (nb + nd - count(*))', 3)} AS similarity FROM be JOIN de USING (x) GROUP BY item_id, doc_id, nb, nd)"""


@register(f"WITH {SQL_SHINGLES} SELECT item_id AS new_id, doc_id AS slug, similarity, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM sim QUALIFY rank <= 3")
def shingle_jaccard_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("new_id"), "text")
    return similarity.closest(new, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), "text"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: the parts of an order are its items."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cand_id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("items"))  # a few lines an order


@register(f"""WITH b AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i FROM lineitem), s AS (SELECT o, count(*) AS n FROM b GROUP BY o),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM b x JOIN b y USING (i) WHERE x.o <> y.o GROUP BY ALL),
m AS (SELECT a, max(c / (sa.n + sb.n - c)) AS v FROM p JOIN s sa ON sa.o = a JOIN s sb ON sb.o = b GROUP BY a)
SELECT o AS cand_id, {sql_half_up('coalesce(v, 0.0)', 3)} AS overlap FROM s LEFT JOIN m ON a = o""")
def item_jaccard_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a candidate against all other orders."""
    return similarity.overlap_among(_baskets(spark, sf_dir), "items")


@register(f"""WITH b AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS i FROM lineitem), s AS (SELECT o, count(*) AS n FROM b GROUP BY o),
h AS (SELECT DISTINCT o_custkey AS o, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), hs AS (SELECT o, count(*) AS n FROM h GROUP BY o),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM b x JOIN b y USING (i) WHERE y.o < x.o GROUP BY ALL), r AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM b x JOIN h y USING (i) GROUP BY ALL),
m AS (SELECT a, max(v) AS v FROM (SELECT a, c / (sa.n + sb.n - c) AS v FROM p JOIN s sa ON sa.o = a JOIN s sb ON sb.o = b UNION ALL SELECT a, c / (sa.n + sb.n - c) FROM r JOIN s sa ON sa.o = a JOIN hs sb ON sb.o = b) GROUP BY a)
SELECT o AS seq, {sql_half_up('coalesce(v, 0.0)', 3)} AS overlap FROM s LEFT JOIN m ON a = o""")
def prefix_batch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a batch in key order: each against those before it and the customers as history, by the parts they deal in."""
    lines = table(spark, sf_dir, "lineitem")
    parts = F.collect_set(F.col("l_partkey").cast("string")).alias("items")
    batch = lines.groupBy(F.col("l_suppkey").alias("seq")).agg(parts)
    history = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(parts)
    return similarity.batch_overlap(batch, history, "items")


SQL_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@register(f"WITH l AS (SELECT doc_id, unnest({SQL_LINES}) AS s, generate_subscripts({SQL_LINES}, 1) - 1 AS pos FROM documents) SELECT doc_id AS cand_id, pos, s AS sentence FROM l WHERE s IN (SELECT s FROM l GROUP BY s HAVING count(DISTINCT doc_id) > 1)")
def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that another document has too."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), ft.text_lines(F.col("text")).alias("cards"))
    return similarity.repeated_among(docs, "cards")


@register("""WITH s AS (SELECT user_id, event_type AS item FROM events), q AS (SELECT item, count(*) / sum(count(*)) OVER () AS q FROM s GROUP BY item),
p AS (SELECT user_id, item, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM s GROUP BY user_id, item),
k AS (SELECT DISTINCT user_id FROM p), j AS (SELECT k.user_id, coalesce(p, 0) AS x, coalesce(q, 0) AS y FROM k CROSS JOIN (SELECT item FROM q UNION SELECT item FROM p) i LEFT JOIN p ON p.user_id = k.user_id AND p.item = i.item LEFT JOIN q ON q.item = i.item),
d AS (SELECT user_id, floor(sum(CASE WHEN x > 0 THEN x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(y / ((x + y) / 2)) ELSE 0 END) / 2 * 1000 + 0.5) / 1000 AS divergence FROM j GROUP BY user_id)
SELECT user_id AS cand_id, divergence, floor((1 - divergence) * 1000 + 0.5) / 1000 AS repetitiveness FROM d""")
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user as a shape, against those of all users."""
    shapes = table(spark, sf_dir, "events").select(F.col("user_id").alias("cand_id"), F.col("event_type").alias("item"))
    return similarity.structural_similarity(shapes, shapes.drop("cand_id"))


@register(f"""SELECT count(*) AS n, {sql_half_up('avg(value)', 3)} AS avg_quality, {sql_half_up('avg(value / 10)', 3)} AS avg_novelty, {sql_half_up('regr_slope(value, event_id)', 3)} AS drift, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS total_repeats FROM events""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.batch_summary(_batch(spark, sf_dir))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("quality"), (F.col("value") / 10).alias("novelty"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("repeats"))


@register("""SELECT event_id AS seq, 'REPEATED_SENTENCES' AS flag FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'LOW_QUALITY' FROM events WHERE value < 0.5 UNION ALL SELECT event_id, 'LOW_NOVELTY' FROM events WHERE value / 10 < 0.3""")
def batch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.batch_flags(_batch(spark, sf_dir))


# --- packages --------------------------------------------------------------

SQL_SAFETY = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}') THEN '{code}' END" for code, group in (("SECRET_LIKE_CONTENT", packages.SECRETS), ("WORKFLOW_TAMPER_SUSPECT", packages.WORKFLOWS), ("EXECUTABLE_CONTENT", (r"(?i)<script\b",))) for p in group)


@register(f"SELECT doc_id, array_to_string(list_filter([{SQL_SAFETY}], lambda x: x IS NOT NULL), ',') AS errors, regexp_matches(coalesce(text, ''), '{packages.EXECUTABLE.replace(chr(39), chr(39) * 2)}') AS mentions_executable FROM documents")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(packages.safety_errors(text), ",").alias("errors"), (F.size(packages.safety_warnings(text)) > 0).alias("mentions_executable"))


@register(r"""WITH c AS (SELECT doc_id // 50 AS pkg, doc_id, trim(coalesce(text, ''), ' ') AS t, row_number() OVER (PARTITION BY doc_id // 50, source ORDER BY doc_id) AS nth FROM documents)
SELECT pkg, doc_id, array_to_string(list_filter([CASE WHEN nth > 1 THEN 'DUPLICATE_CHUNK_ID' END, CASE WHEN t = '' THEN 'MISSING_CHUNK_TEXT' WHEN length(t) < 10 THEN 'CHUNK_TOO_SHORT' WHEN length(t) > 20000 THEN 'CHUNK_WAY_TOO_LONG' END,
CASE WHEN doc_id % 7 = 0 THEN 'INVALID_PAGE_TYPE' END, CASE WHEN doc_id % 5 = 0 THEN 'INVALID_METADATA_ENTRY' END], lambda x: x IS NOT NULL), ',') AS errors,
CASE WHEN length(t) BETWEEN 8001 AND 20000 THEN 'CHUNK_LONG' ELSE '' END AS warnings, length(t) BETWEEN 10 AND 20000 AS usable FROM c""")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of packages of 50, ids by source, some with a page or topics of the wrong type."""
    docs = table(spark, sf_dir, "documents")
    page = F.when(F.col("doc_id") % 7 == 0, F.lit('"p"')).otherwise(F.lit("1"))
    topics = F.when(F.col("doc_id") % 5 == 0, F.lit('["a",1]')).otherwise(F.lit('["a"]'))
    head = F.to_json(F.struct(F.col("source").alias("id"), "text"))
    json = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"page":'), page, F.lit(',"topics":'), topics, F.lit("}"))
    chunks = docs.select(F.expr("doc_id div 50").alias("pkg"), F.col("doc_id").alias("idx"), F.parse_json(json).alias("chunk"))
    out = packages.chunk_issues(chunks, "pkg")
    return out.select("pkg", F.col("idx").alias("doc_id"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "usable")


@register("SELECT doc_id, md5(text) AS text_md5, f AS first_id FROM documents d JOIN (SELECT text AS t, min(doc_id) AS f FROM documents GROUP BY text) ON text IS NOT DISTINCT FROM t WHERE doc_id > f")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later documents with an equal text, and the first of them; null texts are equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    first = docs.groupBy("text_md5").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("text_md5", "m")
    return docs.join(first, F.col("text_md5").eqNullSafe(F.col("m"))).where("doc_id > first_id").select("doc_id", "text_md5", "first_id")


# --- cleaning --------------------------------------------------------------


@register(f"SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest({SQL_LINES}) AS line FROM documents) GROUP BY ALL HAVING count(*) >= 2")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.repeated_lines(table(spark, sf_dir, "documents"), least=2)


@register(f"""WITH l AS (SELECT doc_id, {SQL_LINES} AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n FROM u),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f WHERE NOT regexp_full_match(line, '\\d{{1,4}}') AND NOT (n >= 4 AND length(line) < 60)),
t AS (SELECT doc_id, coalesce(min(CASE WHEN r <= 30 AND len(string_split_regex(line, '\\s+')) >= 8 THEN r END), 1) AS s FROM k GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(x.txt, '')) AS clean_md5, length(coalesce(x.txt, '')) AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY r) AS txt FROM k JOIN t USING (doc_id) WHERE r >= s GROUP BY doc_id) x USING (doc_id)""".replace("\\\\", "\\"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_text(F.col("text")).alias("t"))
    return made.select("doc_id", F.md5(F.col("t").cast("binary")).alias("clean_md5"), F.length("t").cast("long").alias("n_chars"))


# --- pages -----------------------------------------------------------------

SQL_HREFS = r"""regexp_extract_all(html, '(?i)<a\b[^>]*href="([^"]*)"', 1)"""
SQL_STRIPPED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@register(f"""SELECT page_id, len(list_filter({SQL_HREFS}, lambda h: (NOT starts_with(h, '#') AND NOT regexp_matches(h, '(?i)^https?://')) OR regexp_matches(h, '(?i)example.org'))) AS internal,
len(list_filter({SQL_HREFS}, lambda h: regexp_matches(h, '(?i)^https?://') AND NOT regexp_matches(h, '(?i)example.org'))) AS external, len({SQL_HREFS}) AS total FROM pages""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fh.link_counts(F.col("html"), r"example.org").alias("l")).select("page_id", "l.*")


@register(rf"""SELECT page_id, regexp_matches(html, '(?i)<script\b') AS has_script, len(list_filter(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: len(list_filter(string_split_regex(regexp_replace(p, '<[^>]+>', ' ', 'g'), '\s+'), lambda w: w <> '')) > 130)) AS long_paragraphs,
len(list_filter(string_split_regex({SQL_STRIPPED}, '\s+'), lambda w: w <> '')) AS words,
list_sum(list_transform([{', '.join(f"'{c}'" for c in fh.CLICHES)}], lambda c: contains(lower({SQL_STRIPPED}), c)::INT))::BIGINT AS cliches,
len(regexp_extract_all(html, 'id="ad-slot-\d+"')) AS ads, len(regexp_extract_all(html, '(?i)<h3[^>]*>')) > len(regexp_extract_all(html, '(?i)<h3[^>]*style=[^>]*>')) AS bare_h3 FROM pages""")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.array_contains(fh.artifact_issues(h), "SCRIPT_TAG").alias("has_script"),
        F.size(F.filter(fh.paragraph_words(h), lambda n: n > 130)).alias("long_paragraphs"),
        ft.word_count(ft.strip_tags(h)).alias("words"),
        fh.cliche_count(h).alias("cliches"),
        fh.ad_slots(h).alias("ads"),
        fh.bare_h3(h).alias("bare_h3"),
    )


# --- coverage and dashboard ------------------------------------------------


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("exam"), F.col("p_type").alias("subject"), F.concat_ws(" ", "p_name", "p_partkey").alias("topic"), "p_partkey")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _topics(spark, sf_dir).join(sold, "p_partkey", "left_semi").select("exam", "subject", F.concat(F.lit(" "), F.upper("topic")).alias("topic"), "p_partkey")


SQL_TOPICS = """t AS (SELECT p_brand AS exam, p_type AS subject, p_name || ' ' || p_partkey AS topic, p_partkey FROM part), pub AS (SELECT * FROM t WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45))"""


@register(f"WITH {SQL_TOPICS} SELECT exam, count_if(p_partkey IN (SELECT p_partkey FROM pub))::BIGINT AS done, count(*) AS total, {sql_half_up('100 * count_if(p_partkey IN (SELECT p_partkey FROM pub)) / count(*)')}::BIGINT AS percent FROM t GROUP BY exam")
def syllabus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _published(spark, sf_dir).withColumn("topic", F.lower("topic"))
    return coverage.percent_done(coverage.done_flags(_topics(spark, sf_dir), done), ["exam"])


@register(f"WITH {SQL_TOPICS} SELECT exam, subject, count(*) AS n_open, array_to_string(list(topic ORDER BY topic), ';') AS topics FROM t WHERE p_partkey NOT IN (SELECT p_partkey FROM pub) GROUP BY ALL")
def backlog_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.backlog_lists(coverage.backlog(_topics(spark, sf_dir), _published(spark, sf_dir)))
    return out.select("exam", "subject", "n_open", F.array_join("topics", ";").alias("topics"))


@register(f"""WITH {SQL_TOPICS}, u AS (SELECT exam, subject, count(*) AS used FROM pub GROUP BY ALL), o AS (SELECT exam, subject, count(*) AS n_open FROM t WHERE p_partkey NOT IN (SELECT p_partkey FROM pub) GROUP BY ALL),
p AS (SELECT exam, subject, coalesce(used, 0) AS used, coalesce(n_open, 0) AS n_open FROM u FULL JOIN o USING (exam, subject))
SELECT exam, subject, used, n_open, round(0.5 + sqrt(ln(sum(used) OVER () + 2.718281828459045) / (used + 1)), 9) AS total FROM p""")
def pair_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of exam and subject, with the value by which the next post is chosen."""
    left = coverage.backlog(_topics(spark, sf_dir), _published(spark, sf_dir))
    ranked = editorial.next_post(coverage.known_pairs(_published(spark, sf_dir), left))
    return ranked.select("exam", "subject", "used", "n_open", F.round("total", 9).alias("total"))


@register("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')")
def free_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.free_text(table(spark, sf_dir, "part"), "RED", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


@register("""WITH r AS (SELECT p_name || ' ' || p_type AS query, count(*)::DOUBLE AS impressions, count_if(l_returnflag = 'R')::DOUBLE AS clicks FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(lower(query), ' ')), ['small', 'red', 'ring', 'economy'])) AS overlap FROM r WHERE impressions >= 5)
SELECT query, impressions, clicks, overlap FROM s WHERE overlap > 0 ORDER BY overlap DESC, impressions DESC, query LIMIT 15""")
def search_overlap_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("query")).agg(F.count("*").cast("double").alias("impressions"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("clicks"))
    return coverage.search_matches(rows, "Small red ring, ECONOMY").select("query", "impressions", "clicks", "overlap")


@register("SELECT count(*) AS files, sum(l_quantity) AS imported FROM lineitem")
def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.import_totals(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("imported")))


@register("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours; the same function runs on a stream with a watermark."""
    return ingest.windowed_counts(table(spark, sf_dir, "events"), by=["event_type"]).withColumn("total", F.round("total", 6))


@register("SELECT source, count(*) AS n FROM documents GROUP BY source")
def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@register("""WITH c AS (SELECT DISTINCT CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_nationkey::VARCHAR END AS exam, c_mktsegment AS subject FROM customer),
r AS (SELECT CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE s_nationkey::VARCHAR END AS exam, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'BUILDING' END AS subject, s_acctbal AS v FROM supplier)
SELECT c.exam, c.subject, count(*) AS n, round(sum(v), 6) AS total FROM c JOIN r ON (c.exam = '' OR coalesce(r.exam, '') = '' OR c.exam = r.exam) AND (c.subject = '' OR r.subject = '' OR c.subject = r.subject) GROUP BY ALL""")
def learned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate for each context, over the records that fit it loosely: suppliers as records, customers' nations and segments as contexts."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("c_exam"), F.col("c_mktsegment").alias("c_subject")).distinct()
    r = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 7 != 0, F.col("s_nationkey").cast("string")).alias("exam"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("BUILDING").alias("subject"), F.col("s_acctbal").alias("v"))
    return st.context_totals(c, r, {"n": F.lit(1), "total": F.col("v")}).select(F.col("c_exam").alias("exam"), F.col("c_subject").alias("subject"), "n", F.round("total", 6).alias("total"))


@register("""WITH r AS (SELECT p_name || ' ' || p_type AS query, count(*)::DOUBLE AS impressions, count_if(l_returnflag = 'R') / count(*) / 10 AS ctr, avg(l_linenumber) * 6 AS position FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(lower(query), ' ')), ['blue', 'ring'])) AS overlap FROM r WHERE impressions >= 5),
t AS (SELECT * FROM s WHERE overlap > 0 ORDER BY overlap DESC, impressions DESC, query LIMIT 15)
SELECT count(*) AS matches, least(1.0::DOUBLE, coalesce(sum(impressions), 0) / 500) AS confidence, coalesce(bool_or(ctr < 0.02 AND position > 15), false) AS weak_coverage FROM t""")
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    rows = sold.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("query")).agg(F.count("*").cast("double").alias("impressions"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*") / 10).alias("ctr"), (F.avg("l_linenumber") * 6).alias("position"))
    return coverage.search_confidence(coverage.search_matches(rows, "Blue ring"))


@register(f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {sql_half_up('1 - least(1.0::DOUBLE, l_discount * 0.25::DOUBLE + l_tax * 0.2::DOUBLE + l_discount * 0.15::DOUBLE + l_tax * 0.1::DOUBLE + 0.5::DOUBLE * 0.15::DOUBLE + l_tax * 0.15::DOUBLE)', 3)} AS novelty FROM lineitem")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fh.novelty_score(d, t, d, t, F.lit(0.5), t).alias("novelty"))


@register("SELECT c_custkey AS id, c_acctbal AS v, c_custkey % 2 = 0 AS derived FROM customer UNION ALL SELECT s_suppkey * 20, s_acctbal, true FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers inserted among customers as records, where their id is new."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), (F.col("c_custkey") % 2 == 0).alias("derived"))
    return sinks.insert_missing(old, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("id"), F.col("s_acctbal").alias("v"), F.lit(True).alias("derived")))
