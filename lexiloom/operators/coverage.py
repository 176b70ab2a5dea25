"""Syllabus coverage, backlogs and search signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.numbers import round_half_up
from lexiloom.functions.text import normalize_topic, search_tokens


def backlog(topics: DataFrame, published: DataFrame) -> DataFrame:
    """topics (exam, subject, topic) that nothing published (exam, topic) has, by normalised topic."""
    done = published.select("exam", normalize_topic(F.col("topic")).alias("_t")).distinct()
    return topics.withColumn("_t", normalize_topic(F.col("topic"))).join(done, ["exam", "_t"], "left_anti").drop("_t")


def backlog_lists(open_topics: DataFrame) -> DataFrame:
    """exam, subject, topics: one list for each pair, sorted."""
    return open_topics.groupBy("exam", "subject").agg(F.array_sort(F.collect_list("topic")).alias("topics"), F.count("*").alias("n_open"))


def done_flags(topics: DataFrame, published: DataFrame) -> DataFrame:
    """topics with done: the dashboard's exact match, only trimmed."""
    keys = published.select("exam", F.trim("topic").alias("_t")).distinct().withColumn("_done", F.lit(True))
    joined = topics.withColumn("_t", F.trim("topic")).join(keys, ["exam", "_t"], "left")
    return joined.withColumn("done", F.coalesce("_done", F.lit(False))).drop("_t", "_done")


def percent_done(flagged: DataFrame, by: list[str]) -> DataFrame:
    share = F.when(F.count("*") > 0, round_half_up(100 * F.count_if("done") / F.count("*"))).otherwise(0.0)
    return flagged.groupBy(*by).agg(F.count_if("done").alias("done"), F.count("*").alias("total"), share.cast("int").alias("percent"))


def not_duplicates(candidates: DataFrame, pending: DataFrame, published: DataFrame) -> DataFrame:
    """Candidates (topic, exam, slug) neither pending by topic and exam nor published by slug."""
    return candidates.join(pending.select("topic", "exam"), ["topic", "exam"], "left_anti").join(published.select("slug"), "slug", "left_anti")


def known_pairs(history: DataFrame, open_topics: DataFrame) -> DataFrame:
    """exam, subject, used, n_open of all pairs seen in either table."""
    used = history.groupBy("exam", "subject").agg(F.count("*").alias("used"))
    left = open_topics.groupBy("exam", "subject").agg(F.count("*").alias("n_open"))
    return used.join(left, ["exam", "subject"], "full_outer").select("exam", "subject", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def search_matches(rows: DataFrame, topic: str, least: float = 5, k: int = 15) -> DataFrame:
    """The k search queries that share most words with the topic; rows have query, clicks, impressions, ctr, position."""
    words = F.array_distinct(search_tokens(F.lit(topic)))
    scored = rows.where(F.coalesce("impressions", F.lit(0)) >= least).withColumn("overlap", F.size(F.array_intersect(words, F.array_distinct(search_tokens(F.col("query"))))))
    return scored.where("overlap > 0").orderBy(F.desc("overlap"), F.desc("impressions"), "query").limit(k)


def search_confidence(matched: DataFrame) -> DataFrame:
    """One row: matches, confidence (impressions out of 500) and weak_coverage."""
    return matched.agg(F.count("*").alias("matches"), F.least(F.lit(1.0), F.coalesce(F.sum("impressions"), F.lit(0)) / 500).alias("confidence"), F.coalesce(F.bool_or((F.col("ctr") < 0.02) & (F.col("position") > 15)), F.lit(False)).alias("weak_coverage"))


def import_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("files"), F.coalesce(F.sum("imported"), F.lit(0)).alias("imported"))


def free_text(rows: DataFrame, query: str, fields: list[str]) -> DataFrame:
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(query.lower()))
    return rows.where(hit)


def newest_first(rows: DataFrame, date: str = "published", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.coalesce(date, F.lit("")).desc(), tie)
