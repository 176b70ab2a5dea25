"""One query for each training-data operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, importance, lang_id, licenses, minhash, ngram_join, oracles, quality, shards, token_counts, url_filters, vector_codes, warc
from .common import read_table, stored


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def damaged(laid: DataFrame) -> DataFrame:
    """file, page_id, record of a replica with damage by rule.

    Ids that leave 7 when divided by 97 have their last character replaced.  Of
    every thousand ids, 60 is lost, 110 stands there twice and the record of
    230 has a damaged first line.
    """
    i = F.col("page_id")
    rest = lambda n, r: F.coalesce(i % n == r, F.lit(False))
    html = F.when(rest(97, 7) & (F.length("html") > 0), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("\x00"))).otherwise(F.col("html"))
    whole = warc.record_bytes(i, F.col("url"), html)
    record = F.when(rest(1000, 230), F.concat(F.lit("XARC").cast("binary"), F.substring(whole, 5, 1 << 30))).otherwise(whole)
    times = F.when(rest(1000, 60), 0).when(rest(1000, 110), 2).otherwise(1)
    return laid.select("file", "page_id", record.alias("record"), F.explode(F.array_repeat(F.lit(1), times)).alias("one")).drop("one")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the pages' archive are written as WARC bytes, one with damage, read back and audited."""
    laid = warc.lay_out(read_table(spark, sf_dir, "pages"))
    whole = laid.select("file", "page_id", warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    left, right = (stored(warc.facts(warc.read_archives(warc.archives(r)))) for r in (whole, damaged(laid)))
    return warc.audit(left, right)


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read_table(spark, sf_dir, "documents"), shards=24)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read_table(spark, sf_dir, "documents"), percent=80, width=5)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=10)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.verdicts(read_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stored(quality.measure(read_table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"]))
    judged = quality.apply_rules(measured, stored(quality.thresholds(stored(quality.sketch(measured, ["lang", "source"])))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), least_words=20, percent=25, seed=7)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=80, width=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_bpe_round_trip, op3_warc_fixity, op4_balanced_shards, op5_ngram_jaccard_join, op6_decontamination, op7_url_filters, op8_quality_rules, op9_license_scan, op10_token_counts, op11_vector_codes, op12_importance_resampling, op13_minhash_near_dedup)
}

#: Queries with a DuckDB equivalent; the others are tested in tests/llm.
ORACLES: dict[str, str] = {
    "op3_warc_fixity": oracles.fixity(),
    "op5_ngram_jaccard_join": oracles.components(),
    "op6_decontamination": oracles.decontamination(),
    "op7_url_filters": oracles.urls(),
    "op8_quality_rules": oracles.quality(),
    "op9_license_scan": oracles.licenses(),
    "op11_vector_codes": oracles.vector_codes(),
    "op12_importance_resampling": oracles.importance(),
    "op13_minhash_near_dedup": oracles.near_duplicates(),
}
