"""From raw documents to token ids, in stages written and read again one by one.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the columns of documents, but for the last, which returns
token ids.  Rows with a null or empty text fail the quality rules and go.
Every row is judged by itself: ids may be null or repeated, and rows that
repeat are near duplicates like any others, of which one stays.  Further
columns pass through, whatever their names.  An empty table, or one that a
stage has emptied, gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import bpe, decontam, lang_id, ngram_join, quality
from lexiloom.llm.common import read_table, stored


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as one column, beside those that an operator reads, so that no names clash; the text is read in it."""
    return docs.select(F.struct(*docs.columns).alias("_whole_row"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and its group's adaptive fences."""
    # texts are measured twice, which costs less than to store whole rows with their counts
    known = quality.measure(docs, ["lang", "source"])
    limits = stored(quality.thresholds(stored(quality.sketch(known, ["lang", "source"]))))
    measured = quality.measure(_wrapped(docs, "lang", "source"), ["_whole_row", "lang", "source"], "_whole_row.text")
    return quality.apply_rules(measured, limits).where("kept").select("_whole_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is near enough to a learned language; learns from the rows not held out."""
    model = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id"))))
    return lang_id.predict(_wrapped(docs), model, ["_whole_row"], "_whole_row.text").where(~F.col("rejected")).select("_whole_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows one with the least doc_id, or any if all ids are null; rows without words have no group."""
    keyed = stored(_wrapped(docs, "doc_id").withColumn("_row", F.monotonically_increasing_id()))
    linked = stored(ngram_join.link(keyed.select("doc_id", "_row", F.col("_whole_row.text").alias("text")), 80, 5, ["doc_id", "_row"]).select("doc_id", "_row", "label"))
    first = linked.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select("first._row")
    return keyed.join(first.union(linked.where("label is null").select("_row")), "_row", "left_semi").select("_whole_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no window of ten words of the benchmark."""
    return decontam.remove(docs, read_table(spark, sf_dir, "benchmark"), width=10)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether decoding them gives the text back."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: The stages hold a fitted classifier and a tokenizer, which SQL cannot express; tests/llm has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
