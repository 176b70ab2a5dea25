"""BM25 search: index tables, scoring and ranked retrieval.

The index is docs, postings(doc_id, term, tf, doc_len), df(term, n) and a
one-row meta.  It is built in one pass over the texts: a document's terms are
counted within its row, so only terms are shuffled.  ``publish_index`` stores it
as a version that ``load_index`` reads, with the blocks by which the best
documents are found from a part of the postings (see ``ranking``).  ``score``
scores every pair with a common term; it serves indexes that are not stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.numbers import let
from lexiloom.functions.text import search_tokens
from lexiloom.operators import ranking
from lexiloom.session import small_or_shuffled, stored
from lexiloom.sources import sinks


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    df: DataFrame
    meta: DataFrame  # doc_count, avg_doc_len
    bags: DataFrame | None = None  # a stored index has its documents' terms, with the number of their block
    blocks: DataFrame | None = None  # and the postings by blocks


def term_counts(tokens: Column) -> Column:
    """array of struct(term, tf) of an array of tokens: the runs of the sorted array."""
    none = F.array().cast("array<struct<term:string,tf:int>>")

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        made = let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.try_element_at(at, k + 2), n + 1) - i).alias("tf"))))
        return F.when(n == 0, none).otherwise(made)

    return let(F.sort_array(tokens), runs)


def bags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_len, terms (array of struct(term, tf)) of each document."""
    tokens = docs.select(key, let(search_tokens(F.col(text)), lambda t: F.struct(F.size(t).alias("doc_len"), term_counts(t).alias("terms"))).alias("_b"))
    return tokens.select(key, "_b.doc_len", "_b.terms")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_len, term, tf."""
    return exploded(bags(docs, key, text), key)


def exploded(made: DataFrame, key: str) -> DataFrame:
    """The postings of bags."""
    # the outer form keeps Catalyst from testing the array's size, and so splitting the text, below the scan
    each = made.select(key, "doc_len", F.explode_outer("terms").alias("_t")).where("_t is not null")
    return each.select(key, "doc_len", "_t.term", F.col("_t.tf").cast("long").alias("tf"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Statistics cover all documents, whatever filter a search has."""
    made = bags(docs, key, text)
    meta = made.agg(F.count("*").alias("doc_count"), F.avg("doc_len").alias("avg_doc_len"))
    each = exploded(made, key)
    return Index(docs, each, each.groupBy("term").agg(F.count("*").alias("n")), meta)


def publish_index(docs: DataFrame, target: str, key: str = "doc_id", text: str = "text") -> Index:
    """Builds the index of docs, stores it as a new version below target and gives it back as stored.

    The texts are tokenised once, into bags; the other tables are made of those.
    """
    spark = docs.sparkSession

    def problem(tables: dict[str, DataFrame]) -> str | None:
        row = tables["meta"].first()
        return "NO_META" if row is None else "BAD_DOC_COUNT" if row.doc_count != tables["bags"].count() else None

    def tables(read: DataFrame) -> dict[str, DataFrame]:
        each = exploded(read, key)
        return {"postings": each, "df": each.groupBy("term").agg(F.count("*").alias("n")), "meta": read.agg(F.count("*").alias("doc_count"), F.avg("doc_len").alias("avg_doc_len")), "blocks": ranking.make_blocks(read, key)}

    sinks.publish(spark, target, {"bags": ranking.with_block(bags(docs, key, text))}, problem, derived=tables)
    return load_index(spark, target, docs)


def load_index(spark: SparkSession, target: str, docs: DataFrame) -> Index:
    """The published index of docs."""
    return Index(docs, *(sinks.published(spark, target, name) for name in ("postings", "df", "meta", "bags", "blocks")))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    return queries.select(key, F.explode(F.array_distinct(search_tokens(F.col(text)))).alias("term"))


def score(index: Index, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_key, doc_key, score (9 places, so that equal texts tie) of every pair with a common term."""
    terms = stored(query_terms(queries, query_key, query_text))
    asked = small_or_shuffled(terms.select("term").distinct())
    terms = small_or_shuffled(terms)
    wanted = index.postings.join(terms, "term")
    with_df = wanted.join(index.df.join(asked, "term", "left_semi"), "term").crossJoin(F.broadcast(index.meta))  # meta has one row
    one = ranking.idf(F.col("n"), F.col("doc_count")) * ranking.weight(F.col("tf"), F.col("doc_len"), F.col("avg_doc_len"))
    return with_df.groupBy(query_key, doc_key).agg(F.round(F.sum(one), 9).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int | None, doc_key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """The k best documents of each query; 0 and None mean 5.  Ties go to the smaller key.

    Only the k best of a query survive on each side of the shuffle.
    """
    order = W.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (k or 5))


def matches_filter(wanted: dict[str, str], doc: dict[str, Column]) -> Column:
    """Conjunction of case-insensitive filters: equality, or membership for array fields (topic, concept)."""
    def one(column: Column, value: str, member: bool) -> Column:
        low = F.lit(value.lower())
        return F.exists(column, lambda x: F.lower(x) == low) if member else F.lower(column.cast("string")) == low

    out = F.lit(True)
    for field, value in wanted.items():
        if value:
            out = out & F.coalesce(one(doc[field], value, field in ("topic", "concept")), F.lit(False))
    return out


def filter_pool(docs: DataFrame, condition: Column, fallback: bool = False) -> DataFrame:
    """Documents that fit; with fallback all of them where none fits."""
    if not fallback:
        return docs.where(condition)
    hit = docs.withColumn("_hit", F.coalesce(condition, F.lit(False)))
    some = hit.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_some"))  # one row
    return hit.crossJoin(F.broadcast(some)).where("_hit or not _some").drop("_hit", "_some")


def retrieve(index: Index, queries: DataFrame, k: int | None = 5, condition: Column | None = None, fallback: bool = False, doc_key: str = "doc_id", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_key, doc_key, score, rank of the best documents within the filtered pool; 0 and None for k mean 5."""
    if index.blocks is not None:
        pool = None if condition is None else filter_pool(index.docs, condition, fallback).select(doc_key).distinct()
        weights = ranking.query_weights(query_terms(queries, query_key, query_text), index.df, index.meta, query_key)
        return ranking.best(index.bags, index.blocks, weights, k or 5, doc_key, query_key, pool)
    scores = score(index, queries, doc_key, query_key, query_text)
    if condition is not None:
        scores = scores.join(filter_pool(index.docs, condition, fallback).select(doc_key), doc_key, "left_semi")
    return top_k(scores, k, doc_key, query_key)


def has_corpus(docs: DataFrame) -> bool:
    return not docs.isEmpty()


def index_info(index: Index) -> DataFrame:
    return index.meta


def content_version(docs: DataFrame, key: str = "id", text: str = "text", by: list[str] | None = None, whole: bool = False) -> DataFrame:
    """First 16 hex digits of a SHA-256 over ids and texts in id order.

    Texts are digested first, then the digests of 256 blocks of ids, then the
    blocks, so no row holds a corpus; with ``whole`` it is the digest of the
    plain concatenation, which fits small packages only.
    """
    by = by or []
    name = F.col(key).cast("string")
    part = F.concat(F.coalesce(name, F.lit("")), F.lit("\u0000"), F.coalesce(F.col(text), F.lit("")), F.lit("\u0000"))
    rows = docs.select(*by, name.alias("_k"), (part if whole else F.sha2(part, 256)).alias("_d"), (F.lit("") if whole else F.left(F.md5(name.cast("binary")), F.lit(2))).alias("_b"))
    in_order = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "_d"))), lambda x: x["_d"]), "")
    first = rows.groupBy(*by, "_b").agg(F.sha2(in_order("_k"), 256).alias("_d"))
    made = first if whole else first.groupBy(*by).agg(F.sha2(in_order("_b"), 256).alias("_d"))
    return made.select(*by, F.left("_d", F.lit(16)).alias("index_version"))
