"""The k best documents by BM25 from a part of the postings.

An index is stored by blocks of documents: ``blocks`` has a row for each term
and block, with the entries (doc, tf, doc_len) of at most ``BLOCK`` documents, and
``tops`` the highest contribution, less its IDF, that any of them makes.  ``bags``
has each document's own terms.  A query runs in four steps.

1. *Seeds.*  The documents with most of a query's rarest terms are scored whole,
   in their own rows; the k-th best gives a score that the result surely
   reaches.
2. *Plan.*  In each block, terms whose highest contributions together stay below
   that score are not essential: a document with no other term is out, however
   often it has them.  Blocks without an essential term are skipped.
3. *Candidates.*  Only entries of essential terms are read and added up; a
   document stays if the sum, and the most that the other terms can add, reach
   the score.
4. *Scores.*  Candidates are scored whole in their own rows, and of those the k
   best of each query survive on each side of the shuffle.

Bounds are never below a score, and equal ones are kept, so the result is that
of scoring every pair, ties included.  Plans and candidates are sent to all
tasks only while they are counted to be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.session import small_or_shuffled, stored

K1, B = 1.5, 0.75
#: Documents of a block, at most.
BLOCK = 1024
#: Entries of a query's rarest terms that are read for its seeds, and seeds for each result.
SEED_ENTRIES, SEEDS = 2000, 8
#: What rounding may add to a score.
SLACK = 1e-8
#: Bits of a block's number below its segment's, and below its partition's.
SEGMENT_BITS, PART_BITS = 54, 23


def idf(n: Column, doc_count: Column) -> Column:
    return F.log(1 + (doc_count - n + 0.5) / (n + 0.5))


def weight(tf: Column, doc_len: Column, avg_doc_len: Column) -> Column:
    """What a term adds to a score for each unit of its IDF."""
    average = F.when(avg_doc_len > 0, avg_doc_len).otherwise(F.lit(1.0))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * (doc_len / average)))


def with_block(bags: DataFrame, segment: int = 0, size: int = BLOCK) -> DataFrame:
    """bags with ``block``, the number of their block: as many rows in a row as a block holds, of one task.

    It must be stored, for the number depends on how the rows are split.
    """
    at = F.monotonically_increasing_id()
    inside = F.shiftright(at.bitwiseAND((1 << 33) - 1), size.bit_length() - 1)
    part = F.call_function("shiftleft", F.shiftright(at, 33), F.lit(PART_BITS))
    return bags.withColumn("block", (F.lit(segment << SEGMENT_BITS) + part + inside).cast("long"))


def make_blocks(bags: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, block, n, top, avg_doc_len, entries of stored bags (key, doc_len, terms, block).

    top holds for the average length of these bags; where that changes by a
    factor, the top does by no more.
    """
    average = bags.agg(F.avg("doc_len").alias("avg_doc_len"))
    each = bags.select(F.col(key).alias("doc"), "doc_len", "block", F.explode("terms").alias("t")).crossJoin(F.broadcast(average))  # one row
    entry = F.struct("doc", F.col("t.tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len"))
    made = each.groupBy(F.col("t.term").alias("term"), "block").agg(F.count("*").alias("n"), F.max(weight(F.col("t.tf"), F.col("doc_len"), F.col("avg_doc_len"))).alias("top"), F.max("avg_doc_len").alias("avg_doc_len"), F.collect_list(entry).alias("entries"))  # BLOCK entries at most
    return made.sortWithinPartitions("term", "block")  # so that readers skip row groups by term


def query_weights(terms: DataFrame, df: DataFrame, meta: DataFrame, query_key: str) -> DataFrame:
    """query_key, term, n, idf, avg_doc_len of the queries' distinct terms (query_key, term) that the index has; stored."""
    terms = stored(terms)
    asked = small_or_shuffled(terms)
    found = df.join(asked, "term").crossJoin(F.broadcast(meta))  # meta has one row
    return stored(found.select(query_key, "term", "n", idf(F.col("n"), F.col("doc_count")).alias("idf"), "avg_doc_len"))


def _part(query: str) -> Column:
    return F.col("idf") * weight(F.col("e.tf"), F.col("e.doc_len"), F.col("avg_doc_len"))


def scores_of(pairs: DataFrame, bags: DataFrame, weights: DataFrame, doc_key: str, query_key: str) -> DataFrame:
    """query_key, doc_key, score (9 places) of pairs (query_key, doc_key), each added up in the document's own row; 0 without a common term."""
    asked = weights.groupBy(query_key).agg(F.map_from_entries(F.collect_list(F.struct(F.xxhash64("term"), "idf"))).alias("w"), F.max("avg_doc_len").alias("avg_doc_len"))  # the terms of one query
    split = bags.select(doc_key, "doc_len", F.transform("terms.term", lambda t: F.xxhash64(t)).alias("_terms"), F.col("terms.tf").alias("_tfs"))
    rows = split.join(small_or_shuffled(pairs), doc_key).join(small_or_shuffled(stored(asked)), query_key)
    # terms are 64-bit hashes here; the few common ones come from a hash set, and only they are looked up
    mine = F.array_intersect("_terms", F.map_keys("w"))
    tf = lambda t: F.element_at("_tfs", F.array_position("_terms", t).cast("int"))
    total = F.aggregate(mine, F.lit(0.0), lambda a, t: a + F.element_at("w", t) * weight(tf(t), F.col("doc_len"), F.col("avg_doc_len")))
    return rows.select(query_key, doc_key, F.round(total, 9).alias("score"))


def limits(blocks: DataFrame, bags: DataFrame, weights: DataFrame, k: int, doc_key: str, query_key: str, pool: DataFrame | None = None) -> DataFrame:
    """query_key, least: a score that the k-th best document of the query reaches; 0 where the seeds are fewer; stored."""
    rarest = W.partitionBy(query_key).orderBy("n", "term").rowsBetween(W.unboundedPreceding, 0)
    rare = stored(weights.withColumn("upto", F.sum("n").over(rarest)).withColumn("first", F.count("*").over(rarest)).where((F.col("upto") <= SEED_ENTRIES) | (F.col("first") == 1)).drop("upto", "first"))
    hits = blocks.select("term", "entries").join(small_or_shuffled(rare), "term").select(query_key, "idf", "avg_doc_len", F.explode("entries").alias("e"))
    sums = hits.groupBy(query_key, F.col("e.doc").alias(doc_key)).agg(F.sum(_part(query_key)).alias("sum"))
    if pool is not None:
        sums = sums.join(pool, doc_key, "left_semi")
    best = sums.withColumn("r", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("sum"), doc_key))).where(F.col("r") <= SEEDS * k)
    whole = scores_of(stored(best.select(query_key, doc_key)), bags, weights, doc_key, query_key)
    kth = whole.withColumn("r", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), doc_key))).where(F.col("r") == k).select(query_key, F.col("score").alias("least"))
    every = weights.select(query_key).distinct()
    return stored(every.join(kth, query_key, "left").select(query_key, F.coalesce("least", F.lit(0.0)).alias("least")))


def plan(tops: DataFrame, weights: DataFrame, least: DataFrame, query_key: str) -> DataFrame:
    """query_key, block, term, idf, avg_doc_len, n, rest, least of the essential terms of each block; stored.

    rest is the most that the other terms of the query can add in that block.
    """
    grown = F.greatest(F.lit(1.0), F.col("w.avg_doc_len") / F.when(F.col("t.avg_doc_len") > 0, F.col("t.avg_doc_len")).otherwise(F.lit(1.0)))
    asked = small_or_shuffled(weights).alias("w")
    bounds = tops.alias("t").join(asked, F.col("t.term") == F.col("w.term")).select(f"w.{query_key}", "t.block", "w.avg_doc_len", F.struct((F.col("idf") * F.col("top") * grown).alias("bound"), "w.term", "w.idf", "t.n").alias("b"))
    grouped = bounds.groupBy(query_key, "block", "avg_doc_len").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # the terms of one query
    known = grouped.join(small_or_shuffled(least), query_key)
    below = F.col("least") - SLACK
    # bounds ascend, so once the sum reaches the limit all further terms are essential
    rest = F.aggregate("bs", F.lit(0.0), lambda a, b: F.when(a + b["bound"] < below, a + b["bound"]).otherwise(a))
    count = F.aggregate("bs", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, b: F.when(a["sum"] + b["bound"] < below, F.struct((a["sum"] + b["bound"]).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(a))["n"]
    cut = known.select(query_key, "block", "avg_doc_len", "least", rest.alias("rest"), F.slice("bs", count + 1, F.size("bs")).alias("bs"))
    return stored(cut.select(query_key, "block", "avg_doc_len", "least", "rest", F.explode("bs").alias("b")).select(query_key, "block", "avg_doc_len", "least", "rest", "b.term", "b.idf", "b.n"))


def candidates(blocks: DataFrame, planned: DataFrame, doc_key: str, query_key: str) -> DataFrame:
    """query_key, doc_key of the documents that may be among the best."""
    hits = blocks.select("term", "block", "entries").join(small_or_shuffled(planned.drop("n")), ["term", "block"]).select(query_key, "idf", "avg_doc_len", "rest", "least", F.explode("entries").alias("e"))
    sums = hits.groupBy(query_key, F.col("e.doc").alias(doc_key)).agg(F.sum(_part(query_key)).alias("sum"), F.max("rest").alias("rest"), F.max("least").alias("least"))
    return sums.where(F.col("sum") + F.col("rest") >= F.col("least") - SLACK).select(query_key, doc_key)


def best(bags: DataFrame, blocks: DataFrame, weights: DataFrame, k: int, doc_key: str, query_key: str, pool: DataFrame | None = None) -> DataFrame:
    """query_key, doc_key, score, rank of the k best documents of each query, of those in the pool (doc_key) if one is given."""
    pool = None if pool is None else stored(pool)
    least = limits(blocks, bags, weights, k, doc_key, query_key, pool)
    found = candidates(blocks, plan(blocks.select("term", "block", "n", "top", "avg_doc_len"), weights, least, query_key), doc_key, query_key)
    if pool is not None:
        found = found.join(pool, doc_key, "left_semi")
    scored = scores_of(stored(found), bags, weights, doc_key, query_key)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), doc_key)))
    return ranked.where((F.col("rank") <= k) & (F.col("score") > 0))  # a filter on scores before the window would compute them twice
