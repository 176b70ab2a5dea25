"""A search index that takes changes: segments that are never rewritten, and compaction.

Each update writes one segment: the bags and blocks of the documents that are
new or changed, the keys that it takes out of earlier segments (changed and
deleted documents), and what it adds to or takes from each term's document
frequency and the totals, which it knows from the bags of the documents that
go.  A manifest lists the segments in order; it is published by the pointer of
``sinks.publish``, so readers see all of an update or nothing, and a segment
that a failed update left behind is never read.  Searching adds frequencies and
totals up and skips documents that a later segment took out.  ``compact`` writes
what is alive as one segment.

Frequencies, counts and lengths are exact after any sequence of updates, so
results equal those of an index built anew.  A key is written and deleted in one
update: it is written.  Deleting an unknown key does nothing.  Null keys are
left out; of several rows with one key in an update one with the greatest text
stays.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import ranking, search
from lexiloom.session import small_or_shuffled
from lexiloom.sources import sinks

#: Segments that may be listed: their number fills the upper bits of a block's.
MOST = 1 << (62 - ranking.SEGMENT_BITS)


def _listed(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """Number and folder of the published segments."""
    return sorted((r.number, r.path) for r in sinks.published(spark, target, "segments", "number long, path string").collect())  # MOST rows


def _all(spark: SparkSession, listed: list[tuple[int, str]], name: str) -> DataFrame:
    """A table of all segments, with the number of the segment of each row."""
    out = None
    for number, path in listed:
        one = spark.read.parquet(f"{path}/{name}").withColumn("segment", F.lit(number))
        out = one if out is None else out.unionByName(one)
    return out


def _alive(spark: SparkSession, listed: list[tuple[int, str]], key: str) -> DataFrame:
    """The bags of the documents that no later segment took out."""
    gone = _all(spark, listed, "gone").groupBy(key).agg(F.max("segment").alias("last"))
    bags = _all(spark, listed, "bags")
    return bags.alias("b").join(gone.alias("g"), (F.col(f"b.{key}") == F.col(f"g.{key}")) & (F.col("b.segment") < F.col("g.last")), "left_anti")


def _write(spark: SparkSession, target: str, number: int, bags: DataFrame, gone: DataFrame, lost: DataFrame | None, key: str) -> str:
    """Writes a segment of new bags, keys that go, and the bags that are lost by it."""
    path = f"{target}/s-{uuid.uuid4().hex}"
    ranking.with_block(bags.select(key, "doc_len", "terms"), number).write.parquet(f"{path}/bags")
    mine = spark.read.parquet(f"{path}/bags")
    ranking.make_blocks(mine, key).write.parquet(f"{path}/blocks")
    gone.select(key).distinct().write.parquet(f"{path}/gone")
    signed = mine.select("doc_len", F.col("terms.term").alias("terms"), F.lit(1).alias("sign"))
    if lost is not None:
        signed = signed.unionByName(lost.select("doc_len", F.col("terms.term").alias("terms"), F.lit(-1).alias("sign")))
    signed.select("sign", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("sign").alias("n")).where("n <> 0").write.parquet(f"{path}/df")
    signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("sign") * F.col("doc_len")), F.lit(0)).alias("length")).write.parquet(f"{path}/totals")
    return path


def _publish(spark: SparkSession, target: str, listed: list[tuple[int, str]]) -> None:
    sinks.publish(spark, target, {"segments": spark.createDataFrame(listed, "number long, path string").coalesce(1)}, lambda t: None)


def update(spark: SparkSession, target: str, changed: DataFrame | None = None, deleted: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> int:
    """Publishes a segment with the new and changed documents (key, text) and without the deleted ones (key); its number."""
    listed = _listed(spark, target)
    number = max((n for n, _ in listed), default=-1) + 1
    if number >= MOST:
        raise ValueError(f"{number} segments: compact the index")
    if changed is None and deleted is None:
        raise ValueError("nothing to update")
    kind = (changed if changed is not None else deleted).schema[key].dataType
    empty = spark.createDataFrame([], f"{key} {kind.simpleString()}, {text} string")
    rows = (changed.select(key, text) if changed is not None else empty).where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias(text))
    gone = rows.select(key) if deleted is None else rows.select(key).union(deleted.select(key).where(F.col(key).isNotNull()))
    lost = _alive(spark, listed, key).join(small_or_shuffled(gone.distinct()), key, "left_semi") if listed else None
    path = _write(spark, target, number, search.bags(rows, key, text), gone, lost, key)
    _publish(spark, target, [*listed, (number, path)])
    return number


def compact(spark: SparkSession, target: str, key: str = "doc_id") -> None:
    """Publishes one segment with all that is alive in place of the listed ones."""
    listed = _listed(spark, target)
    alive = _alive(spark, listed, key)
    # the segment is the first one of a new count, so block numbers have room again
    path = _write(spark, target, 0, alive, alive.select(key).limit(0), None, key)
    _publish(spark, target, [(0, path)])


def load(spark: SparkSession, target: str, docs: DataFrame, key: str = "doc_id") -> search.Index:
    """The published state of the index; docs is what filters look at."""
    listed = _listed(spark, target)
    if not listed:
        raise FileNotFoundError(target)
    alive = _alive(spark, listed, key)
    df = _all(spark, listed, "df").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")
    totals = _all(spark, listed, "totals").agg(F.sum("docs").alias("doc_count"), F.sum("length").alias("length"))
    meta = totals.select("doc_count", F.when(F.col("doc_count") > 0, F.col("length") / F.col("doc_count")).alias("avg_doc_len"))
    return search.Index(docs, search.exploded(alive, key), df, meta, alive, _all(spark, listed, "blocks"))
