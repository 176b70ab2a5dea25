"""A table of records in buckets of their key, of which an upsert rewrites only those it changes.

A manifest says where each bucket lies; it is published by the pointer of
``sinks.publish``, so readers see all of an upsert or nothing, and files of
buckets that an upsert does not change keep their names.  The number of buckets
is set by the first write.

Null keys are equal to no key: such records are all inserted, into a bucket of
their own.  Of several new records with one key in an upsert one stays.  An
upsert that changes nothing publishes nothing.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import stored
from lexiloom.sources import sinks

MANIFEST = "bucket int, path string, buckets int"


def manifest(spark: SparkSession, target: str) -> list:
    """bucket, path and number of buckets of the published table, a row for each bucket with records."""
    return sinks.published(spark, target, "buckets", MANIFEST).collect()


def _read(spark: SparkSession, paths: list[str], like: DataFrame) -> DataFrame:
    """The records of some buckets; none, with the columns of ``like``, where there are none yet."""
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else like.limit(0)


def records(spark: SparkSession, target: str) -> DataFrame:
    """All records of the published table."""
    paths = [r.path for r in manifest(spark, target)]
    if not paths:
        raise FileNotFoundError(target)
    return _read(spark, paths, spark.range(0))


def upsert(spark: SparkSession, target: str, derived: DataFrame, force: bool = False, key: str = "id", buckets: int = 64) -> list[int]:
    """Inserts derived records by the rule of ``sinks.insert_missing``; the buckets that it wrote anew."""
    held = {r.bucket: r for r in manifest(spark, target)}
    count = next((r.buckets for r in held.values()), buckets)
    bucket: Column = F.when(F.col(key).isNull(), F.lit(count)).otherwise(F.pmod(F.xxhash64(F.col(key)), F.lit(count))).cast("int")
    named = derived.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(derived.where(F.col(key).isNull()))
    coming = stored(named.withColumn("_bucket", bucket))
    asked = [r[0] for r in coming.select("_bucket").distinct().collect()]  # ``buckets`` + 1 at most
    old = _read(spark, [held[b].path for b in asked if b in held], derived)
    fixed = old.where(~F.coalesce(F.col("derived"), F.lit(False))) if force else old
    changed = sorted(r[0] for r in coming.join(fixed.select(key), key, "left_anti").select("_bucket").distinct().collect())
    if not changed:
        return []
    before = _read(spark, [held[b].path for b in changed if b in held], derived)
    made = sinks.insert_missing(before, coming.where(F.col("_bucket").isin(changed)).drop("_bucket"), force)
    group = f"{target}/g-{uuid.uuid4().hex}"
    made.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(group)
    now = {b: (r.bucket, r.path, count) for b, r in held.items()} | {b: (b, f"{group}/_bucket={b}", count) for b in changed}
    sinks.publish(spark, target, {"buckets": spark.createDataFrame(list(now.values()), MANIFEST).coalesce(1)}, lambda t: None)
    return changed
