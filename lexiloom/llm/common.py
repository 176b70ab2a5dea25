"""What the operators of this subpackage share: stored tables and exact ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lexiloom.session import shared_folder, ship_code


#: Rows of an Arrow batch: texts are long, and a batch is held by Spark and by Python at the same time.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Sees to it that Arrow batches have at most BATCH_ROWS rows; a session that asks for fewer keeps its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read from there.

    It cuts the lineage: a lost executor costs a read, not the steps before.
    """
    spark = df.sparkSession
    ship_code(spark)
    bound_batches(spark)
    path = f"{shared_folder(spark)}/lexiloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again: what was made of them must be stored itself."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow table that may be sent to all tasks.
BROADCAST_ROWS = 500_000


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows; otherwise joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; sees to it that the workers have this library's code and that batches are bounded."""
    ship_code(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_text(keep: list[str], text: str) -> tuple[list[str], str]:
    """Columns to send to a function that keeps ``keep`` and reads ``text``, and where it finds the text.

    A text that lies in a kept column, or in a field of one (column.field), is
    sent once.
    """
    return ([*keep], text) if text.split(".")[0] in keep else ([*keep, text], text)


def column_at(batch: pa.RecordBatch, path: str) -> pa.Array:
    """The column of a batch, or the field of a struct column."""
    name, *fields = path.split(".")
    found = batch.column(batch.schema.get_field_index(name))
    for field in fields:
        found = pc.struct_field(found, field)
    return found


#: Rows that one window of an exact rank may hold on average.
RANK_BLOCK = 100_000


def ranked(df: DataFrame, parts: list[str], spread: Column, order: list[Column], rows: int, name: str = "rank", least: int = 1) -> DataFrame:
    """Adds a gapless rank from 0 within parts, without one window per part.

    ``spread`` is an integer hash; its blocks are ranked apart and shifted by
    the counts of the blocks before them, so a part's order is (block, order).
    There are ``least`` blocks or more.
    """
    blocks = max(least, -(-rows // RANK_BLOCK))
    keyed = df.withColumn("_block", F.pmod(spread, F.lit(blocks)).cast("int"))
    keys = [*parts, "_block"]
    inner = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    if blocks == 1:
        return inner.withColumn(name, F.col("_rank").cast("long")).drop("_block", "_rank")
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*parts).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = inner.alias("a").join(starts.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return joined.select("a.*", (F.col("a._rank") + F.col("b._start")).cast("long").alias(name)).drop("_block", "_rank")


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, after the workers have been given this library's code and batches a bound."""
    ship_code(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
