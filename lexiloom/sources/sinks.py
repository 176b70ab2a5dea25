"""Sinks: published index versions, routed packages, state files and history records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, target: str, tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], str | None], derived: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> str:
    """Writes the tables as a new version below target and points to it if validate finds nothing.

    ``derived`` makes further tables of the first table as it was written.  A
    pointer is a folder ``current-<number>`` with one row; it appears by one
    rename when its row is whole, and readers take the highest number, so at
    every moment the old version or the new one is published.
    """
    version = f"{target}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    if derived:
        for name, df in derived(spark.read.parquet(f"{version}/{next(iter(tables))}")).items():
            df.write.parquet(f"{version}/{name}")
            tables = tables | {name: df}
    problem = validate({name: spark.read.parquet(f"{version}/{name}") for name in tables})
    if problem:
        raise ValueError(f"not published: {problem}")
    fs, _, path = _fs(spark, target)
    made, before = f"{target}/pointer-{uuid.uuid4().hex}", _pointers(spark, target)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(made)
    number = int(before[-1].rsplit("-", 1)[1]) + 1 if before else 1
    if not fs.rename(path(made), path(f"{target}/current-{number:012d}")):
        raise OSError(f"could not move the pointer of {target}")
    for old in before:
        fs.delete(path(f"{target}/{old}"), True)
    return version


def _pointers(spark: SparkSession, target: str) -> list[str]:
    fs, folder, _ = _fs(spark, target)
    return sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("current-")) if fs.exists(folder) else []


def is_published(spark: SparkSession, target: str) -> bool:
    return bool(_pointers(spark, target))


def published(spark: SparkSession, target: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of the published version; empty with the schema where nothing is published."""
    pointers = _pointers(spark, target)
    if not pointers:
        if schema is None:
            raise FileNotFoundError(target)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{spark.read.json(f'{target}/{pointers[-1]}').first()['version']}/{name}")


def route(files: DataFrame, verdicts: DataFrame, target: str, run: str) -> None:
    """Packages (file, content) and their verdicts (file, status, ...) below target, by status.

    Each run has its own folder, so a run that is repeated replaces its rows.
    """
    verdicts.write.mode("overwrite").partitionBy("status").json(f"{target}/verdicts/run={run}")
    files.join(verdicts.select("file", "status"), "file").write.mode("overwrite").partitionBy("status").parquet(f"{target}/packages/run={run}")


def state_file(state: DataFrame, target: str) -> None:
    """All rows as one JSON file; a state has few rows by nature."""
    state.coalesce(1).write.mode("overwrite").json(target)


def write_files(rows: DataFrame, target: str) -> None:
    """One file below target, which all executors must reach, for each row (name, content).

    A file appears by a rename when it is whole, so a task that runs again
    replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = f"{root}/{name}"
                own.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with own.open_output_stream(f"{path}.part", compression=None) as out:
                    out.write(content.as_buffer())
                own.move(f"{path}.part", path)
            yield batch.select([0])

    rows.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def corpus(rows: DataFrame, target: str) -> None:
    """A CSV with header, and the texts by subject, both rebuilt from scratch."""
    rows.write.mode("overwrite").csv(f"{target}/csv", header=True, quote='"', escape='"')
    rows.select("subject", "text").write.mode("overwrite").partitionBy("subject").text(f"{target}/by-subject")


def insert_missing(existing: DataFrame, derived: DataFrame, force: bool = False) -> DataFrame:
    """The records after inserting derived ones whose id is new; force also replaces records that are themselves derived."""
    fixed = existing.where(~F.coalesce(F.col("derived"), F.lit(False))) if force else existing
    fresh = derived.join(fixed.select("id"), "id", "left_anti")
    kept = existing.join(fresh.select("id"), "id", "left_anti") if force else existing
    return kept.unionByName(fresh, allowMissingColumns=True)
