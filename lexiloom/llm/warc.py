"""WARC fixity audit with Merkle trees.

``lay_out`` deals pages to archive files and ``archives`` writes each file's
records one after another, as WARC/1.0 bytes.  ``read_archives`` walks such
bytes: plain files record by record, .gz files member by member.  ``facts``
gives each record's place, size and digest.  ``tree`` hashes the records of a
replica: level 0 has one SHA-256 per ordered range of ``leaf`` bytes of
offsets, each next level one hash per ``fanout`` ranges, up to one root per
file.  ``audit`` compares the roots of two replicas and goes down only below
branches that differ; ranges of level 0 that differ are compared record by
record, which tells changed, missing, extra, moved and broken records.

Damage is data here: what cannot be read as a record (junk between records, a
bad header or length, a truncated file or gzip member) becomes a row with
``error``, and reading goes on at the next record or member.  A null url or
html is written as an empty one.  Files with no counterpart differ at the
root.  Repeated pages are records of their own.  Pages without an id, and ids
that repeat more often than a file holds, are dealt to several files.  Empty
replicas give no differences.  Other columns pass no further.

A file's bytes are one row, as WARC files are cut to about a gigabyte when they
are written; Spark's reader refuses files over 2 GB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_or_shuffled, stored

#: Bytes of offsets under one leaf, and ranges under one node.
LEAF, FANOUT = 64 << 10, 8
#: Bytes of a gzip member that are read first.
STEP = 8 << 10


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.0 response record with its closing blank lines."""
    payload = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(payload, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))


def lay_out(pages: DataFrame, per_file: int = 100) -> DataFrame:
    """file, page_id, url, html: pages dealt to files by ranges of per_file ids.

    What one range holds beyond twice per_file is spread over files of its own.
    """
    named = pages.select(F.coalesce(F.expr(f"page_id div {int(per_file)}").cast("string"), F.lit("none")).alias("range"), "page_id", "url", "html")
    full = stored(named.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > 2 * per_file).select("range", F.ceil(F.col("n") / per_file).alias("parts")))
    whole = F.concat(F.lit("pages-"), "range", F.lit(".warc"))
    if full.isEmpty():
        return named.select(whole.alias("file"), "page_id", "url", "html")
    joined = named.withColumn("row", F.monotonically_increasing_id()).join(small_or_shuffled(full), "range", "left")
    part = F.concat(F.lit("pages-"), "range", F.lit("-"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("string"), F.lit(".warc"))
    return stored(joined.select(F.when(F.col("parts").isNull(), whole).otherwise(part).alias("file"), "page_id", "url", "html"))  # so that a page stays where it was dealt


def archives(records: DataFrame) -> DataFrame:
    """file, content of the records (file, page_id, record): those of a file by id, then by digest."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        order = sorted((-1 if pd.isna(i) else int(i), hashlib.sha256(r).digest(), r) for i, r in zip(group["page_id"], group["record"], strict=True))
        return pd.DataFrame({"file": [group["file"].iloc[0]], "content": [b"".join(x[2] for x in order)]})

    return records.select("file", "page_id", "record").groupBy("file").applyInPandas(one, "file string, content binary")


def write_warc(files: DataFrame, folder: str, compress: bool = False) -> None:
    """Writes archives (file, content) below folder, which all executors must reach; with compress as .gz, one member a record.

    A file appears by a rename when it is whole, so a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, root = fs.FileSystem.from_uri(folder)
        own.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}{'.gz' if compress else ''}"
                with own.open_output_stream(f"{path}.part", compression=None) as out:
                    out.write(b"".join(_member(r[-1]) for r in parse(content)) if compress else content)
                own.move(f"{path}.part", path)
            yield batch.select([0])

    files.select("file", "content").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


Found = tuple[int, int, str | None, str | None, str | None, str | None, bytes]


def parse(data: bytes) -> Iterator[Found]:
    """(start, size, type, id, uri, error, bytes) of the records of plain bytes, and of the stretches that are none."""
    at = 0
    while at < len(data):
        following = data.find(b"WARC/1.", at + 1)
        nxt = len(data) if following < 0 else following
        error, stop, fields = "no record starts here", nxt, {}
        if data.startswith(b"WARC/1.", at):
            end = data.find(b"\r\n\r\n", at)
            lines = data[at:end].split(b"\r\n")[1:] if end >= 0 else []
            fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}
            length = fields.get(b"content-length", "")
            if end < 0 or not (length.isascii() and length.isdigit()):
                error = "bad header"
            elif not data.startswith(b"\r\n\r\n", end + 4 + int(length)):
                error = "truncated" if end + 8 + int(length) > len(data) else "bad length"
            else:
                error, stop = None, end + 8 + int(length)
        yield at, stop - at, fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), error, data[at:stop]
        at = stop


def parse_members(data: bytes) -> Iterator[Found]:
    """The same for gzip bytes, one member in memory at a time; offsets are those of the plain bytes.

    A member is fed in blocks that grow, so that what is read beyond its end is
    little, however many members or bytes the file has.
    """
    view, at, plain = memoryview(data), 0, 0
    while at < len(data):
        reader, parts, error, place, step = zlib.decompressobj(wbits=31), [], None, at, STEP
        try:
            while place < len(data) and not reader.eof:
                parts.append(reader.decompress(view[place : place + step]))
                place, step = min(len(data), place + step), min(2 * step, 64 * STEP)
            error = None if reader.eof else "truncated member"
        except zlib.error:
            error, parts = "bad member", []
        out = b"".join(parts)
        if error:
            nxt = data.find(b"\x1f\x8b\x08", at + 1)
            yield plain, len(out), None, None, None, error, out
        else:
            nxt = place - len(reader.unused_data)
            for start, *rest in parse(out):
                yield plain + start, *rest
        plain += len(out)
        at = len(data) if nxt < 0 else nxt


def read_archives(files: DataFrame) -> DataFrame:
    """file, ordinal, start, size, type, id, uri, error, record of archives (file, content)."""
    names = ["file", "ordinal", "start", "size", "type", "id", "uri", "error", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name, rows, held = name.as_py(), [], 0
                data = content.as_py()
                for n, found in enumerate(parse_members(data) if name.endswith(".gz") else parse(data)):
                    rows.append((name, n, *found))
                    held += found[1]
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("file", "content").mapInArrow(run, "file string, ordinal long, start long, size long, type string, id string, uri string, error string, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all .warc and .warc.gz files below path; see ``read_archives``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return read_archives(files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def facts(read: DataFrame) -> DataFrame:
    """file, page_id, id, start, size, digest, error of the records that were read; a broken stretch has no id."""
    page = F.regexp_extract("id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read.select("file", page.alias("page_id"), F.when(F.col("error").isNull(), F.col("id")).alias("id"), "start", "size", F.sha2("record", 256).alias("digest"), "error")


def tree(replica: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """level, file, node, digest: the Merkle nodes of all files of a replica.

    A leaf covers the records that start in its range of offsets; its hash
    goes over their offsets, sizes and digests in order.  All files have as
    many levels as the longest needs.
    """
    part = F.concat_ws(":", "start", "size", "digest")
    level = stored(replica.groupBy("file", F.floor(F.col("start") / leaf).cast("long").alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest", part.alias("part")))), lambda x: x["part"]), "\n"), 256).alias("digest")))
    levels = [level.withColumn("level", F.lit(0))]
    top = level.agg(F.max("node")).first()[0] or 0
    while top > 0:
        joined = F.concat_ws(":", "node", "digest")
        level = stored(level.withColumn("p", joined).groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "p"))), lambda x: x["p"]), "\n"), 256).alias("digest")).select("file", F.col("up").alias("node"), "digest"))
        levels.append(level.withColumn("level", F.lit(len(levels))))
        top //= fanout
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return stored(out.select("level", "file", "node", "digest"))


def differing(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, node of the leaves that differ, found from the roots downwards."""
    highest = max(a.agg(F.max("level")).first()[0] or 0, b.agg(F.max("level")).first()[0] or 0)
    below = None
    for level in range(highest, -1, -1):
        x, y = a.where(F.col("level") == level).select("file", "node", "digest"), b.where(F.col("level") == level).select("file", "node", "digest")
        if below is not None:
            x = x.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(below, ["file", "up"], "left_semi")
            y = y.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(below, ["file", "up"], "left_semi")
        met = x.alias("x").join(y.alias("y"), ["file", "node"], "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
        found = stored(met.select("file", "node"))
        below = found.withColumnRenamed("node", "up")
    return found


def audit(left: DataFrame, right: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """page_id, file, kind, left_start, right_start of every record that differs between the replicas' facts.

    kind: changed (same id, other bytes), moved (same bytes, other offset),
    missing (only left), extra (only right) or broken (no record, on any side).
    """
    found = differing(tree(left, leaf, fanout), tree(right, leaf, fanout), fanout)
    cut = lambda r: r.withColumn("node", F.floor(F.col("start") / leaf).cast("long")).join(found, ["file", "node"], "left_semi")
    copy = W.partitionBy("file", "id").orderBy("start")  # the records of one file
    x = cut(left).withColumn("copy", F.row_number().over(copy)).alias("x")
    y = cut(right).withColumn("copy", F.row_number().over(copy)).alias("y")
    met = x.join(y, (F.col("x.file") == F.col("y.file")) & (F.col("x.id") == F.col("y.id")) & (F.col("x.copy") == F.col("y.copy")), "full_outer")
    kind = (
        F.when(F.col("x.error").isNotNull() | F.col("y.error").isNotNull(), "broken")
        .when(F.col("y.file").isNull(), "missing")
        .when(F.col("x.file").isNull(), "extra")
        .when(F.col("x.digest") != F.col("y.digest"), "changed")
        .when(F.col("x.start") != F.col("y.start"), "moved")
    )
    return met.select(F.coalesce("x.page_id", "y.page_id").alias("page_id"), F.coalesce("x.file", "y.file").alias("file"), kind.alias("kind"), F.col("x.start").alias("left_start"), F.col("y.start").alias("right_start")).where("kind is not null")
