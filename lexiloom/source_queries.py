"""Registered queries of file sources: given tables are written in a source's format and read back, with DuckDB SQL for the same results."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.more_queries import _md5, sql_q
from lexiloom.queries import register, sql_words, table
from lexiloom.session import shared_folder
from lexiloom.sources import files as sources
from lexiloom.sources import sinks


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/lexiloom/{kind}-{uuid.uuid4().hex}"


def zipped(files: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def shelf(group: pd.DataFrame) -> pd.DataFrame:
    """A zip of the group's documents, each an EPUB file of two pages, the second of which ends it; ids divisible by 50 are broken files."""
    books = {}
    for i, text in sorted(zip(group["doc_id"], group["page"], strict=True)):
        book = zipped({"b.xhtml": "<html><style>p {}</style><p>The end</p></html>", "a.xhtml": f"<html><p>{text}</p></html>"})
        books[f"doc_{i}.epub"] = b"no zip" if i % 50 == 0 else book
    return pd.DataFrame({"name": [f"Shelf {group['shelf'].iloc[0]}.zip"], "content": [zipped(books)]})


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> '')"


@register(rf"""WITH b AS (SELECT doc_id, array_to_string(list_concat({_LINES}, ['The end']), chr(10)) AS t FROM documents WHERE doc_id % 50 <> 0)
SELECT 'shelf-' || (doc_id // 100) AS book, 'doc_' || doc_id || '.epub' AS inner_name, doc_id % 1000 AS chapter, md5(t) AS text_md5 FROM b WHERE len({sql_words("t")}) >= 80""")
def archive_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as EPUB files in archives of a hundred, some of them broken, read by ranges of entries."""
    escaped = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;")
    docs = table(spark, sf_dir, "documents").select("doc_id", escaped.alias("page"), F.expr("doc_id div 100").alias("shelf"))
    target = _folder(spark, "shelves")
    sinks.write_files(docs.groupBy("shelf").applyInPandas(shelf, "name string, content binary"), target)
    found = sources.book_archives(spark, target, partition_bytes=1 << 20)
    number = F.regexp_extract("inner", r"(\d+)", 1).cast("long") % 1000
    return found.select("book", F.col("inner").alias("inner_name"), number.alias("chapter"), _md5(F.col("text")).alias("text_md5"))


@register("SELECT s_suppkey AS supplier, s_name AS topic, s_acctbal AS balance FROM supplier WHERE s_suppkey % 10 <> 0")
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records of one JSON file each, among them broken ones and an index file, which are skipped."""
    rows = table(spark, sf_dir, "supplier")
    record = F.to_json(F.struct(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("topic"), F.col("s_acctbal").alias("balance")), {"pretty": "true"})
    content = F.when(F.col("s_suppkey") % 10 == 0, F.left(record, F.lit(20))).otherwise(record)
    made = rows.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), content.cast("binary").alias("content"))
    index = rows.limit(1).select(F.lit("index.json").alias("name"), F.lit('{"supplier": 1}').cast("binary").alias("content"))
    target = _folder(spark, "history")
    sinks.write_files(made.union(index), target)
    found = sources.json_records(spark, target, "supplier long, topic string, balance double")
    return found.where("file_modification_time is not null").select("supplier", "topic", "balance")


@register("SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.txt' AS file, md5(s_name || chr(10) || s_nationkey) AS text_md5 FROM supplier")
def text_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as text files in folders by nation, beside files of another kind, found by walking the tree."""
    nation, key = (F.col(c).cast("string") for c in ("s_nationkey", "s_suppkey"))
    name = F.concat(F.lit("n"), nation, F.lit("/s"), key)
    rows = table(spark, sf_dir, "supplier").select(name.alias("name"), F.concat_ws("\n", "s_name", nation).cast("binary").alias("content"))
    target = _folder(spark, "tree")
    sinks.write_files(rows.withColumn("name", F.concat("name", F.lit(".txt"))).union(rows.withColumn("name", F.concat("name", F.lit(".md")))), target)
    found = sources.text_tree(spark, target)
    return found.select(F.regexp_extract("path", r"(n\d+/s\d+\.txt)$", 1).alias("file"), _md5(F.col("text")).alias("text_md5"))


_SUBJECTS = {"BUILDING": "Construction", "MACHINERY": "Machines", "FURNITURE": "Homes"}


@register(f"""WITH l AS (SELECT c_custkey, c_mktsegment, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 13 <> 0)
SELECT pos, c_custkey::VARCHAR AS number, CASE c_mktsegment {" ".join(f"WHEN {sql_q(k)} THEN {sql_q(v)}" for k, v in _SUBJECTS.items())} ELSE 'Auto-detect' END AS subject, c_name || ', "first"' AS topic FROM l WHERE pos BETWEEN 10 AND 99999""")
def numbered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a numbered topic list in one file, with a byte order mark, quotes and rows without a number, from row 10 on."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    number = F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    line = F.concat_ws(",", number, "c_mktsegment", quoted(F.concat("c_name", F.lit(', "first"'))))
    listed = table(spark, sf_dir, "customer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\r\n").alias("lines"))  # a topic list is one small file
    target = _folder(spark, "numbered")
    sinks.write_files(listed.select(F.lit("list.csv").alias("name"), F.concat(F.lit("\ufeffS.No.,Subject,Topic\r\n"), "lines").cast("binary").alias("content")), target)
    return sources.numbered_topics(spark, f"{target}/list.csv", 10, 99990, _SUBJECTS)


@register("SELECT o_orderstatus AS status, count(*) AS n, max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders GROUP BY o_orderstatus")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all orders by status, written as one JSON file and read back."""
    state = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("latest"))
    target = _folder(spark, "state")
    sinks.state_file(state, target)
    return spark.read.schema("status string, n long, latest string").json(target)
