"""File sources of the data model."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import chapter_number, slugify_unicode
from lexiloom.session import ship_code


def csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Quoted CSV with a header; doubled quotes, a byte order mark and short or long rows are handled (dropped)."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line, mode="DROPMALFORMED", enforceSchema=False)
    return raw.select(*[F.col(f"`{c}`").alias(re.sub("^\ufeff", "", c).strip()) for c in raw.columns])


def topic_bank(spark: SparkSession, path: str) -> DataFrame:
    """subject, topic of a topic list with one record per line; no rows without those columns."""
    raw = csv_rows(spark, path, multi_line=False)
    names = {c.lower(): c for c in raw.columns}
    if "subject" not in names or "topic" not in names:
        return spark.createDataFrame([], "subject string, topic string")
    return raw.select(F.trim(F.col(f"`{names['subject']}`")).alias("subject"), F.trim(F.col(f"`{names['topic']}`")).alias("topic")).where("topic <> ''")


def numbered_topics(spark: SparkSession, path: str, start: int = 0, limit: int | None = None, subjects: dict[str, str] | None = None, default: str = "Auto-detect") -> DataFrame:
    """pos, number, subject, topic of rows start to start + limit of a topic list, in file order.

    subjects decodes the list's labels; rows with a blank number are skipped.
    Positions are those in the array of one file's lines; a topic list is small.
    """
    lines = F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")
    row = lambda x: F.from_csv(x, F.lit("a string, b string, c string"), {"quote": '"', "escape": '"'})
    rows = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.when(F.trim(x) != "", row(x)))
    good = F.filter(rows, lambda r: r["c"].isNotNull() & (F.trim(F.coalesce(r["a"], F.lit(""))) != ""))
    placed = spark.read.text(path, wholetext=True).select(F.posexplode(good).alias("pos", "r"))
    decoded = F.col("r.b") if subjects is None else F.coalesce(F.create_map(*[F.lit(x) for kv in subjects.items() for x in kv])[F.trim("r.b")], F.lit(default))
    kept = placed.where(F.col("pos") >= start) if limit is None else placed.where(F.col("pos").between(start, start + limit - 1))
    return kept.select("pos", F.trim("r.a").alias("number"), decoded.alias("subject"), F.trim("r.c").alias("topic"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per file; broken files and index.json are skipped, a missing folder is empty.  Adds file_name and file_modification_time."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED", pathGlobFilter="*.json")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, file_name string, file_modification_time timestamp")
    return raw.select("*", "_metadata.file_name", "_metadata.file_modification_time").where("file_name <> 'index.json'")


def by_manifest(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records that a manifest (slug) lists."""
    wanted = manifest.select(F.concat("slug", F.lit(".json")).alias("file_name"))
    return records.join(wanted, "file_name", "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """slug of a JSON array of names."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("slug")).where("slug is not null")


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, text of all .txt files below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "h1", "h2", "h3", "li", "tr"):
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data: str) -> None:
        if self.hidden <= 0:
            self.parts.append(data)


def plain_text(html: str) -> str:
    parser = _Plain()
    parser.feed(html)
    return "\n".join(line for line in (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parser.parts).split("\n")) if line)


def zip_entries(spark: SparkSession, path: str, suffix: str = "", partition_bytes: int = 64 << 20) -> DataFrame:
    """archive, entry, number, content, error of the entries of all .zip files below path, read by ranges of entries."""
    from pyspark import cloudpickle

    from lexiloom.sources import archives

    cloudpickle.register_pickle_by_value(archives)  # the planner's process need not have this library
    spark.dataSource.register(archives.ArchiveSource)
    return spark.read.format("zip_entries").option("path", path).option("suffix", suffix).option("partitionBytes", str(partition_bytes)).load()


def book_archives(spark: SparkSession, path: str, least_words: int = 80, partition_bytes: int = 64 << 20) -> DataFrame:
    """book, inner, chapter, text of zip archives of EPUB files; chapters under least_words are left out, broken ones too.

    An EPUB file is read by one task, an archive by as many as its size asks for.
    """
    ship_code(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, inner, content in zip(batch["archive"], batch["entry"], batch["content"], strict=True):
                try:
                    book = zipfile.ZipFile(io.BytesIO(content))
                    pages = sorted(n for n in book.namelist() if n.lower().endswith((".html", ".xhtml", ".htm")))
                    text = "\n".join(plain_text(book.read(n).decode("utf-8", "replace")) for n in pages)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    continue
                if len(text.split()) >= least_words:
                    rows.append((re.sub(r"(?i)\.zip$", "", name), inner, text))
            yield pd.DataFrame(rows, columns=["archive", "inner", "text"])

    whole = zip_entries(spark, path, ".epub", partition_bytes).where("error is null").select("archive", "entry", "content")
    found = whole.mapInPandas(run, "archive string, inner string, text string")
    return found.select(slugify_unicode(F.col("archive")).alias("book"), "inner", chapter_number(F.col("inner")).alias("chapter"), "text")


def report_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The rows of a paged search report, as a table or as a stream that goes on where it ended (see ``reports``)."""
    from pyspark import cloudpickle

    from lexiloom.sources import reports

    cloudpickle.register_pickle_by_value(reports)
    spark.dataSource.register(reports.ReportSource)
    return (spark.readStream if stream else spark.read).format("search_report_pages").option("path", path).load()


def search_window(today: Column, lookback: int = 28, lag: int = 3) -> Column:
    """struct(start, end) of a search report as ISO days, which lags some days behind."""
    day = lambda n: F.date_format(F.date_sub(today, n), "yyyy-MM-dd")
    return F.struct(day(lookback + lag).alias("start"), day(lag).alias("end"))


def search_rows(spark: SparkSession, path: str) -> DataFrame:
    """query, clicks, impressions, ctr, position of a landed search report."""
    raw = spark.read.schema("keys array<string>, clicks double, impressions double, ctr double, position double").json(path)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return raw.select(F.try_element_at("keys", F.lit(1)).alias("query"), zero("clicks").alias("clicks"), zero("impressions").alias("impressions"), F.round(zero("ctr"), 4).alias("ctr"), F.round(zero("position"), 1).alias("position"))
