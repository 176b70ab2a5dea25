"""Corpus cleaning and its quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.numbers import let
from lexiloom.functions.text import quality_flags, text_lines, word_count

REPEATS, SHORT, TOC_WORDS, TOC_LINES = 4, 60, 8, 30


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = REPEATS) -> DataFrame:
    """key, line, n of the lines that a document repeats at least so often."""
    lines = docs.select(key, F.explode(text_lines(F.col(text))).alias("line"))
    return lines.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clean_text(text: Column) -> Column:
    """Without blank lines, bare page numbers, short lines repeated four times and a leading table of contents.

    A line is frequent if, among the sorted lines, it equals the line three
    places before it, so counting takes one sort.
    """
    same = lambda r: F.array_distinct(F.array_compact(F.transform(r, lambda x, i: F.when((i >= REPEATS - 1) & (x == F.try_element_at(r, F.greatest(i - REPEATS + 2, F.lit(1)))), x))))

    def kept(ls: Column) -> Column:
        return let(let(F.sort_array(ls), same), lambda often: F.filter(ls, lambda x: ~F.rlike(x, F.lit(r"\A\d{1,4}\z")) & ~((F.length(x) < SHORT) & F.array_contains(often, x))))

    def body(k: Column) -> Column:
        head = F.transform(F.slice(k, 1, TOC_LINES), lambda x: F.size(F.split(x, r"[\t\n\f\r ]+")) >= TOC_WORDS)
        first = F.array_position(head, F.lit(True)).cast("int")
        return F.array_join(F.slice(k, F.greatest(first, F.lit(1)), F.greatest(F.size(k), F.lit(1))), "\n")

    return let(let(text_lines(text), kept), body)


def corpus_stats(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, files, words, avg_words (whole number), flagged."""
    made = docs.select(*by, word_count(F.col(text)).alias("_w"), (F.size(quality_flags(F.col(text))) > 0).alias("_f"))
    return made.groupBy(*by).agg(F.count("*").alias("files"), F.sum("_w").alias("words"), F.floor(F.sum("_w") / F.count("*")).alias("avg_words"), F.count_if("_f").alias("flagged"))


def cross_checks(files: DataFrame, rows: DataFrame, index_meta: DataFrame, key: str = "book") -> DataFrame:
    """check, ok: the counts of files, corpus rows and indexed documents agree, and no book is missing from the rows."""
    n = files.agg(F.count("*").alias("files")).crossJoin(rows.agg(F.count("*").alias("rows"))).crossJoin(index_meta.select("doc_count"))
    missing = files.join(rows.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("missing"))
    return n.crossJoin(missing).select(F.explode(F.array(F.struct(F.lit("files_rows").alias("check"), (F.col("files") == F.col("rows")).alias("ok")), F.struct(F.lit("rows_index").alias("check"), (F.col("rows") == F.col("doc_count")).alias("ok")), F.struct(F.lit("books_present").alias("check"), (F.col("missing") == 0).alias("ok")))).alias("c")).select("c.*")
