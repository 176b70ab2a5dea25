"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Native: DataFrame functions only.

1. ``windows`` cuts every benchmark text into runs of ``width`` words; a
   shorter text is one window.  A window's print is a 64-bit hash of the hashes
   of its words.
2. ``find_hits`` makes the prints of all windows of every training text and
   looks them up in the set of benchmark prints, which is a broadcast hash join
   while the benchmark has at most ``broadcast_rows`` windows, else a shuffle
   join of the same plan.
3. What is found is verified: the words of the few texts with found prints are
   compared with the benchmark's windows as strings, again by a hash join.
4. ``remove`` drops hit documents, or only their hit words.

Texts are told apart by their SHA-256, so a verdict depends on the text alone
and copies share it.  The work on a text is linear in its length and in its
hits; very long texts need the memory of their words and prints.

Null texts and texts without words have no windows and no hits.  Repeated
rows are judged each.  A repeated item_id is one item.  An empty benchmark or
table hits nothing.  Other columns are ignored by ``judge`` and kept by
``remove``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.numbers import let

from .common import BROADCAST_ROWS, small_or_shuffled, stored
from .words import GAP_ANY_CASE, WORD_ANY_CASE, word_array, word_count


def _print(words: Column) -> Column:
    return F.xxhash64(F.transform(words, lambda x: F.xxhash64(x)))


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """item_id, gram (words joined by a space), size, print: distinct windows of the items."""
    words = items.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(width)))).alias("g"))
    return cut.select("item_id", F.array_join("g", " ").alias("gram"), F.size("g").alias("size"), _print(F.col("g")).alias("print")).distinct()


def text_key(text: Column) -> Column:
    """What tells texts apart; null for a null text."""
    return F.sha2(text.cast("binary"), 256)


def _prints(words: Column, sizes: list[int]) -> Column:
    """For each size, the prints of all runs of so many words, in order."""
    none = F.array().cast("array<bigint>")

    def of_size(h: Column, size: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(size))))
        return F.when(F.size(h) >= size, made).otherwise(none)

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: F.array(*[of_size(h, size) for size in sizes]))


def find_hits(docs: DataFrame, grams: DataFrame, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key (see ``text_key``), start, size, gram of every place where a window of ``grams`` stands, once for equal texts."""
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most width values
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    if not sizes:
        return texts.select("key", F.lit(0).alias("start"), F.lit(0).alias("size"), "text").toDF("key", "start", "size", "gram").limit(0)
    known = stored(grams.select("size", "print").distinct())
    # the outer forms keep Catalyst from testing the arrays' sizes, and so splitting the text, below the scan
    by_size = texts.select("key", F.posexplode_outer(_prints(word_array(F.col("text")), sizes)).alias("which", "prints"))
    each = by_size.select("key", F.element_at(F.array(*map(F.lit, sizes)), F.col("which") + 1).alias("size"), F.posexplode_outer("prints").alias("start", "print"))
    found = each.join(small_or_shuffled(known, broadcast_rows), ["size", "print"], "left_semi").select("key", "size", "start")
    spots = stored(found.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "size")).alias("spots")))  # the places in one text
    some = texts.join(small_or_shuffled(spots.select("key"), broadcast_rows), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    words = some.join(spots, "key").select("key", "spots", word_array(F.col("text")).alias("w"))
    stand = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice("w", s["start"] + 1, s["size"]), " ").alias("gram")))
    exact = words.select("key", F.explode(stand).alias("h")).select("key", "h.*")
    return exact.join(small_or_shuffled(stored(grams.select("gram", "size").distinct()), broadcast_rows), ["gram", "size"], "left_semi").select("key", "start", "size", "gram")


def passages(hits: DataFrame) -> DataFrame:
    """key, lo, hi: the runs of hit words of each text, from word lo to before hi; overlapping and touching hits are one run."""
    ends = hits.groupBy("key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    order = W.partitionBy("key").orderBy("start")  # the hits of one text
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = ends.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("key", "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).drop("run")


def items_hit(hits: DataFrame, grams: DataFrame) -> DataFrame:
    """key, items: the item_ids, as sorted strings, whose windows occur in the text."""
    ids = hits.select("key", "gram").distinct().join(grams.select("gram", F.col("item_id").cast("string").alias("item_id")), "gram").select("key", "item_id").distinct()
    return ids.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))  # at most all items


def judge(docs: DataFrame, items: DataFrame, width: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    grams = stored(windows(items, width))
    hits = stored(find_hits(docs, grams, broadcast_rows=broadcast_rows))
    n_hit = passages(hits).groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("n_hit"))
    verdicts = stored(n_hit.join(items_hit(hits, grams), "key", "left"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), word_count(F.col("text")).alias("n_words"))
    joined = rows.join(small_or_shuffled(verdicts, broadcast_rows), "key", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove(docs: DataFrame, items: DataFrame, width: int = 10, spans: bool = False, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without hit documents, or, with spans, with the hit words cut from their texts.

    A cut keeps all text outside the hit words; the hit words of one passage
    and what stands between them become one space.
    """
    hits = find_hits(docs, stored(windows(items, width)), text, broadcast_rows)
    rows = docs.select(F.struct(*docs.columns).alias("all"), text_key(F.col(text)).alias("key"))
    if not spans:
        hit = stored(hits.select("key").distinct())
        return rows.join(small_or_shuffled(hit, broadcast_rows), "key", "left_anti").select("all.*")
    runs = stored(passages(hits).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs")))
    joined = rows.join(small_or_shuffled(runs, broadcast_rows), "key", "left")
    whole = F.col(f"all.{text}")

    def cut(pieces: Column) -> Column:
        end = lambda k: F.when(k > 0, F.element_at("runs", F.greatest(k, F.lit(1)))["hi"]).otherwise(0)
        before = F.transform("runs", lambda r, k: F.concat(F.array_join(F.slice(pieces, end(k) + 1, r["lo"] - end(k)), ""), F.lit(" ")))
        last = F.element_at("runs", -1)["hi"]
        return F.concat(F.array_join(before, ""), F.array_join(F.slice(pieces, last + 1, F.size(pieces) - last), ""))

    # each word with the gap before it, and what follows the last word
    left = F.concat(let(F.regexp_extract_all(whole, F.lit(f"{GAP_ANY_CASE}*{WORD_ANY_CASE}"), F.lit(0)), cut), F.regexp_extract(whole, f"{GAP_ANY_CASE}*\\z", 0))
    kept = F.when(F.col("runs").isNotNull(), left).otherwise(whole)
    return joined.select(*[kept.alias(c) if c == text else F.col(f"all.{c}") for c in docs.columns])
