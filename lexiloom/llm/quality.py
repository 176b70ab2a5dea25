"""Quality rules with adaptive thresholds from mergeable quantile sketches.

1. ``measure`` computes each text's counts inside Arrow functions.
2. ``sketch`` counts, per language and source, how many documents fall into
   each bucket of a metric.  Buckets keep the top bits of an integer value
   (relative error at most 1/16), so counts of any parts of the data add up
   to the sketch of the whole, in any order: partial aggregation merges them.
3. ``thresholds`` shrinks each language's sketch towards that of all documents
   and each (language, source) sketch towards its language's: ``PRIOR``
   documents spread like the parent's are added, so a large group speaks for
   itself and a small one mostly for its parent, without a switch between them.
   Quantiles of the shrunk sketch give the group's fences.
4. ``apply_rules`` joins the fences and rejects what lies beyond them.

Repeated lines and words are rejected beyond the group's quantile 0.99.  Symbols,
capitals and word lengths, in which junk may be a tenth of a group, are rejected
beyond ``spread`` times the distance of the quartiles from the outer one: what
most texts of a group have none of has a fence of 0 there, and a high one where
it is usual.  Short texts get a ``slack``: that many symbols, lines or words are
not counted against the fence.  Capitals and word lengths have a least distance
instead (``tolerance``), since a sketch does not tell values within 1/16 apart.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words, so it
fails the base rule.  Null languages and sources are groups like any other.
Repeated rows are counted and judged each.  An empty table gives no rows, and a
group whose texts all fail the base rules has no fences and needs none.  A very
long text is measured as a whole in one task.  Columns called like the counts
are replaced; put others into a struct to keep them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_at, kept_text, small_or_shuffled
from .shingles import _SPACE, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


class Metric(NamedTuple):
    """count * scale div per is the value; its fence lies spread times the distance of quantiles 0.25 and upper beyond the latter."""

    count: str
    per: str
    scale: int
    upper: int  # percent
    spread: int
    tolerance: int
    slack: int  # of count
    both_sides: bool

    def value(self, slack: int = 0, div: str = "div") -> str:
        return f"greatest({self.count} - {slack}, 0) * {self.scale} {div} greatest({self.per}, 1)"


METRICS = {
    "symbols": Metric("n_symbols", "n_words", 1000, 75, 6, 0, 12, False),
    "dup_lines": Metric("n_dup_lines", "n_lines", 1000, 99, 0, 0, 3, False),
    "repeats": Metric("n_repeat_words", "n_words", 1000, 99, 0, 0, 50, False),
    "upper": Metric("n_upper", "n_letters", 1000, 75, 6, 30, 0, False),
    "word_length": Metric("word_chars", "n_words", 100, 75, 4, 100, 0, True),
}
#: Documents of the parent's sketch that a group's sketch is shrunk by.
PRIOR = 50


def measure_text(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[0])
    word_chars = int(np.count_nonzero(inside & ((raw & 0xC0) != 0x80)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n_words >= 3:
        h = word_hashes(text, lower=False)
        w = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            hit = np.zeros(len(w), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            cover = np.zeros(len(h), bool)
            cover[:-2] |= hit
            cover[1:-1] |= hit
            cover[2:] |= hit
            repeat = int(np.count_nonzero(cover))
    return (n_words, word_chars, int(np.count_nonzero(_SYMBOL[raw])), dup, repeat, len(lines), int(np.count_nonzero(_UPPER[raw])), int(np.count_nonzero(_LETTER[raw])))


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and COUNTS, all long; text may be a field of a kept column (column.field)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    sent, at = kept_text(keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                found = np.array([measure_text(t.as_py()) for t in column_at(part, at)], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], [*keep, *COUNTS])

    return docs.select(*sent).mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket: the value's five highest bits."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, bucket, n: the quantile sketches of all groups.

    Documents that fail the base rule are no measure of what is usual.
    """
    values = [F.struct(F.lit(k).alias("metric"), F.expr(m.value()).cast("long").alias("value")) for k, m in METRICS.items()]
    long = measured.where(~base_failed()).select(*by, F.explode(F.array(*values)).alias("m"))
    return long.groupBy(*by, F.col("m.metric").alias("metric"), bucket(F.col("m.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def shrunk(own: DataFrame, parent: DataFrame, by: list[str], above: list[str]) -> DataFrame:
    """by, metric, bucket, n in thousandths of documents: own counts and PRIOR documents spread like the parent's."""
    whole = parent.groupBy(*above, "metric").agg(F.sum("n").alias("whole"))
    keyed = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    share = parent.alias("p").join(whole.alias("w"), keyed("p", "w", [*above, "metric"])).select("p.*", F.expr(f"p.n * {1000 * PRIOR} div w.whole").alias("prior"))
    groups = own.select(*by, "metric").distinct()
    every = groups.alias("g").join(share.alias("s"), keyed("g", "s", [*above, "metric"])).select("g.*", "s.bucket", "s.prior")
    met = every.alias("e").join(own.alias("o"), keyed("e", "o", [*by, "metric", "bucket"]), "left")
    return met.select("e.*", (F.coalesce("o.n", F.lit(0)) * 1000 + F.col("e.prior")).alias("n")).drop("prior")


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, low, high.  A sketch has few buckets, so its quantiles come from one small array."""
    packed = sketches.groupBy(*by, "metric").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("whole"))

    def quantile(percent: Column) -> Column:
        enough = lambda seen: seen * 100 >= F.col("whole") * percent
        step = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["at"] < 0) & enough(a["seen"] + x["n"]), x["bucket"]).otherwise(a["at"]).alias("at")))
        return step["at"]

    of = lambda field: F.create_map(*[F.lit(x) for name, m in METRICS.items() for x in (name, getattr(m, field))])[F.col("metric")]
    quantiles = packed.select(*by, "metric", quantile(F.lit(25)).alias("lo"), quantile(of("upper")).alias("hi"))
    reach = F.greatest(of("spread") * (F.col("hi") - F.col("lo")), of("tolerance"))
    return quantiles.select(*by, "metric", F.when(of("both_sides"), F.col("lo") - reach).alias("low"), (F.col("hi") + reach).alias("high"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and the columns min_ and max_ of every metric, for every group."""
    by_lang = merge(sketches, ["lang"])
    lang = shrunk(by_lang, merge(by_lang, []), ["lang"], [])
    own = fences(shrunk(sketches, lang, ["lang", "source"], ["lang"]), ["lang", "source"])
    one = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c)))
    return own.groupBy("lang", "source").agg(*[one(k, c).alias(f"{name}_{k}") for k in METRICS for name, c in (("min", "low"), ("max", "high"))])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed, rejected_by (array of metric names) and kept.

    The limits, which should be stored, have a row for each group; they are
    broadcast while they are counted to be few, else Spark splits the
    partitions of a group that holds much of the rows.
    """
    names = [f"{side}_{k}" for k in METRICS for side in ("min", "max")]
    joined = measured.alias("d").join(small_or_shuffled(limits).alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left").select("d.*", *[F.col(f"t.{c}") for c in names])
    beyond = lambda k, m: (F.expr(m.value(m.slack)) > F.col(f"max_{k}")) | F.coalesce(F.expr(m.value()) < F.col(f"min_{k}"), F.lit(False))
    over = F.array_compact(F.array(*[F.when(beyond(k, m), F.lit(k)) for k, m in METRICS.items()]))
    return joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", over).drop(*names).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
