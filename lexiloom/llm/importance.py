"""Importance resampling of documents towards a target distribution of n-grams.

1. *Words.*  An untrained Regex Split of the tokenizers library cuts the text,
   A-Z lower-cased, into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with their
   offsets.
2. *Features.*  Windows of one and two consecutive offset pairs are features: a
   word's bytes, or those of two words with one space between.  The unsigned
   CRC-32 of a feature, modulo ``BUCKETS``, is its bucket.  A CRC goes on where
   the one before it ended, so the second word of a pair is not copied.
3. *Histograms.*  A text is tokenised once, into its sorted buckets (2 bytes for
   each feature), which are stored; tasks add them up and send one row for each
   bucket, of the documents and of the target texts.
4. *Gains.*  gain = floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of
   each bucket, over B = BUCKETS, S and T all features of documents and targets,
   s and t those in the bucket.  The gains, B numbers, are sent to all tasks.  A
   document's weight is the floored mean of its features' gains, 0 without any.
5. *Draw.*  score = weight + floor(-1000 * ln(-ln((h + 0.5) / 2**32))), with h
   from SHA-256 of ``seed:doc_id``: Gumbel noise, so the highest scores are a
   sample without replacement in proportion to exp(weight / 1000).  Of the
   documents with ``least_words`` or more, the highest ``percent`` get a rank.

A null or empty text has no features: weight 0, and never a rank.  A null
doc_id is hashed as an empty one and sorts last among equal scores.  Ties go to
the smaller doc_id; rows that are equal in both are ranked in any order, and
each has a rank of its own.  Very long texts are cut between words into pieces
of about ``PIECE`` characters, and windows go on over the cuts; memory grows by
2 bytes a feature.  Without documents there are no rows; without target texts
all gains follow from T = 0.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_tasks, stored

#: What a word consists of, and what separates words, once A-Z are lower case.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BUCKETS = 10_000
#: Characters that are split at one time.
PIECE = 1 << 18
#: Scores of one cell of the histogram that finds the lowest score drawn.
CELL = 64
#: Rows of one range of ranks.
RANGE = 200_000


@functools.cache
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text, cut before characters that belong to no word."""
    at = 0
    while len(text) - at > size:
        found = GAP.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def buckets_of(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the sorted buckets of its features."""
    if not text:
        return 0, np.empty(0, np.uint16)
    split, crc = splitter().pre_tokenize_str, zlib.crc32
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower changes A-Z only
    found, n, before = [], 0, None
    for piece in pieces(low):
        words = [piece[a:b].encode("utf-8", "surrogatepass") for _, (a, b) in split(piece)]
        if not words:
            continue
        ones = [crc(w) for w in words]
        twos = [crc(w, crc(b" ", c)) for c, w in zip(ones, words[1:], strict=False)]
        if before is not None:
            twos.append(crc(words[0], crc(b" ", before)))
        before = ones[-1]
        n += len(words)
        found.append((np.array(ones + twos, np.uint32) % np.uint32(buckets)).astype(np.uint16))
    return n, np.sort(np.concatenate(found)) if found else np.empty(0, np.uint16)


def featured(docs: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keep, n_words, n_features and the sorted buckets of every text, as 2 bytes each."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [buckets_of(t.as_py(), buckets) for t in part.column(len(keep))]
                n, size = [m[0] for m in made], [len(m[1]) for m in made]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array([m[1].astype("<u2").tobytes() for m in made], pa.binary())], [*keep, "n_words", "n_features", "buckets"])

    return in_tasks(docs.select(*keep, "text"), run, schema)


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket; ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u2"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in in_tasks(features.select("buckets"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths of natural logarithms, floored."""
    b = float(len(source))
    ratio = (target + 1.0) * (float(source.sum()) + b) / ((source + 1.0) * (float(target.sum()) + b))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """features without their buckets, with weight."""
    names = [c for c in features.columns if c != "buckets"]
    schema = T.StructType([*(features.schema[c] for c in names), T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(len(names))]
            weight = [int(gains[x].sum()) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(weight, pa.int64())], [*names, "weight"])

    return in_tasks(features.select(*names, "buckets"), run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a hash of the id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_ranks(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored (stored) with rank: 1, 2, 3... of the highest scores among documents of enough words.

    Scores lie between bounds that do not depend on the number of documents
    (logarithms of counts, and noise of at most 32 bits), so a histogram of
    cells of them is small and says which cells hold the drawn rows.  Those are
    sorted by ranges, each range numbers its rows, and ranges are shifted by
    the sizes of those before them.
    """
    able = scored.where(F.col("n_words") >= least_words)
    cells = sorted(((r.cell, r.n) for r in able.groupBy(F.floor(F.col("score") / CELL).alias("cell")).agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = sum(n for _, n in cells) * percent // 100
    seen, lowest = 0, None
    for cell, n in cells:
        if seen >= drawn:
            break
        seen, lowest = seen + n, cell
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "row"]
    ranges = max(1, -(-seen // RANGE))
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    high = able.where(F.floor(F.col("score") / CELL) >= lowest).select("row", "score", "doc_id")
    ordered = stored(high.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("row", F.spark_partition_id().alias("range"), local.alias("place")))
    sizes = dict(ordered.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row for each RANGE rows
    starts, total = [], 0
    for r in sorted(sizes):
        starts.append((r, total))
        total += sizes[r]
    before = F.broadcast(scored.sparkSession.createDataFrame(starts, "range int, start long"))
    ranks = ordered.join(before, "range").select("row", (F.col("start") + F.col("place") + 1).alias("rank")).where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left")


def resample(docs: DataFrame, target: DataFrame, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null unless drawn) of every document; target has a text column."""
    features = stored(featured(docs, ["doc_id"]))
    gains = gains_of(histogram(features), histogram(featured(target, [])))
    scored = weighed(features, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    return with_ranks(stored(scored), least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
