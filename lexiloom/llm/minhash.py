"""Near-duplicates by MinHash bands, screened by odd sketches and confirmed on full sets.

Texts are sets of distinct word shingles (see ``shingles``); two link when
``100 * |A & B| >= percent * |A | B|``.  Equal sets form one class, and all but
the first and the last step work on classes.

1. *Samples.*  ``BANDS * ROWS`` hash functions each keep the least value of a
   set; two sets agree on a sample with the probability of their similarity.
2. *Odd sketches.*  The pairs (function, sample) of a set are folded into a
   bitmap: a bit says whether an odd number of them fall on it.  The XOR of two
   bitmaps is the odd sketch of the symmetric difference of the samples, so its
   population count estimates, most precisely where sets are alike, how many
   samples differ.  A second, wider bitmap folds the shingles themselves: its
   count is never above the number of shingles in which two sets differ, which
   for sets up to some thousand shingles is the sharper screen.
3. *Bands.*  ``ROWS`` samples make a band's key.  Sets linked at the limit of
   0.8 miss each other in all bands with a probability of 1.3e-7, and more
   similar ones with a smaller one.  Keys of one class only are dropped; lists
   of longer keys are cut into blocks of about ``LIST`` classes.
4. *First links.*  Within the blocks of a list, each class meets its neighbour by
   size, the block's least class and some that are drawn, blocks meet by their least ones, and of
   those whose sketches are near enough a class keeps the least and the few
   nearest.  Links that are confirmed on the full sets give components, so a
   group of copies costs a few pairs a class, not all pairs.
5. *Remaining links.*  Pairs of a list whose components differ, block by block,
   if their sketches are near enough, are confirmed on the full sets too.  The
   sketch's limit lies ``DEVIATIONS`` standard deviations beyond what a pair at
   the limit of similarity shows, a loss of some 1e-10; no list is capped.

Null texts and texts without words have the empty set and link with nothing.
Very long texts are one row of their shingles (8 bytes each).  Rows without a
doc_id take part, but never name a component while one with an id is in it;
where none is, component_id is null and the rows are kept.  Repeated rows are
copies; rows that repeat the least doc_id are all kept.  An empty table gives no
rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import discard, in_tasks, small_or_shuffled, stored
from .components import components
from .shingles import mix, shingle_set

#: Bands, samples of a band, and 64-bit words of the odd sketch of samples and of that of shingles.
BANDS, ROWS, WORDS, WIDE = 40, 5, 8, 16
#: Classes of a block of a list, roughly.
LIST = 1024
#: Neighbours of a class that are confirmed first; with fewer, a group of near copies falls into many components.
NEAREST = 4
#: Classes drawn from each block that all others of the block meet, besides the least one.
HUBS = 3
#: Standard deviations by which the population count may exceed its mean at the limit of similarity.
DEVIATIONS = 6.5

_random = np.random.default_rng(13)
_A = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_SALT = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SAMPLED, _FOLDED = [f"b{w}" for w in range(WORDS)], [f"f{w}" for w in range(WIDE)]
_SKETCH = [*_SAMPLED, *_FOLDED]


def samples(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    value = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + column)
    return value.view(np.int64)


def parities(spots: np.ndarray, words: int) -> np.ndarray:
    """64-bit words whose bits say whether an odd number of the 64-bit values fall on them."""
    counts = np.bincount((spots % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The odd sketch of samples, WORDS words."""
    return parities(mix(least.astype(np.uint64) ^ _SALT), WORDS)


def estimate(apart: float) -> float:
    """The similarity that a population count of the XOR of two sketches suggests."""
    bits = 64 * WORDS
    return 1 + bits / (4 * BANDS * ROWS) * math.log(max(1 - 2 * apart / bits, 1e-9))


def most_apart(percent: int) -> int:
    """The population count beyond which a pair that links is out of the question."""
    bits, k, miss = 64 * WORDS, BANDS * ROWS, 1 - percent / 100
    balls = 2 * k * miss  # a sample that differs puts one value of each side into the sketch
    keeps = math.exp(-2 * balls / bits)
    within = bits / 4 * (1 - keeps**2) - balls * keeps**2
    variance = within + (2 * keeps) ** 2 * k * miss * (1 - miss)
    return math.ceil(bits / 2 * (1 - keeps) + DEVIATIONS * math.sqrt(variance))


def sketched(docs: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """keep, n_shingles, class_key (16 bytes; null for the empty set), bands and the words of the odd sketch."""
    own = [("n_shingles", T.LongType()), ("class_key", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), *((b, T.LongType()) for b in _SKETCH)]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, words, known = [], [], [], [], {}
            for t in batch.column(len(keep)):
                found = shingle_set(t.as_py(), width)
                n.append(len(found))
                if not len(found):
                    keys.append(None)
                    bands.append(None)
                    words.append([None] * len(_SKETCH))
                    continue
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                if key not in known:  # copies of a batch are sampled once
                    least = samples(found)
                    known[key] = (band_keys(least), [*odd_sketch(least).tolist(), *parities(found, WIDE).tolist()])
                keys.append(key)
                bands.append(known[key][0])
                words.append(known[key][1])
            columns = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array([w[k] for w in words], pa.int64()) for k in range(len(_SKETCH)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], schema.names)

    return in_tasks(docs.select(*keep, "text"), run, schema)


def full_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """class, keys: the full sets of the wanted classes (class_key, class), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[bytes, np.ndarray] = {}
            for t in batch.column(0):
                found = shingle_set(t.as_py(), width)
                if len(found):
                    made.setdefault(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.list_(pa.int64()))], ["class_key", "keys"])

    sets = in_tasks(docs.select("text"), run, "class_key binary, keys array<long>")
    return sets.join(small_or_shuffled(wanted), "class_key").groupBy("class").agg(F.first("keys").alias("keys"))


def _apart(x: str, y: str, sketch: list[str]) -> Column:
    """The population count of the XOR of two sketches."""
    return sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in sketch), F.lit(0))


def _near_enough(x: str, y: str, percent: int) -> Column:
    """False only of pairs that do not link: by their sizes, their shingles' parities and, all but surely, their samples'."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    alike = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (_apart(x, y, _SAMPLED) <= most_apart(percent))
    return alike & (_apart(x, y, _FOLDED) * (100 + percent) <= (nx + ny) * (100 - percent))


def listed(classes: DataFrame) -> DataFrame:
    """key, block, blocks, class, n and sketch of the keys that two or more classes have."""
    rows = classes.select("class", F.explode("bands").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    met = rows.join(counts, "key").withColumn("blocks", F.ceil(F.col("many") / LIST).cast("int"))
    blocked = met.select("key", "class", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"))
    return blocked.join(classes.select("class", "n", *_SKETCH), "class")


def _first_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: of each class's near enough neighbours and hubs in its lists, the NEAREST nearest and the least."""
    entry = F.struct("n", "class", *_SKETCH)
    rows = rows.select("key", "block", entry.alias("e"))
    chain = rows.withColumn("o", F.lag("e").over(W.partitionBy("key", "block").orderBy("e.n", "e.class"))).where("o is not null").select("e", "o")
    drawn = [F.min_by("e", F.xxhash64("e.class", F.lit(k))) for k in range(HUBS)]
    hubs = rows.groupBy("key", "block").agg(F.min("e").alias("least"), F.array(F.min("e"), *drawn).alias("hubs"))
    star = rows.join(hubs, ["key", "block"]).select("e", F.explode(F.array_distinct("hubs")).alias("o")).where("e.class <> o.class")
    tops = hubs.select("key", F.col("least").alias("o")).select(F.col("o").alias("e"), F.lag("o").over(W.partitionBy("key").orderBy("o.n", "o.class")).alias("o")).where("o is not null")  # one row for LIST classes
    near = chain.union(star).union(tops).where(_near_enough("e", "o", percent)).select(F.col("e.class").alias("a"), F.col("o.class").alias("b"), F.col("o.n").alias("n"), _apart("e", "o", _FOLDED).alias("apart"))
    best = near.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("apart", "b"))).alias("nearest"), F.min(F.struct("n", "b")).alias("least"))  # a few of a list
    return best.select("a", F.explode(F.array_distinct(F.concat(F.array("least.b"), F.slice("nearest.b", 1, NEAREST)))).alias("b"))


def _other_pairs(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: all near enough pairs of a list whose components differ.

    Of each such pair one end at least lies outside the list's largest
    component; only such ends go to all blocks of their list.
    """
    known = rows.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    counts = known.groupBy("key", "label").agg(F.count("*").alias("many"))
    # a list whose classes are all in one component has nothing left to join
    mixed = counts.groupBy("key").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("key", F.col("top.label").alias("top"))
    left = stored(known.join(mixed, "key"))
    x = left.where("label <> top").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = left.alias("y")
    once = (F.col("y.label") == F.col("y.top")) | (F.col("x.class") < F.col("y.class"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.other") == F.col("y.block")) & (F.col("x.label") != F.col("y.label")) & once & _near_enough("x", "y", percent))
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs whose full sets link."""
    x = sets.select(F.col("class").alias("a"), F.col("keys").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("keys").alias("y"))
    shared = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), F.size(F.array_intersect("x", "y")).alias("c"))
    return shared.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs; kept rows have the least doc_id of their component."""
    per_doc = stored(sketched(docs, width, ["doc_id"]))
    grouped = per_doc.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), *[F.first(b).alias(b) for b in _SKETCH])
    classes = stored(grouped.withColumn("class", F.monotonically_increasing_id()))  # stored, so that a class keeps its number
    rows = stored(listed(classes))
    wanted = stored(classes.join(rows.select("class").distinct(), "class", "left_semi").select("class_key", "class"))
    sets = stored(full_sets(docs, width, wanted))
    first = stored(_confirmed(stored(_first_pairs(rows, percent)), sets, percent))
    labels = components(first)
    others = stored(_confirmed(stored(_other_pairs(rows, labels, percent)), sets, percent))
    discard(rows, sets)
    final = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(others))
    member = classes.select("class_key", "class", "least").join(final, classes["class"] == final["node"], "left").select("class_key", "least", F.coalesce("label", "class").alias("label"))
    named = member.join(member.groupBy("label").agg(F.min("least").alias("component")), "label").select("class_key", "component")
    out = per_doc.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left")
    found = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))
