"""N-gram Jaccard self-join of whole texts, by vertical partitioning.

Texts are sets of distinct word shingles (see ``shingles``).  Two sets link
when ``100 * |A & B| >= percent * |A | B|``.  Equal sets form one class; the
join runs over classes, so copies cost nothing.

1. *Order.*  The n-gram space is cut into bins by hash.  Each bin counts how
   many classes hold each of its n-grams and passes on those that two or more
   hold.  The global order is (band of that number, hash), rarest first; one
   64-bit key holds both.  N-grams of one class only come before all others: a
   class's position of a shared n-gram is known from its set size.
2. *Fragments.*  The order is cut into ``FRAGMENTS`` contiguous ranges that
   hold about equally many (class, n-gram) tuples.  A class's keys are thus cut
   into segments, one for each fragment.
3. *Candidates.*  A linked pair shares an n-gram within the longer set's probe
   prefix and the shorter set's index prefix.  Lists of prefix n-grams are cut
   into blocks of about ``LIST`` classes, so no task holds a whole long list.
   Neighbours within a block, the block's least class and the leasts of a
   list's blocks are linked first, which joins a group of near copies by few
   pairs.
4. *Partial overlaps.*  In each fragment, segments meet and give a partial
   count; the counts are summed per pair.  Candidates whose ends lie in
   different components meet pair by pair, and the sum runs over rows of
   (pair, fragment).  Classes of one component meet in pairs of blocks, ordered
   by set size, of which only those meet whose sizes allow a link; the sum runs
   inside the task, fragment after fragment, over ``BLOCK`` by ``BLOCK`` classes.
   All links within a component are found, while a row is sent for each class
   and each block that it may link with, not for each pair.  Bounds by length,
   position and bitmap, and by the difference that the fragments so far show,
   drop pairs that cannot link; they never drop a link.
5. *Links.*  Every link between different texts is found and counted.

Widths: shingles have 64 bits, the keys of classes 128 (64 inside the join),
n-grams inside the join 56 bits and 7 bits of band.  Two n-grams of one pair
with equal 56 bits would count as one; with sets of a million n-grams that
happens to about one pair in 100,000.

Null texts and texts without words have the empty set: n_shingles 0, no
links.  Very long texts are one row of their keys (8 bytes a shingle).  Rows
with a null doc_id take part, but never name a component while a non-null id
is in it.  Repeated rows are copies, which are links too.  Ties of the order
are broken by hash.  An empty table gives no rows.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import discard, small_or_shuffled, stored
from .components import components
from .shingles import shingle_set

#: Contiguous ranges of the global order.
FRAGMENTS = 4
#: N-grams of a bin, on average, and the least number of bits of a bin's number.
BIN, LEAST_BIN_BITS = 1_000_000, 7
#: Bits by which the tasks that store shared n-grams or sets are fewer than bins; each writes a file.
FILE_BITS = 2
#: N-grams that a batch gathers before its blocks are sent.
BATCH = 125_000
#: Bits of an n-gram below its band in a key, and those sent besides the bin.
BITS, SENT = 56, 48
#: 64-bit words of a bitmap that bounds the overlap of two sets.
BITMAP = 8
#: Classes of a block of a prefix list, on average.
LIST = 512
#: Classes and shared n-grams of a block of a component, on average, which one task holds; classes that are compared at once.
SENT_BLOCK, SENT_GRAMS, BLOCK = 1024, 500_000, 64
#: Bands of set size between a size and the least one that it may link with.
SIZE_BANDS = 4


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def classes(docs: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """keep, n_shingles, class_key (16 bytes; null for the empty set)."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_shingles", T.LongType()), T.StructField("class_key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for t in batch.column(len(keep)):
                found = shingle_set(t.as_py(), width)
                n.append(len(found))
                keys.append(_digest(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(keys, pa.binary())], [*keep, "n_shingles", "class_key"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _blocks(docs: DataFrame, width: int, bin_bits: int) -> DataFrame:
    """bin, grams (6 bytes each), classes (8 bytes each) and runs (grams of each class, 4 bytes; none if a class stands there for each gram)."""

    def pack(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.fromiter(sets, np.int64, len(sets))
        sizes = np.array([len(s) for s in sets.values()])
        grams = np.concatenate(list(sets.values()))
        owner = np.repeat(np.arange(len(keys)), sizes)
        part = (grams >> np.uint64(64 - bin_bits)).astype(np.int64)
        order = np.lexsort((owner, part))
        part, owner, grams = part[order], owner[order], grams[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = owner[a:b]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            runs = np.diff(np.append(first, b - a)).astype(np.int32).tobytes()
            if 3 * len(first) > 2 * (b - a):  # many classes have one n-gram here: runs would not pay
                first, runs = np.arange(b - a), b""
            low = np.ascontiguousarray(grams[a:b]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT // 8]
            for column, x in zip(rows, (int(part[a]), low.tobytes(), keys[own[first]].tobytes(), runs), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], ["bin", "grams", "classes", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for t in batch.column(0):
                found = shingle_set(t.as_py(), width)
                if len(found):
                    key = int.from_bytes(_digest(found)[:8], "little", signed=True)
                    if key not in sets:  # a batch sends a class once
                        sets[key] = found
                        held += len(found)
                if held >= BATCH:
                    yield pack(sets)
                    sets, held = {}, 0
        if sets:
            yield pack(sets)

    return docs.select("text").mapInArrow(run, "bin int, grams binary, classes binary, runs binary")


def band(df: np.ndarray) -> np.ndarray:
    """0 to 127, growing with the number of classes: exact below 64, then four steps a doubling."""
    return np.minimum(np.where(df < 64, df, 64 + 4 * np.log2(np.maximum(df, 64) / 64)), 127).astype(np.int64)


def _most_of_band(key: Column) -> Column:
    """The most classes that an n-gram of the key's band has."""
    b = F.shiftright(key, BITS)
    return F.when(b < 64, b.cast("double")).otherwise(64 * F.pow(F.lit(2.0), (b - 63) / 4.0))


def _shared(blocks: DataFrame, bin_bits: int) -> DataFrame:
    """class, key of the n-grams that two or more classes hold; a bin is one group."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(group["grams"]), np.uint8).reshape(-1, SENT // 8)
        grams = np.zeros((len(raw), 8), np.uint8)
        grams[:, : SENT // 8] = raw
        grams = grams.view("<u8").ravel().astype(np.int64)
        owner = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(r, np.int32)) if r else np.frombuffer(c, np.int64) for c, r in zip(group["classes"], group["runs"], strict=True)])
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])  # a class may come from several batches
        grams, owner = grams[new], owner[new]
        n = np.diff(np.append(np.flatnonzero(np.diff(grams, prepend=-1)), len(grams)))
        df = np.repeat(n, n)
        many = df > 1
        whole = (np.int64(group["bin"].iloc[0]) << np.int64(SENT)) | grams[many]
        key = (band(df[many]) << np.int64(BITS)) | (whole >> np.int64(max(0, bin_bits + SENT - BITS)))
        return pd.DataFrame({"class": owner[many], "key": key})

    return blocks.repartition(1 << bin_bits, "bin").groupBy("bin").applyInPandas(one, "class long, key long")


def _cuts(shared: DataFrame) -> list[int]:
    """The keys at which fragments 1, 2, ... start; from a histogram of at most 8192 cells."""
    cells = sorted(shared.groupBy(F.shiftright("key", BITS - 6).alias("cell")).agg(F.count("*").alias("n")).collect())
    total, seen, cuts = sum(r.n for r in cells), 0, []
    for r in cells:
        if seen >= total * (len(cuts) + 1) / FRAGMENTS:
            cuts.append(r.cell << (BITS - 6))
        seen += r.n
    return cuts


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """key, class, n, many, pos, before, is_index and bitmap words of the shared n-grams within probe prefixes.

    ``before`` is the shared n-gram just before in the class's order; a pair
    with equal ones is found there already.  A bit of the bitmap says whether
    an odd number of the class's shared n-grams fall on it.
    """
    names = ["key", "class", "n", "many", "pos", "before", "is_index", *(f"b{w}" for w in range(BITMAP))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for cls, n, keys in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                keys = np.asarray(keys.values, np.int64)
                many = len(keys)
                least = n - many  # the position of the first shared n-gram
                probe = min(many, int(n + (percent * n // -100)) + 1 - least)
                if probe <= 0:
                    continue
                index = int(n + (2 * percent * n // -(100 + percent))) + 1
                spot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 9)
                odd = np.bincount(spot.astype(np.int64), minlength=64 * BITMAP) & 1
                words = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
                pos = np.arange(least, least + probe)
                fixed = [np.full(probe, x, np.int64) for x in (cls, n, many)]
                row = [keys[:probe], *fixed, pos, np.append(np.int64(-1), keys[: probe - 1]), pos < index, *(np.full(probe, w, np.int64) for w in words)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    kinds = ", ".join(f"{c} {'boolean' if c == 'is_index' else 'long'}" for c in names)
    return sets.select("class", "n", "keys").mapInArrow(run, kinds)


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def _near_enough(x: str, y: str, percent: int) -> Column:
    """Bounds on the overlap of x and y by length and by bitmap."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.b{w}").bitwiseXOR(F.col(f"{y}.b{w}"))) for w in range(BITMAP)), F.lit(0))
    # n-grams of one class only lie in no other set; the shared ones differ in at least as many as the bitmaps do
    differ = apart + (nx - F.col(f"{x}.many")) + (ny - F.col(f"{y}.many"))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (differ <= nx + ny - 2 * _least_overlap(nx, ny, percent))


def _in_blocks(rows: DataFrame, most: Column) -> DataFrame:
    """rows with ``blocks``, into how many blocks a list of at most so many classes is cut, and ``block``, the row's own."""
    blocks = F.greatest(F.ceil(most / LIST), F.lit(1)).cast("int")
    return rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))


def _chains(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of neighbours, by set size, in each block of a prefix list, pairs with the block's least class, and pairs of a list's leasts."""
    entry = F.struct("n", "class", "many", *[f"b{w}" for w in range(BITMAP)])
    rows = _in_blocks(prefixes, _most_of_band(F.col("key"))).select("key", "block", entry.alias("e"))
    order = W.partitionBy("key", "block").orderBy("e.n", "e.class")
    chain = rows.withColumn("o", F.lag("e").over(order)).where("o is not null").select("e", "o")
    hubs = rows.groupBy("key", "block").agg(F.min("e").alias("o"))
    star = rows.join(hubs, ["key", "block"]).where("e.class <> o.class").select("e", "o")
    tops = hubs.select(F.col("o").alias("e"), F.lag("o").over(W.partitionBy("key").orderBy("o.n", "o.class")).alias("o")).where("o is not null")  # one row for LIST classes
    every = chain.union(star).union(tops).select(F.least("e.class", "o.class").alias("a"), F.greatest("e.class", "o.class").alias("b"), F.col("e").alias("x"), F.col("o").alias("y"))
    return every.where(_near_enough("x", "y", percent)).select("a", "b").distinct()


def _across(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidates whose ends lie in different components; lists meet block by block."""
    rows = prefixes.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    # a list whose classes are all in one component has nothing left to join
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("listed")).where("lo <> hi").select("key", "listed")
    rows = stored(_in_blocks(rows.join(mixed, "key"), F.col("listed")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    x = rows.withColumn("other", F.explode(every)).alias("x")  # x is the longer set
    y = rows.where("is_index").withColumn("other", F.explode(every)).alias("y")
    longer = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") > F.col("y.class")))
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= _least_overlap(F.col("x.n"), F.col("y.n"), percent)
    first = (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == -1)
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.other")) & (F.col("x.other") == F.col("y.block"))
    met = x.join(y, same & longer & (F.col("x.label") != F.col("y.label")) & reach & first & _near_enough("x", "y", percent))
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _cut(sets: DataFrame, of: DataFrame, cuts: list[int]) -> DataFrame:
    """class, n, many, segments of the classes in ``of``: their keys, cut into one array for each fragment."""
    edges = [F.lit(-1).cast("long"), *(F.lit(c).cast("long") for c in cuts), F.lit((1 << 63) - 1).cast("long")]
    inside = lambda lo, hi: F.filter("keys", lambda k: (k >= lo) & (k < hi))
    segments = F.array(*[inside(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])
    return sets.join(small_or_shuffled(of), "class", "left_semi").select("class", "n", F.size("keys").alias("many"), segments.alias("segments"))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, cuts: list[int], percent: int) -> DataFrame:
    """The pairs that link: each fragment counts its part of a pair's overlap, and the parts are summed."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    segments = stored(_cut(sets, ends, cuts).select("class", "n", F.posexplode("segments").alias("fragment", "seg")))
    left = segments.select(F.col("class").alias("a"), F.col("n").alias("na"), "fragment", F.col("seg").alias("x"))
    right = segments.select(F.col("class").alias("b"), F.col("n").alias("nb"), "fragment", F.col("seg").alias("y"))
    parts = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("c"))
    summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return summed.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def partial_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many keys each left segment shares with each right one.

    Lists of the keys that both sides hold, one after the other: a product of
    two 0/1 matrices, some columns at a time.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    at = [[np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in side] for side in (left, right)]
    for lo in range(0, len(both), 4096):
        made = []
        for side in at:
            m = np.zeros((len(side), 4096), np.float32)
            for row, cols in zip(m, side, strict=True):
                row[cols[(cols >= lo) & (cols < lo + 4096)] - lo] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out.astype(np.int64)


def linked(x: list[list[np.ndarray]], y: list[list[np.ndarray]], n: tuple[np.ndarray, np.ndarray], many: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Which classes of x (rows) link with which of y (columns); each class is a list of segments.

    The partial overlaps of the fragments are summed, the rarest n-grams first,
    until no pair is left whose difference so far allows a link.
    """
    na, nb = n[0][:, None], n[1][None, :]
    most = (na + nb) * (100 - percent) // (100 + percent)
    overlap = np.zeros((len(x), len(y)), np.int64)
    differ = na - many[0][:, None] + nb - many[1][None, :]  # n-grams of one class only
    for f in range(len(x[0])):
        a, b = [c[f] for c in x], [c[f] for c in y]
        part = partial_counts(a, b)
        overlap += part
        differ = differ + np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - 2 * part
        if not (differ <= most).any():
            break
    return (differ <= most) & (100 * overlap >= percent * (na + nb - overlap))


def _member_blocks(labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, label, band, block and meets: the blocks (band, block) of its component, its own included, that the class may link with.

    A component that fits into one block is one band; beyond that classes are
    banded by set size, so that sizes which may link are at most SIZE_BANDS
    bands apart, and a band is cut into blocks by hash.
    """
    size = sets.select(F.col("class"), F.col("n"), F.size("keys").alias("many"))
    member = stored(labels.withColumnRenamed("node", "class").join(size, "class"))
    room = lambda members, grams: F.ceil(F.greatest(members / SENT_BLOCK, grams / SENT_GRAMS)).cast("int")
    whole = member.groupBy("label").agg(F.count("*").alias("members"), F.sum("many").alias("grams")).where("members > 2")
    step = float(np.log(100 / percent) / SIZE_BANDS) if percent < 100 else 1e-9
    cut = room(F.col("members"), F.col("grams")) > 1
    banded = stored(member.join(whole, "label").select("class", "label", "many", F.when(cut, F.floor(F.log("n") / step)).otherwise(0).alias("band")))
    bands = banded.groupBy("label", "band").agg(room(F.count("*"), F.sum("many")).alias("blocks"))
    listed = bands.groupBy("label").agg(F.collect_list(F.struct("band", "blocks")).alias("all"))  # a row for each band of sizes
    placed = banded.join(bands, ["label", "band"]).join(listed, "label").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    near = F.filter("all", lambda o: F.abs(o["band"] - F.col("band")) <= SIZE_BANDS + 1)  # one more for the rounding of logarithms
    every = F.flatten(F.transform(near, lambda o: F.transform(F.sequence(F.lit(0), o["blocks"] - 1), lambda k: F.struct(o["band"].alias("band"), k.alias("block")))))
    return placed.select("class", "label", "band", "block", every.alias("meets"))


def _within(labels: DataFrame, sets: DataFrame, copies: DataFrame, cuts: list[int], percent: int) -> DataFrame:
    """class, linked: of classes in components of three or more, the copies of all classes of the component that they link with.

    Pairs of blocks of a component meet in one task each and send one row for
    each class, so links are counted without a row for each of them.
    """
    member = stored(_member_blocks(labels, sets, percent))
    rows = _cut(sets, member.select("class"), cuts).join(member, "class").join(copies, "class")
    # every pair of blocks has one meeting place; a block meets itself too
    own = F.struct("band", "block")
    place = F.explode(F.transform("meets", lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    met = rows.withColumn("p", place).select("label", F.col("p.i.band").alias("ib"), F.col("p.i.block").alias("i"), F.col("p.j.band").alias("jb"), F.col("p.j.block").alias("j"), "band", "block", "class", "n", "many", "copies", "segments")

    at_once = BLOCK

    def one(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        group = group.sort_values(["n", "class"])
        sides = [group[(group["band"] == head[b]) & (group["block"] == k_of)] for b, k_of in (("ib", head["i"]), ("jb", head["j"]))]
        same = head["ib"] == head["jb"] and head["i"] == head["j"]
        counts = [np.zeros(len(s), np.int64) for s in sides]
        parts = [[s.iloc[at : at + at_once] for at in range(0, len(s), at_once)] for s in sides]
        for r, a in enumerate(parts[0]):
            for c, b in enumerate(parts[1]):
                (na, nb), (ca, cb) = ([p[name].to_numpy() for p in (a, b)] for name in ("n", "copies"))
                if (same and c < r) or 100 * na.max() < percent * nb.min() or 100 * nb.max() < percent * na.min():
                    continue
                hit = linked(a["segments"].tolist(), b["segments"].tolist(), (na, nb), (a["many"].to_numpy(), b["many"].to_numpy()), percent)
                if same and r == c:
                    np.fill_diagonal(hit, False)  # both sides hold the same classes in the same order
                counts[0][r * at_once : r * at_once + len(a)] += hit @ cb
                if not (same and r == c):
                    counts[0 if same else 1][c * at_once : c * at_once + len(b)] += hit.T @ ca
        found = sides[:1] if same else sides
        return pd.DataFrame({"class": np.concatenate([s["class"].to_numpy() for s in found]), "linked": np.concatenate(counts[: len(found)])})

    return met.groupBy("label", "ib", "i", "jb", "j").applyInPandas(one, "class long, linked long")


def link_components(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links of every row of docs.

    class_id is the least doc_id with an equal set, component_id the least
    doc_id that links reach; both are the row's own doc_id for the empty set.
    n_links counts the other rows that the row links with, copies included.
    """
    return link(docs, percent, width, ["doc_id"]).select("doc_id", "n_shingles", "class_id", "component_id", "n_links")


def link(docs: DataFrame, percent: int, width: int, keep: list[str]) -> DataFrame:
    """keep, which holds doc_id, n_shingles, class_id, component_id, label and n_links of every row of docs.

    label tells components apart whatever their ids are; it is null for the empty set.
    """
    per_doc = stored(classes(docs, width, keep))
    grouped = per_doc.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    to_long = F.expr("aggregate(sequence(8, 1, -1), 0L, (h, i) -> shiftleft(h, 8) | cast(conv(hex(substring(class_key, i, 1)), 16, 10) as long))")
    known = stored(grouped.withColumn("class", to_long))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bin_bits = max(LEAST_BIN_BITS, (total // BIN).bit_length())
    files = 1 << (bin_bits - FILE_BITS)
    shared = stored(_shared(_blocks(docs, width, bin_bits), bin_bits).coalesce(files))  # a task goes through its bins one by one
    cuts = _cuts(shared)
    keys = shared.repartition(files, "class").groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # the set of one text
    sets = stored(keys.join(known.select("class", "n"), "class"))
    discard(shared)

    prefixes = stored(_prefixes(sets, percent))
    first = stored(_linked_pairs(stored(_chains(prefixes, percent)), sets, cuts, percent))
    labels = components(first)
    copies = known.select("class", "copies")
    within = _within(labels, sets, copies, cuts, percent)
    pairs_of_two = first.join(labels.select(F.col("node").alias("a"), "label"), "a").join(labels.groupBy("label").agg(F.count("*").alias("members")).where("members = 2"), "label").select("a", "b")
    across = stored(_linked_pairs(stored(_across(prefixes, labels, percent)), sets, cuts, percent))
    pairs = pairs_of_two.union(across)
    other = pairs.union(pairs.select("b", "a")).toDF("class", "other").join(copies.toDF("other", "linked"), "other").select("class", "linked")
    links = stored(within.union(other).groupBy("class").agg(F.sum("linked").alias("linked")))
    joined = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(across)
    final = components(joined)
    discard(sets, prefixes)

    member = known.join(final, known["class"] == final["node"], "left").select("class_key", "class", "least", "copies", F.coalesce("label", "class").alias("label")).join(links, "class", "left")
    least = member.groupBy("label").agg(F.min("least").alias("component"))
    named = member.join(least, "label").select("class_key", "least", "component", "label", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = per_doc.alias("d").join(named.alias("n"), F.col("d.class_key") == F.col("n.class_key"), "left")
    return out.select(*[F.col(f"d.{c}") for c in keep], "d.n_shingles", F.coalesce("n.least", "d.doc_id").alias("class_id"), F.coalesce("n.component", "d.doc_id").alias("component_id"), "n.label", F.coalesce("n.n_links", F.lit(0)).cast("long").alias("n_links"))
