"""Compression of vectors to codes, one small codebook for each part of a vector, by dual-tree Lloyd rounds.

A component x becomes the integer floor(256 * x); a vector is cut into equal
consecutive parts, and each position has a codebook of up to ``entries``
entries, which starts as that part of the smallest kept vec_ids.

1. *Trees over parts.*  Blocks of vectors are cut, for every position, into a
   balanced tree of boxes by halving at the median of the widest component.  A
   block is one row of a stored table: its parts in the order of the tree's
   leaves, the boxes, and the cached sums of every node.  It is built once.
2. *Trees over entries.*  The same tree over a codebook, down to one or two
   entries a leaf.
3. *Rounds.*  Pairs (node of parts, node of entries) go down both trees
   together.  The least distance of two boxes bounds what an entry can give,
   the largest what another one surely gives; pairs beyond that are pruned.  A
   node of parts with one entry left is assigned whole, by its cached sums.
   Leaves with several are uncertain: their parts are compared with those
   entries in integers.  Bounds are integers as well, and pairs that may tie are
   never pruned, so the result is that of comparing every part with every
   entry; ties go to the lower index.
4. *Means.*  A task adds up its blocks and sends one row for each component of
   a codebook; the sums, of which there are as many as codebook components,
   come to the driver, which floors the quotients.  Unused entries stay.

Vectors that are null or hold null or non-finite components are dropped, and so
are empty ones and those of another length than the commonest (of several: the
longest), which cannot be compared with the rest.  The commonest length must be
a multiple of the number of parts, and components at most 2**20 in size, so
that distances fit 64 bits; anything else raises an error.  A null vec_id sorts
after all others, and rows with equal vec_ids are ordered by their vectors;
every row is coded.  With fewer than 64 kept vectors the codebooks are
shorter.  Equal labels share a label_error, nulls together.  An empty table
gives no rows.  Columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_tasks, small_or_shuffled, stored

#: Vectors of a block, and parts of a leaf at least.
BLOCK, LEAF = 8192, 16
#: Pairs of uncertain leaves and entries, roughly, that are compared at one time.
PAIRS = 1 << 15
#: The largest size of a component of a vector.
LARGEST = 1 << 20


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, embedding (array<double>) of the rows that are kept, and the length of their vectors, 0 without any."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    lengths = good.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    dims = top.dims if top else 0
    return good.where(F.size("embedding") == dims), dims


def scaled(batch: pa.Array, dims: int) -> np.ndarray:
    """floor(256 * x) of a column of vectors, as a matrix of integers."""
    x = np.floor(np.asarray(batch.flatten(), np.float64).reshape(-1, dims) * 256.0)
    if len(x) and np.abs(x).max() > LARGEST * 256:
        raise ValueError(f"components are larger than {LARGEST}")
    return x.astype(np.int64)


def edges_of(n: int, leaf: int) -> list[np.ndarray]:
    """For each level of a balanced tree over n points the places where its nodes start, and n; leaves hold ``leaf`` points or more."""
    out = [np.array([0, n])]
    while (np.diff(out[-1]) // 2).min() >= leaf:
        e = out[-1]
        out.append(np.sort(np.append(e, (e[:-1] + e[1:]) // 2)))
    return out


@dataclass
class Tree:
    """Trees of all positions at once; arrays are indexed by position first, boxes and sums are lists over levels."""

    order: np.ndarray  # positions x points: the point that stands at each place
    points: np.ndarray  # positions x points x components, in that order
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def build(points: np.ndarray, leaf: int) -> Tree:
    parts, n, _ = points.shape
    edges = edges_of(n, leaf)
    order = np.broadcast_to(np.arange(n), (parts, n)).copy()
    low, high, sums = [], [], []
    for level, e in enumerate(edges):
        low.append(np.minimum.reduceat(points, e[:-1], axis=1))
        high.append(np.maximum.reduceat(points, e[:-1], axis=1))
        sums.append(np.add.reduceat(points, e[:-1], axis=1))
        if level + 1 == len(edges):
            break
        widest = np.repeat((high[-1] - low[-1]).argmax(2), np.diff(e), axis=1)
        value = np.take_along_axis(points, widest[:, :, None], 2)[:, :, 0]
        least = np.repeat(np.take_along_axis(low[-1], (high[-1] - low[-1]).argmax(2)[:, :, None], 2)[:, :, 0], np.diff(e), axis=1)
        span = int((value - least).max()) + 1
        node = np.repeat(np.arange(len(e) - 1), np.diff(e))
        sorted_ = np.argsort(node * span + (value - least), axis=1)
        order = np.take_along_axis(order, sorted_, 1)
        points = np.take_along_axis(points, sorted_[:, :, None], 1)
    return Tree(order, points, edges, low, high, sums)


def _children(nodes: np.ndarray, deeper: bool) -> tuple[np.ndarray, int]:
    """Both children of each node, one after the other, or the nodes themselves."""
    return (np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), 2) if deeper else (nodes, 1)


def assign(parts: Tree, book: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Nearest entries of all parts (positions x places), sums and counts of each entry, and how much work it took."""
    positions, n, d = parts.points.shape
    entries = book.points.shape[1]
    found = np.zeros((positions, n), np.int64)
    sums = np.zeros((positions, entries, d), np.int64)
    counts = np.zeros((positions, entries), np.int64)
    work = {"whole": 0, "compared": 0}

    pos, a, b = np.arange(positions), np.zeros(positions, int), np.zeros(positions, int)
    la = lb = 0
    while True:
        lo_a, hi_a, lo_b, hi_b = parts.low[la][pos, a], parts.high[la][pos, a], book.low[lb][pos, b], book.high[lb][pos, b]
        gap = np.maximum(np.maximum(lo_b - hi_a, lo_a - hi_b), 0)
        reach = np.maximum(hi_a - lo_b, hi_b - lo_a)
        nearest, farthest = (gap * gap).sum(1), (reach * reach).sum(1)
        first = np.flatnonzero(np.diff(pos * len(parts.edges[la]) + a, prepend=-1))  # pairs of one node of parts stand together
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pos))))
        keep = nearest <= np.minimum.reduceat(farthest, first)[group]
        pos, a, b, group = pos[keep], a[keep], b[keep], group[keep]
        last = lb + 1 == len(book.edges)
        if last:  # nodes of parts with one entry left are done
            width = np.diff(book.edges[lb])[b]
            alone = (np.bincount(group, width, len(first))[group] == 1) & (width == 1)
            p, node = pos[alone], a[alone]
            entry = book.order[p, book.edges[lb][b[alone]]]
            np.add.at(sums, (p, entry), parts.sums[la][p, node])
            start, size = parts.edges[la][node], np.diff(parts.edges[la])[node]
            np.add.at(counts, (p, entry), size)
            at = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            found[np.repeat(p, size), at] = np.repeat(entry, size)
            work["whole"] += int(size.sum())
            pos, a, b = pos[~alone], a[~alone], b[~alone]
        if not len(pos) or (last and la + 1 == len(parts.edges)):
            break
        more_a, more_b = la + 1 < len(parts.edges), not last
        # children of a node of parts must stand together, so they are made first and sorted last
        a2, times = _children(a, more_a)
        pos, b = np.repeat(pos, times), np.repeat(b, times)
        b2, times = _children(b, more_b)
        pos, a, b = np.repeat(pos, times), np.repeat(a2, times), b2
        la, lb = la + more_a, lb + more_b
        line = np.lexsort((b, a, pos))
        pos, a, b = pos[line], a[line], b[line]

    if len(pos):  # uncertain leaves
        width = np.diff(book.edges[lb])[b]
        spot = np.repeat(book.edges[lb][b] - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())
        pos, a = np.repeat(pos, width), np.repeat(a, width)
        entry = book.order[pos, spot]
        size, own = np.diff(parts.edges[la]), book_points(book)
        leaves = np.flatnonzero(np.diff(pos * len(size) + a, prepend=-1))
        cuts = np.unique(np.append(leaves[np.searchsorted(leaves[1:], np.arange(0, len(pos), PAIRS))], len(pos)))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            p, leaf, e = pos[lo:hi], a[lo:hi], entry[lo:hi]
            at = np.minimum(parts.edges[la][leaf][:, None] + np.arange(size.max()), n - 1)
            apart = parts.points[p[:, None], at] - own[p, e][:, None, :]
            key = (apart * apart).sum(2) * entries + e[:, None]  # ties go to the lower index
            one = np.flatnonzero(np.diff(p * len(size) + leaf, prepend=-1))
            best = np.minimum.reduceat(key, one, axis=0) % entries
            real = np.arange(size.max()) < size[leaf[one]][:, None]
            where, who, what = np.repeat(p[one], size[leaf[one]]), at[one][real], best[real]
            found[where, who] = what
            np.add.at(sums, (where, what), parts.points[where, who])
            np.add.at(counts, (where, what), 1)
            work["compared"] += int(real.sum())
    return found, sums, counts, work


def book_points(book: Tree) -> np.ndarray:
    """The entries of a codebook's tree in their own order."""
    out = np.empty_like(book.points)
    np.put_along_axis(out, book.order[:, :, None], book.points, 1)
    return out


def _as_parts(matrix: np.ndarray, parts: int) -> np.ndarray:
    """positions x vectors x components."""
    return np.ascontiguousarray(matrix.reshape(len(matrix), parts, matrix.shape[1] // parts).transpose(1, 0, 2))


def blocks(kept: DataFrame, dims: int, parts: int, block: int = BLOCK) -> DataFrame:
    """A row for each block of vectors: ids, labels, and the trees of its parts as bytes."""
    ids, labels = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    names = ["order", "points", "low", "high", "sums"]
    schema = T.StructType([T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), *(T.StructField(c, T.BinaryType()) for c in names)])

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        tree = build(_as_parts(scaled(table.column(2).chunk(0), dims), parts), LEAF)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), c.chunk(0)) for c in table.columns[:2]]
        raw = [tree.order.astype("<i4").tobytes(), tree.points.astype("<i8").tobytes(), *(np.concatenate(x, axis=1).astype("<i8").tobytes() for x in (tree.low, tree.high, tree.sums))]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in raw)], ["ids", "labels", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, block - n), batch.slice(block - n)
                held.append(part)
                n += part.num_rows
                if n == block:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return in_tasks(kept.select("vec_id", "label", "embedding"), run, schema)


def _unpacked(batch: pa.RecordBatch, row: int, parts: int) -> Tree:
    """The tree of a block's row."""
    raw = {c: batch.column(batch.schema.get_field_index(c))[row].as_buffer() for c in ("order", "points", "low", "high", "sums")}
    order = np.frombuffer(raw["order"], "<i4").reshape(parts, -1)
    n = order.shape[1]
    edges = edges_of(n, LEAF)
    cuts = np.cumsum([len(e) - 1 for e in edges])[:-1]
    levels = [np.split(np.frombuffer(raw[c], "<i8").reshape(parts, sum(len(e) - 1 for e in edges), -1), cuts, axis=1) for c in ("low", "high", "sums")]
    return Tree(order, np.frombuffer(raw["points"], "<i8").reshape(parts, n, -1), edges, *levels)


def updated(trees: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks (positions x entries x components) after one round: assigned parts' floored means; unused entries stay."""
    parts = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, count = build(book, 1), np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                _, sums, counts, _ = assign(_unpacked(batch, row, parts), own)
                total += sums
                count += counts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), book.shape[2]))], ["at", "total", "n"])

    added = in_tasks(trees.select("order", "points", "low", "high", "sums"), run, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = book.ravel().tolist()
    for r in added.where("n > 0").collect():  # as many rows as the codebooks have components
        out[r["at"]] = r["total"] // r["n"]
    return np.array(out, np.int64).reshape(book.shape)


def coded(trees: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every vector by the codebooks."""
    ids, labels = (trees.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = build(book, 1) if book.size else None  # without entries there are no blocks
        for batch in batches:
            for row in range(batch.num_rows):
                tree = _unpacked(batch, row, len(book))
                found, *_ = assign(tree, own)
                apart = tree.points - np.take_along_axis(book, found[:, :, None], 1)
                codes, errors = np.empty(found.shape, np.uint8), np.empty(found.shape, np.int64)
                np.put_along_axis(codes, tree.order, found.astype(np.uint8), 1)
                np.put_along_axis(errors, tree.order, (apart * apart).sum(2), 1)
                text = [c.tobytes().hex() for c in np.ascontiguousarray(codes.T)]
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(k).flatten() for k in (0, 1)), pa.array(text, pa.string()), pa.array(errors.sum(0))], ["vec_id", "label", "code", "error"])

    return in_tasks(trees, run, schema)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of all kept vectors, and the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part, so up to 256 entries")
    kept, dims = kept_vectors(vectors)
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    book = _as_parts(scaled(pa.array([r[0] for r in first], pa.list_(pa.float64())), dims or parts), parts)
    trees = stored(blocks(kept, dims, parts))
    for _ in range(rounds if len(first) else 0):
        book = updated(trees, book)
    return coded(trees, book), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    made, book = compress(vectors, parts, entries, rounds)
    rows = stored(made)
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = rows.alias("r").join(small_or_shuffled(stored(labels)).alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return joined.select("r.vec_id", "r.code", "r.error", "l.label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
