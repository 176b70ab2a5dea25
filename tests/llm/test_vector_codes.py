"""Vector codes against a plain Lloyd iteration."""

import hashlib
import math

import numpy as np
import pytest

from lexiloom.llm import vector_codes as vc


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error, label_error)} and the digest of the codebooks, part by part and entry by entry."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    if not kept:
        return {}, None
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = {}, {}
    for i, v, label in kept:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in near), sum(e for e, _ in near), label)
        by_label[label] = by_label.get(label, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {i: (c, e, by_label[label]) for i, (c, e, label) in out.items()}, digest


def check(spark, rows):
    want, digest = plain(rows)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, at string").repartition(3)
    got = vc.code_report(table).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and len(got) == len(want)
    assert {r.codebooks_sha256 for r in got} <= {digest}
    return got


@pytest.mark.parametrize("block", [vc.BLOCK, 50])
def test_codes_of_given_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vc.blocks, "__defaults__", (block,))
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert len(check(spark, rows)) == 500


def test_codes_of_hard_rows(spark):
    """Nulls, what is not finite, copies, ties between entries, few vectors, null labels."""
    rng = np.random.default_rng(7)
    v = [[float(x) for x in np.float32(rng.integers(-3, 4, 64) / 256)] for _ in range(90)]  # few values, so distances tie
    rows = [(i, x, i % 3 if i % 4 else None) for i, x in enumerate(v)]
    rows += [(200 + i, v[5], 1) for i in range(300)]
    rows += [(600, None, 1), (601, [], 1), (602, [None] + v[0][1:], 1), (603, [math.nan] + v[0][1:], 1), (604, [math.inf] + v[0][1:], 2), (605, v[0][:63] + [-math.inf], None)]
    assert len(check(spark, rows)) == 390
    assert len(check(spark, rows[:7])) == 7
    assert check(spark, rows[-6:]) == [] == check(spark, [])
    flat = [(i, [0.5] * 64, None) for i in range(70)]
    assert {r.code for r in check(spark, flat)} == {"00" * 16}


def test_lengths_and_sizes(spark):
    good = [(i, [float(i)] * 32, 0) for i in range(20)]
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert vc.code_report(table(good + [(90, [1.0] * 16, 0), (None, [3.0] * 32, None)])).count() == 21
    with pytest.raises(ValueError, match="cannot be cut"):
        vc.code_report(table([(1, [1.0] * 31, 0)]))
    assert vc.code_report(table([(1, [-1e6] * 16, 0), (2, [1e6] * 16, 0)])).where("error = 0").count() == 2


def test_trees_prune_and_agree(spark):
    """Clustered parts are mostly assigned by nodes, and whatever the shape of the trees the nearest entries are found."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 64, 4))
    points = centres[:, rng.integers(0, 64, 5000)] + rng.integers(-9, 10, (16, 5000, 4))
    tree, book = vc.build(points, vc.LEAF), vc.build(centres, 1)
    found, sums, counts, work = vc.assign(tree, book)
    apart = ((tree.points[:, :, None] - centres[:, None]) ** 2).sum(3)
    assert (found == apart.argmin(2)).all()
    assert counts.sum() == 16 * 5000 and (sums.sum(1) == points.sum(1)).all()
    assert work["whole"] > 2 * work["compared"]
    for n, k in ((1, 1), (3, 5), (40, 3), (700, 64), (129, 33)):
        points, centres = rng.integers(-20, 20, (2, n, 3)), rng.integers(-20, 20, (2, k, 3))
        tree = vc.build(points, 1 + n % 5)
        found, sums, counts, _ = vc.assign(tree, vc.build(centres, 1))
        assert (found == ((tree.points[:, :, None] - centres[:, None]) ** 2).sum(3).argmin(2)).all()
        assert (counts == np.stack([np.bincount(f, minlength=k) for f in found])).all()
