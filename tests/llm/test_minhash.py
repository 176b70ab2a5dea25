"""MinHash near-duplicates against sets compared in full."""

import random

import numpy as np
import pytest

import brute
from lexiloom.llm import minhash
from lexiloom.llm.shingles import shingle_set


def plain(rows, width=2):
    found = brute.components([(k, t) for k, (_, t) in enumerate(rows)], width=width)  # rows may share ids
    least = {}
    for k, (_, label, _) in found.items():
        if rows[k][0] is not None:
            least[label] = min(least.get(label, rows[k][0]), rows[k][0])
    out = []
    for k, (n, label, _) in found.items():
        name = least.get(label, rows[k][0])
        out.append((rows[k][0], n, name, rows[k][0] == name))
    return sorted(out, key=str)


def check(spark, rows, parts=4):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, class long, bands string, b0 int").repartition(parts)
    got = minhash.near_duplicates(table)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows)
    return got


HARD = [None, "", " \n", "one", "ONE", "one two", "one two three", "One  two", "x " * 3000, "word" * 40000, "中文 字 a", "a b c", "a b c d e f g h i j k", "a b c d e f g h i j k l", "a b c d e f g h i j"]


def test_hard_rows(spark):
    rows = list(enumerate(HARD)) + [(None, "one two three four"), (None, "one two three four"), (None, "alone again"), (3, "one"), (3, "one"), (77, " ".join(f"w{i}" for i in range(20000)))]
    rows += [(None, "a b c d e f g h i j k")]
    check(spark, rows)
    assert check(spark, []) == []


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("block", [minhash.LIST, 6])
def test_groups_of_near_copies(spark, monkeypatch, block):
    """Groups in which members link with some others only, at every similarity around the limit."""
    monkeypatch.setattr(minhash, "LIST", block)
    draw, rows = random.Random(5), []
    for group in range(6):
        words = [f"g{group}w{i}" for i in range(60 + 20 * group)]
        for _ in range(50):
            own = list(words)
            for at in draw.sample(range(len(own)), draw.randint(0, 5 + group)):
                own[at] = f"e{draw.random()}"
            rows.append((len(rows), " ".join(own)))
    got = check(spark, rows)
    assert 6 < len({r[2] for r in got}) < len(rows)


def test_chains_link_end_to_end(spark):
    """Neighbours link, ends have nothing in common: one component."""
    words = [f"t{i}" for i in range(400)]
    rows = [(1000 - i, " ".join(words[4 * i : 4 * i + 60])) for i in range(80)]
    assert {r[2] for r in check(spark, rows)} == {921}


def test_links_are_found_at_the_limit(spark):
    """Pairs that just link: 400 of 500 shingles in common, once for each of 300 pairs."""
    rows = []
    for p in range(300):
        common = [f"c{p}x{i}" for i in range(401)]
        rows += [(2 * p, " ".join(common + [f"a{p}x{i}" for i in range(50)])), (2 * p + 1, " ".join(common + [f"b{p}x{i}" for i in range(50)]))]
    assert sum(r[3] for r in check(spark, rows)) == 300


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(3)
    for share in (0.95, 0.85, 0.8):
        guesses = []
        for _ in range(60):
            union = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = round(400 * (1 - share) / 2)
            x, y = (minhash.odd_sketch(minhash.samples(np.unique(s))) for s in (union[n:], np.append(union[: 400 - 2 * n], union[400 - n :])))
            apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert apart <= minhash.most_apart(80)
            guesses.append(minhash.estimate(apart))
        shared = (400 - 2 * n) / 400
        assert abs(np.mean(guesses) - shared) < 0.02
    a, b = (minhash.samples(shingle_set(" ".join(f"{s}{i}" for i in range(90)))) for s in "xy")
    assert (a != b).all() and not set(minhash.band_keys(a)) & set(minhash.band_keys(b))
    assert minhash.estimate(0) == 1
