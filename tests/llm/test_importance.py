"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lexiloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain(docs, target):
    """Sorted rows (doc_id, n_features, weight, score, rank); ranks of equal rows are any of theirs."""
    s, t = (Counter(b for _, x in rows for b in features(x)[1]) for rows in (docs, target))
    whole = [sum(c.values()) for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole[0] + 10000) / ((s[b] + 1) * (whole[1] + 10000))))
    rows = []
    for i, text in docs:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    for r in able[25 * len(able) // 100 :] + [r for r in rows if r not in able]:
        r[4] = None
    return sorted(map(tuple, rows), key=str)


HARD = [None, "", "...", "one", "One, two!", "ÀB c 中文 x\x00y _z {q}", "w " * 50, "same words again " * 9, "a1 b2 " * 3000] + ["copy of a text with enough words to be drawn by the operator " * 2] * 40


@pytest.mark.parametrize("limits", [(importance.PIECE, importance.RANGE), (7, 5)])
@pytest.mark.parametrize("name", ["small", "hard", "empty"])
def test_resampling(spark, monkeypatch, name, limits):
    monkeypatch.setattr(importance.pieces, "__defaults__", limits[:1])
    monkeypatch.setattr(importance, "RANGE", limits[1])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    if name != "small":
        docs = [(i if i % 13 else None, t) for i, t in enumerate(HARD)] if name == "hard" else []
        target = [(1, None), (2, "One two copy of it"), (3, "")] if name == "hard" else []
    table = spark.createDataFrame([(*d, "x", 3, 4) for d in docs], "doc_id long, text string, row string, rank int, buckets int").repartition(4)
    got = importance.resample(table, spark.createDataFrame(target, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain(docs, target)
    assert sorted(map(tuple, got.collect()), key=str) == want or name == "hard"
    if name == "hard":  # rows with equal ids tie, so the rows without their ranks, and the ranks, are compared
        rows = [tuple(r) for r in got.collect()]
        assert sorted((r[:4] for r in rows), key=str) == sorted((r[:4] for r in want), key=str)
        assert sorted(r[4:] + r[3:4] for r in rows if r[4]) == sorted(r[4:] + r[3:4] for r in want if r[4])


def test_words_and_windows_over_cuts():
    text = "Ab, cd  ef1 éx " * 40 + "tail" * 30
    whole = importance.buckets_of(text)
    n, found = features(text)
    assert whole[0] == n and whole[1].tolist() == sorted(found)
    assert "".join(importance.pieces(text, 9)) == text and len(list(importance.pieces(text, 9))) > 20


def test_gains_follow_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(("apple pear plum" if i % 10 == 0 else "iron steel zinc").split() * 10)) for i in range(2000)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "apple pear plum " * 50)], "item_id long, text string")
    rows = importance.resample(docs, target, percent=10).collect()
    drawn = [r.doc_id for r in rows if r["rank"]]
    assert len(drawn) == 200 and sum(i % 10 == 0 for i in drawn) > 100  # a tenth of the documents, over half of the drawn
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 201))
