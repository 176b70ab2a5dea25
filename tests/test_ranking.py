"""The block index and its segments against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import ranking, search, segments


def texts(n, seed=3):
    """Texts of words of very different frequency, with copies, empty ones and nulls."""
    draw = random.Random(seed)
    made = [" ".join(f"w{int(draw.paretovariate(0.4))}" for _ in range(draw.randint(5, 60))) for _ in range(n)]
    for i in range(0, n, 9):
        made[i] = made[i // 2]
    made[3], made[4] = None, ""
    return made


def tuples(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("size", [ranking.BLOCK, 32])
def test_best_equals_scoring_every_pair(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ranking.with_block, "__defaults__", (0, size))
    made = texts(900)
    docs = spark.createDataFrame([(i, t, f"s{i % 40}") for i, t in enumerate(made)], "doc_id long, text string, source string").repartition(3)
    asked = [(k, made[17 * k + 5]) for k in range(12)] + [(50, None), (51, "unknownword"), (52, "w1 w2"), (53, made[9]), (54, made[9])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    index, plain = search.publish_index(docs, str(tmp_path / "i")), search.build_index(docs)
    for k in (1, 5, 40, 2000):
        assert tuples(search.retrieve(index, queries, k)) == tuples(search.retrieve(plain, queries, k))
    for source in ("s7", "none"):
        condition = search.matches_filter({"subject": source}, {"subject": F.col("source")})
        for fallback in (False, True):
            assert tuples(search.retrieve(index, queries, 5, condition, fallback)) == tuples(search.retrieve(plain, queries, 5, condition, fallback))
    assert search.retrieve(index, queries.limit(0)).count() == 0


def test_fewer_postings_are_read_than_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "SEED_ENTRIES", 100)
    made = texts(3000, 8)
    index = search.publish_index(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), str(tmp_path / "i"))
    queries = spark.createDataFrame([(k, made[11 * k + 7]) for k in range(20)], "query_id long, query string")
    weights = ranking.query_weights(search.query_terms(queries), index.df, index.meta, "query_id")
    least = ranking.limits(index.blocks, index.bags, weights, 5, "doc_id", "query_id")
    assert least.where("least > 0").count() == 20
    planned = ranking.plan(index.blocks, weights, least, "query_id")
    read = planned.agg(F.sum("n")).first()[0]
    held = index.blocks.join(weights.select("query_id", "term"), "term").agg(F.sum("n")).first()[0]
    assert read < 0.25 * held
    pairs = index.postings.join(search.query_terms(queries), "term").select("query_id", "doc_id").distinct().count()
    assert ranking.candidates(index.blocks, planned, "doc_id", "query_id").count() < 0.5 * pairs
    entries = index.blocks.select(F.max(F.size("entries")), F.sum("n")).first()
    assert entries[0] <= ranking.BLOCK and entries[1] == index.postings.count()


def test_segments_equal_a_full_build(spark, tmp_path):
    target = str(tmp_path / "s")
    made = dict(enumerate(texts(120)))
    queries = spark.createDataFrame([(1, made[7]), (2, made[50]), (3, "w1 w2 w3"), (4, None)], "query_id long, query string")
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")

    def same(index, state):
        built = search.build_index(frame(state))
        assert tuples(index.df.select("term", "n")) == tuples(built.df.select("term", "n"))
        assert tuples(index.meta.select("doc_count", F.round("avg_doc_len", 9))) == tuples(built.meta.select("doc_count", F.round("avg_doc_len", 9)))
        assert tuples(index.postings.select("doc_id", "term", "tf", "doc_len")) == tuples(built.postings.select("doc_id", "term", "tf", "doc_len"))
        assert tuples(search.retrieve(index, queries, 7)) == tuples(search.retrieve(built, queries, 7))

    with pytest.raises(FileNotFoundError):
        segments.load(spark, target, frame(made))
    segments.update(spark, target, frame(made))
    state = dict(made)
    first = segments.load(spark, target, frame(state))
    same(first, made)
    more = texts(40, 99)
    steps = [({1: more[1], 2: "", 200: more[2], 201: None}, [5, 6, 999]), ({5: "w1 back again", 1: more[3]}, [1, 200]), ({}, [7, 8]), ({300: "w1 " * 50}, None)]
    for changed, deleted in steps:
        segments.update(spark, target, frame(changed) if changed else None, deleted and spark.createDataFrame([(k,) for k in [*deleted, None]], "doc_id long"))
        for k in deleted or []:
            state.pop(k, None)
        state |= changed
        same(segments.load(spark, target, frame(state)), state)
    same(first, made)  # a reader keeps what it has loaded
    folders = {p.name for p in (tmp_path / "s").glob("s-*")}
    assert len(folders) == 5
    segments.compact(spark, target)
    same(segments.load(spark, target, frame(state)), state)
    segments.update(spark, target, frame({7: "w2 w2"}))
    same(segments.load(spark, target, frame(state | {7: "w2 w2"})), state | {7: "w2 w2"})
    segments.update(spark, target, deleted=frame(state | {7: None}))
    empty = segments.load(spark, target, frame(state))
    assert empty.df.count() == 0 == search.retrieve(empty, queries).count() and empty.meta.first().doc_count == 0


def test_segments_edges(spark, tmp_path):
    target = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", "one two"), ("a", "two three"), (None, "four"), ("b", None)], "doc_id string, text string")
    segments.update(spark, target, rows.limit(0))
    segments.update(spark, target, rows)
    index = segments.load(spark, target, rows)
    assert tuples(index.df) == [(1, "three"), (1, "two")] and index.meta.first().doc_count == 2
    with pytest.raises(ValueError, match="nothing"):
        segments.update(spark, target)
