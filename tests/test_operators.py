"""Operators on small fixtures."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiloom.catalogue import QUERIES
from lexiloom.functions import text as ft
from lexiloom.operators import cleaning, coverage, dom, editorial, packages, replies, search, similarity
from lexiloom.operators import statistics as st
from lexiloom.plans import prompts
from lexiloom.sources import files, sinks
from lexiloom.streaming import ingest


def test_search(spark):
    docs = spark.createDataFrame([(1, "cell wall of plants", "Bio", ["Cell"]), (2, "cell membrane", "Bio", ["x"]), (3, "history of kings", "Hist", ["Kings"]), (4, "", None, None)], "doc_id int, text string, subject string, topics array<string>")
    queries = spark.createDataFrame([(1, "plants cell"), (2, "kings"), (3, "zzz")], "query_id int, query string")
    index = search.build_index(docs)
    hits = [(r.query_id, r.doc_id, r["rank"]) for r in search.retrieve(index, queries, 0).orderBy("query_id", "rank").collect()]
    assert hits == [(1, 1, 1), (1, 2, 2), (2, 3, 1)]
    strict = search.matches_filter({"subject": "none"}, {"subject": F.col("subject")})
    assert search.retrieve(index, queries, 5, strict).count() == 0
    assert search.retrieve(index, queries, 5, strict, fallback=True).count() == 3
    topic = search.matches_filter({"topic": "CELL"}, {"topic": F.col("topics")})
    assert [r.doc_id for r in search.retrieve(index, queries, 5, topic).collect()] == [1]
    assert search.has_corpus(docs) and not search.has_corpus(docs.limit(0))
    assert packages.index_failure(docs.where("text <> ''").withColumnRenamed("doc_id", "id"), index.df, index.meta) == "DOC_COUNT_MISMATCH"
    assert packages.index_failure(docs.withColumnRenamed("doc_id", "id"), index.df, index.meta) == "BLANK_TEXT"


def test_history_statistics(spark):
    rows = [("c", f"2024-01-{20 - i:02d}", str(i), [f"x{i}"] if i != 11 else ["old"], ["only"] if i == 9 else ["a", "a"] if i < 2 else []) for i in range(12)]
    records = st.with_seq(spark.createDataFrame(rows, "ctx string, published string, id string, m array<string>, e array<string>"), ["ctx"], [F.desc("published"), F.col("id")])
    last = st.recent(records)
    weights = {r.item: r.weight for r in st.weighted_counts(last, ["ctx"], "e").collect()}
    assert weights == {"a": 2 * 10 + 2 * 9, "only": 1}
    top = st.top_by_weight(st.weighted_counts(last, ["ctx"], "e"), ["ctx"], st.OVERUSED).collect()
    assert [r.item for r in top] == ["a"]  # one use in the oldest place of the window is not flagged
    lru = st.least_recently_used(st.weighted_counts(records, ["ctx"], "m"), st.weighted_counts(last, ["ctx"], "m"), ["ctx"])
    assert [r.item for r in lru.orderBy("rank").collect()] == ["old", "x10"]
    assert records.groupBy("ctx").agg(st.fill_rate("e").alias("f")).first().f == pytest.approx(3 / 12)
    assert st.drift(records.limit(1).withColumn("score", F.lit(1.0)), ["ctx"]).first().data_available is False
    rising = st.drift(records.withColumn("score", F.col("seq") * 0.5), ["ctx"]).first()
    assert (rising.slope, rising.data_available) == (0.5, True)


def test_divergence(spark):
    d = lambda rows: spark.createDataFrame(rows, "k int, item string, p double")
    same = d([(1, "a", 0.5), (1, "b", 0.5)])
    assert st.divergence(same, same, ["k"]).first().jsd == 0
    assert st.divergence(same, d([(2, "z", 1.0)]), ["k"]).orderBy("k").first().jsd == 1
    assert st.divergence(d([(1, "a", 1.0)]), d([(1, "b", 1.0)]), ["k"]).first().jsd == pytest.approx(1)


def test_loose_contexts(spark):
    ctx = spark.createDataFrame([("A", "x"), ("", "x"), ("A", None)], "c_exam string, c_subject string")
    rec = spark.createDataFrame([("A", "x", 1), ("B", "x", 2), (None, "y", 3), ("A", "", 4)], "exam string, subject string, id int")
    got = sorted((r.c_exam or "", r.c_subject or "", r.id) for r in st.match_contexts(ctx, rec).collect())
    want = sorted((a, s or "", i) for a, s in (("A", "x"), ("", "x"), ("A", None)) for e, u, i in (("A", "x", 1), ("B", "x", 2), (None, "y", 3), ("A", "", 4)) if (not a or not e or a == e) and (not s or not u or s == u))
    assert got == want
    sums = {(r.c_exam, r.c_subject): (r.n, r.ids) for r in st.context_totals(ctx, rec, {"n": F.lit(1), "ids": F.col("id")}).collect()}
    assert sums == {(a, s): (len(i), sum(i)) for a, s in (("A", "x"), ("", "x"), ("A", None)) if (i := [x[2] for x in want if x[:2] == (a, s or "")])}
    last = st.latest_of_contexts(ctx, rec, [F.desc("id")], 2)
    assert sorted((r.c_exam or "", r.c_subject or "", r.id) for r in last.collect()) == sorted(x for x in want if sum(y[:2] == x[:2] and y[2] > x[2] for y in want) < 2)
    marked = rec.select("id", st.loose_match(F.col("exam"), F.lit("A")).alias("ok")).collect()
    assert [r.ok for r in marked] == [True, False, True, True]


def test_coverage(spark):
    rec = spark.createDataFrame([(["Cell wall"],), (["kings"],), ([],)], "concepts_taught array<string>")
    items = st.coverage_probability(spark.createDataFrame([("cell",), ("Atoms",)], "concept string"), rec)
    assert {(r.concept, r.coverage_probability, r.observations) for r in items.collect()} == {("cell", 0.4, 3), ("Atoms", 0.2, 3)}
    assert tuple(st.coverage_summary(items).first()) == (True, 0.3, ["Atoms"])
    wanted = spark.createDataFrame([("cell",), ("Atoms",), ("l w",), ("ce",), ("s",), ("kings",), (" ",), ("cell",)], "concept string")
    rec = rec.union(rec).union(spark.createDataFrame([(["a", "tom"],), (None,)], rec.schema))
    few, many = (sorted(map(tuple, st.coverage_probability(wanted, rec, most).collect())) for most in (1000, 2))
    assert few == many and {c: p for c, p, _ in few}["l w"] == 0.3
    assert tuple(st.coverage_summary(items.limit(0)).first()) == (False, 0.0, [])


def test_coverage_of_nested_and_overlapping_concepts(spark):
    texts = ["abcabc abd", "xABCx", "ab", "bc ca", "", None, "cab | bca", "İstanbul ıssız", "a" * 5000]
    words = ["a", "ab", "abc", "bc", "bca", "cab", "abcabc", "c a", "İ", "ss", "aa", "aaa", "zz", "b"]
    rec = spark.createDataFrame([([t],) for t in texts] + [(None,)], "concepts_taught array<string>").repartition(3)
    low = {r.t: r.low for r in spark.createDataFrame([(t,) for t in texts + words if t], "t string").selectExpr("t", "lower(t) AS low").collect()}
    for most in (100, 3):
        got = {r.concept: r.coverage_probability for r in st.coverage_probability(spark.createDataFrame([(w,) for w in words], "concept string"), rec, most).collect()}
        for w in words:
            n = sum(low[w] in low[t] for t in texts if t)
            assert got[w] == int((1 + n) / (2 + len(texts) + 1) * 100 + 0.5) / 100, w
    assert st.coverage_probability(spark.createDataFrame([], "concept string"), rec).count() == 0
    assert st.texts_with(spark.createDataFrame([("a",)], "key string"), rec.limit(0).selectExpr("'' AS text")).count() == 0


def test_histories_of_hot_contexts(spark):
    """A context with most records is numbered in ranges, with ties, nulls and contexts that are null."""
    rows = [("hot" if i % 3 else None if i % 2 else f"c{i % 5}", f"2024-{i % 12:02d}", f"{i:04d}" if i % 7 else None, i) for i in range(900)]
    rec = spark.createDataFrame(rows, "ctx string, published string, id string, seq_before int").repartition(5)
    order = [F.desc("published"), F.col("id")]
    whole, cut = ({r.seq_before: r.seq for r in st.with_seq(rec, ["ctx"], order, most).collect()} for most in (10_000, 50))
    assert len(cut) == 900
    key = {i: (c, p, x) for c, p, x, i in rows}
    for seqs in (whole, cut):
        for ctx in {c for c, *_ in rows}:
            own = sorted((s, i) for i, s in seqs.items() if key[i][0] == ctx)
            assert [s for s, _ in own] == list(range(len(own)))
            pairs = [(key[i][1], key[i][2]) for _, i in own]
            assert pairs == sorted(sorted(pairs, key=lambda x: (x[1] is not None, x[1] or "")), key=lambda x: x[0], reverse=True)
    plan = st.with_seq(rec, ["ctx"], order, 50)
    sizes = [r.n for r in plan.where("ctx = 'hot'").groupBy(F.floor(F.col("seq") / 100)).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) == 100
    assert st.with_seq(rec.limit(0), ["ctx"], order, 50).count() == 0


def test_similarity(spark):
    text = " ".join(f"w{i}" for i in range(50))
    new = spark.createDataFrame([("n", f"<p>{text}</p>")], "new_id string, text string")
    old = spark.createDataFrame([("same", text), ("none", "completely other words in this text here")], "slug string, text string")
    assert [(r.slug, r.similarity) for r in similarity.closest(new, old).collect()] == [("same", 1.0)]
    cand = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "cand_id int, items array<string>")
    hist = spark.createDataFrame([(9, ["A ", "c"])], "hist_id int, items array<string>")
    assert {(r.cand_id, r.overlap) for r in similarity.max_overlap(cand, hist, "items").collect()} == {(1, 0.333), (2, 0.0)}
    batch = spark.createDataFrame([(0, ["a"]), (1, ["a"]), (2, ["z"])], "seq int, items array<string>")
    got = similarity.batch_overlap(batch, spark.createDataFrame([("h", ["z"])], "id string, items array<string>"), "items")
    assert {(r.seq, r.overlap) for r in got.collect()} == {(0, 0.0), (1, 1.0), (2, 1.0)}
    cards = spark.createDataFrame([(1, ["s1", "s2"])], "cand_id int, c array<string>")
    assert [tuple(r) for r in similarity.repeated_sentences(cards, spark.createDataFrame([(["s2"],)], "c array<string>"), "c").collect()] == [(1, 1, "s2")]
    shapes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "cand_id int, item string")
    hist = spark.createDataFrame([("a",), ("b",)], "item string")
    assert {tuple(r) for r in similarity.structural_similarity(shapes, hist).collect()} == {(1, 0.0, 1.0), (2, 1.0, 0.0)}
    assert {tuple(r) for r in similarity.structural_similarity(shapes, hist.limit(0)).collect()} == {(1, None, 0.0), (2, None, 0.0)}


PACKAGE = {"schema_version": "1", "source": {"title": "T", "subject": "S"}, "chunks": [{"id": "a", "text": "long enough text", "topics": ["t"], "page": 3}, {"id": "b", "text": "another text here", "section": "s"}]}


def verdicts(spark, tmp_path, contents):
    for name, c in contents.items():
        (tmp_path / name).write_text(c if isinstance(c, str) else json.dumps(c))
    return {r.file: r for r in packages.validate(packages.read_packages(spark, str(tmp_path))).collect()}


def test_packages(spark, tmp_path):
    chunk = lambda **k: {"id": "a", "text": "long enough text", **k}
    pkg = lambda *chunks, **k: {**PACKAGE, "chunks": list(chunks), **k}
    got = verdicts(spark, tmp_path, {
        "good.json": PACKAGE,
        "broken.json": pkg(chunk(text=" "), chunk(), chunk(topics=[1]), {"id": "k", "text": "api_key = abcdefghijklmnop"}, chunk(id="z")),
        "lengths.json": pkg(*[chunk(id=str(n), text="x" * n) for n in (9, 10, 8000, 8001, 20000, 20001)]),
        "nochunks.json": {k: v for k, v in PACKAGE.items() if k != "chunks"},
        "empty.json": pkg(),
        "types.json": pkg(chunk(page="p", section=4, concepts="c"), "text", chunk(id="b", page=None, topics=["y" * 101])),
        "root.json": "[1]",
        "bad.json": "{",
        "note.txt": "x",
        "lines.jsonl": json.dumps({"schema_version": "1", "source": {"title": "L"}}) + "\n" + json.dumps(chunk()) + "\n" + json.dumps(chunk(id="c")) + "\n",
        "badline.jsonl": json.dumps({"schema_version": "1", "source": {"title": "L"}}) + "\n{oops\n" + json.dumps(chunk()),
        "version.json": {**PACKAGE, "schema_version": "2", "source": {"title": "", "origin": 4}},
        "script.json": pkg(chunk(text="see <script>x</script> and run.exe now, edit the workflow")),
    })
    assert (got["good.json"].status, got["good.json"].chunks, got["good.json"].usable_chunks, got["good.json"].source) == ("approved", 2, 2, "T")
    assert sorted(got["broken.json"].errors) == sorted(["MISSING_CHUNK_TEXT", "DUPLICATE_CHUNK_ID", "DUPLICATE_CHUNK_ID", "INVALID_METADATA_ENTRY", "SECRET_LIKE_CONTENT"])
    assert (got["broken.json"].chunks, got["broken.json"].usable_chunks) == (5, 4)
    assert got["lengths.json"].errors == ["CHUNK_TOO_SHORT", "CHUNK_WAY_TOO_LONG"] and got["lengths.json"].warnings == ["CHUNK_LONG", "CHUNK_LONG"] and got["lengths.json"].usable_chunks == 4
    assert got["nochunks.json"].errors == ["MISSING_CHUNKS"] and got["empty.json"].errors == ["EMPTY_CORPUS"]
    assert got["types.json"].errors == ["INVALID_PAGE_TYPE", "INVALID_SECTION_TYPE", "INVALID_METADATA_TYPE", "CHUNK_NOT_OBJECT"] and got["types.json"].warnings == ["METADATA_ENTRY_LONG"]
    assert "INVALID_ROOT" in got["root.json"].errors and got["bad.json"].errors == ["INVALID_JSON"] and got["note.txt"].errors == ["UNEXPECTED_FILE_TYPE"]
    assert (got["lines.jsonl"].status, got["lines.jsonl"].chunks) == ("approved", 2)
    assert got["badline.jsonl"].errors == ["INVALID_JSONL_LINE"] and got["badline.jsonl"].chunks == 1
    assert got["version.json"].errors == ["UNSUPPORTED_SCHEMA_VERSION", "MISSING_SOURCE_TITLE", "INVALID_SOURCE_FIELD_TYPE"]
    assert got["script.json"].errors == ["WORKFLOW_TAMPER_SUSPECT", "EXECUTABLE_CONTENT"] and got["script.json"].warnings == ["EXECUTABLE_EXT_MENTION"]
    docs = packages.approved_docs(packages.read_packages(spark, str(tmp_path)))
    assert sorted((r.source, r.id, r.topics) for r in docs.collect()) == [("L", "a", []), ("L", "c", []), ("T", "a", ["t"]), ("T", "b", [])]


def test_publish(spark, tmp_path):
    target = str(tmp_path / "index")
    docs = spark.createDataFrame([("a", "text")], "id string, text string")
    assert sinks.published(spark, target, "docs", "id string, text string").count() == 0
    sinks.publish(spark, target, {"docs": docs}, lambda t: None)
    with pytest.raises(ValueError):
        sinks.publish(spark, target, {"docs": docs.limit(0)}, lambda t: "EMPTY" if t["docs"].isEmpty() else None)
    assert sinks.published(spark, target, "docs").count() == 1
    sinks.publish(spark, target, {"docs": docs.union(docs)}, lambda t: None)
    assert sinks.published(spark, target, "docs").count() == 2


def test_insert_missing(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "id string, v int, derived boolean")
    new = spark.createDataFrame([("a", 2, True), ("b", 2, True), ("c", 2, True)], "id string, v int, derived boolean")
    assert {(r.id, r.v) for r in sinks.insert_missing(old, new).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert {(r.id, r.v) for r in sinks.insert_missing(old, new, force=True).collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_cleaning(spark):
    head = "RUNNING HEAD"
    text = "\n".join(["1.1 Intro", head, "12", "", "This is the first real sentence of the chapter here.", head, "more", head, "1234", "12345", head])
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    assert {r.doc_id: r.x for r in df.select("doc_id", cleaning.clean_text(F.col("text")).alias("x")).collect()} == {1: "This is the first real sentence of the chapter here.\nmore\n12345", 2: ""}
    assert [tuple(r) for r in cleaning.repeated_lines(df).collect()] == [(1, head, 4)]


def test_cleaning_trims_spaces_alone(spark):
    """The digit of a line's place stays; all of Unicode's spaces go, controls stay and make no page number."""
    rows = [(1, "0 first \n1 second", "0 first\n1 second"), (2, "\u00a0 a\u3000 \n\u2003\n\tb\n 12 ", "a\n\tb"), (3, "12\r\n34\u0085\n5\n ", "12\r\n34\u0085"), (4, "x\na b c d e f g\x0bh", "x\na b c d e f g\x0bh"), (5, "x\na b c d e f g h", "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id int, text string, want string")
    assert [(r.doc_id, r.x) for r in df.select("doc_id", "want", cleaning.clean_text(F.col("text")).alias("x")).collect()] == [(i, want) for i, _, want in rows]
    lines = spark.createDataFrame([(1, "l\n\u00a0l\nl\u3000\n l \n\tl")], "doc_id int, text string")
    assert [tuple(r) for r in cleaning.repeated_lines(lines).collect()] == [(1, "l", 4)]


def test_repeated_items_keep_digits_and_lose_spaces(spark, tmp_path):
    rows = [(1, "0 same\n\n1 same\u00a0\nown"), (2, "1 same\n 0 same\n\t1 same"), (3, None), (4, "10\nx"), (5, "x\n\u30001\n10")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["repeated_items"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, "0 same"), (1, 1, "1 same"), (2, 0, "1 same"), (2, 1, "0 same"), (4, 0, "10"), (4, 1, "x"), (5, 0, "x"), (5, 2, "10")}


def test_coverage_tables(spark):
    topics = spark.createDataFrame([("E", "S", "Cell  Wall"), ("E", "S", "Atoms")], "exam string, subject string, topic string")
    pub = spark.createDataFrame([("E", "cell wall")], "exam string, topic string")
    assert [r.topic for r in coverage.backlog(topics, pub).collect()] == ["Atoms"]
    assert sum(r.done for r in coverage.done_flags(topics, pub).collect()) == 0
    rows = spark.createDataFrame([("cell wall notes", 10.0, 400.0, 0.01, 20.0), ("cell", 1.0, 4.0, 0.5, 1.0)], "query string, clicks double, impressions double, ctr double, position double")
    got = coverage.search_matches(rows, "Cell wall")
    assert [r.overlap for r in got.collect()] == [2]
    assert tuple(coverage.search_confidence(got).first()) == (1, 0.8, True)
    cand = spark.createDataFrame([("t", "e", "s1"), ("u", "e", "s2"), ("v", "e", "s3")], "topic string, exam string, slug string")
    left = coverage.not_duplicates(cand, cand.where("topic = 't'"), cand.where("topic = 'u'"))
    assert [r.topic for r in left.collect()] == ["v"]


def test_flavours(spark):
    ctx = spark.createDataFrame([(1, "Difference: compare", "CTET", "Hindi"), (2, "", "X", "Y")], "ctx_id int, topic string, exam string, subject string")
    rec = spark.createDataFrame([("CTET", "Hindi", "2024-02", "b", "compare-and-contrast", "question-hook"), ("CTET", "Hindi", "2024-01", "a", "classification", None)], "exam string, subject string, published string, id string, flavour string, openingStyle string")
    got = {r.ctx_id: r for r in editorial.select_flavour(ctx, rec).collect()}
    assert got[1].selected == "compare-and-contrast" and got[1].recent == ["compare-and-contrast", "classification"]
    assert got[1].candidates[0].score == 3 * 2 + 1 - 2 * 1.5
    assert got[2].selected in {"concept-first"} | {f for f, _ in editorial.FLAVOURS} and got[2].recent == []
    assert {r.ctx_id: r.selected for r in editorial.select_opening(ctx, rec).collect()}[1] != "question-hook"


def test_topic_state(spark):
    rows = [("E", "CDP", f"2024-01-{28 - i:02d}", str(i), ["c1", f"k{i}"], ["m_old"] if i == 11 else [], ["e"], [], [], ["intro", "body"]) for i in range(12)]
    records = spark.createDataFrame(rows, "exam string, subject string, published string, id string, concepts_taught array<string>, misconceptions_used array<string>, examples_used array<string>, question_types array<string>, card_sentences_used array<string>, article_shape array<string>")
    by = ["exam", "subject"]
    state = editorial.topic_state(st.with_seq(records, by, [F.desc("published"), F.col("id")]), by)
    r = editorial.brief(editorial.genome(state)).first()
    assert r.avoid_concepts[0] == "c1" and r.underused_misconceptions == ["m_old"] and (r.opening, r.concept_order) == ("misconception", "misconception_to_rule")
    assert (r.section_count_ewma, r.section_count, r.structural_divergence, r.structural_repetitiveness) == (2.0, 2.0, 0.0, 0.0)
    assert r.classroom_examples == 5 and r.posterior_examples_used == 0.93 and "opening=misconception" in r.block


REPLY = '<<<SEO_JSON>>>{"slug":"old"}<<<END_SEO_JSON>>><<<SEO_JSON>>>```json\n{"focusKeyword":"k","seoTitle":"T","slug":"s"}\n```<<<END_SEO_JSON>>><<<NOTES_BODY_HTML>>><p>b</p><!-- c --> {* def： Term *}x [[AD]]{* END *}{*tip*}y[[AD]] [[WC: 20]]<<<END_NOTES_BODY_HTML>>><<<PUBLISHER_NOTES>>>n<<<END_PUBLISHER_NOTES>>>'


def test_replies(spark):
    raws = [("full", REPLY), ("open", "<<<NOTES_BODY_HTML>>><p>cut"), ("labels", "Focus Keyword: **key**\nSlug: /My Slug/\n<h2>A</h2>text END OF NOTES tail"), ("none", "hello"), ("null", None)]
    got = {r.reply_id: r for r in replies.parse_replies(spark.createDataFrame(raws, "reply_id string, raw string")).collect()}
    full = got["full"]
    assert (full.seo.slug, full.publisher_notes, full.blocks, full.unclosed, full.truncated) == ("s", "n", 2, 1, False)
    assert 'ad-slot-1"' in full.html and 'ad-slot-2"' in full.html and "WC" not in full.html and "block-def" in full.html and "c -->" not in full.html
    assert full.method == "sentinel-json + sentinel-html + blocks:2" and "UNCLOSED_BLOCKS" in full.warnings
    assert got["open"].html == "<p>cut" and got["open"].truncated and "CUT_OFF" in got["open"].warnings
    assert (got["labels"].seo.focusKeyword, got["labels"].seo.slug, got["labels"].html) == ("key", "my-slug", "<h2>A</h2>text")
    assert got["labels"].publisher_notes == "END OF NOTES tail" and "BODY_FROM_H2" in got["labels"].warnings
    assert got["none"].html == "" and got["null"].html == ""
    heads = {"tip: A": ("tip", "A"), "def word": ("def", "word"), "def\tword": ("def", "word"), "what": ("plain", "what"), "FAQ": ("faq", ""), "ti\u200bp： x : y": ("tip", "x : y"), "zzz: t": ("plain", "t"), "": ("plain", "")}
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert {r.h: (r.b.kind, r.b.title) for r in df.select("h", replies.block_header(F.col("h")).alias("b")).collect()} == heads


def test_expand_blocks(spark):
    texts = ["no marks [[AD]]", "head [[AD]]{*h2: A & B*} one [[AD]] {*end*} gap [[AD]] {*tip*}two[[wc: 5]]{*faq: Q*}[[AD]]", "", None, "{* end *}x"]
    got = {r.t: r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", replies.expand_blocks(F.col("t")).alias("x")).collect()}
    assert tuple(got[texts[0]]) == ("no marks [[AD]]", 0, 0) and tuple(got[""]) == ("", 0, 0) == tuple(got[None]) and tuple(got["{* end *}x"]) == ("x\n", 0, 0)
    slot = lambda n: f'<ins id="ad-slot-{n}"></ins>'
    html = f'head [[AD]]<h2 id="a-b">A &amp; B</h2>\none {slot(1)}\ngap {slot(2)}\n<div class="block-tip"><div>two</div></div>\n<div class="block-faq"><h3>Q</h3><div>{slot(3)}</div></div>\n'
    assert tuple(got[texts[1]]) == (html, 3, 2)


def test_dom():
    html = '<h2 id="a">A</h2> <p>number system ' + "w " * 130 + '</p><img alt="Number System x"><a href="#a">1</a><a href="#a">2</a><h3>b</h3>' + "".join(f'<sup id="cite-{i}"><a href="#ref-{i}">x</a></sup>' for i in range(4)) + "<ol>" + "".join(f'<li id="ref-{i}">r</li>' for i in range(4)) + "</ol>"
    got = {k: v[0] for k, v in dom.tree_checks(html, "number system", "example.com").items()}
    assert got == {"image-alt": True, "paragraphs": False, "links": False, "dup-ids": True, "bare-h3": False, "no-script": True, "citations": True, "toc": True, "ad-slots": False, "first-100": True}
    assert dom.tree_checks(None, None, "x")["first-100"][0] is False


MASTER = """# Title
intro
## INPUTS
x
## TEACHING LEVEL
- **Primary (Class 1-5):** p
  more
- **Senior Secondary:** s
  rest

tail
## STRUCTURE
- **Maths:** m
- **Language:** l
- **Other subjects:** o
## SVGs
s
## Extra
<!-- module: id=extra subject=maths depends_on=base -->
e
## Base
<!-- module: id=base exam=nowhere -->
b
## Odd
<!-- module: id=odd subject=history -->
o"""


def test_prompts(spark):
    df = spark.createDataFrame([("p", MASTER)], "prompt_id string, text string")
    r = prompts.assemble(df, subject="Maths", exam="CTET", level="primary", tool="long").first()
    assert r.selected == ["00_CORE/title", "00_CORE/inputs", "20_LEVELS", "30_SUBJECTS", "extra", "base"] and r.excluded == ["80_NOTES/svg", "odd"]
    assert "**Maths:**" in r.prompt and "**Language:**" not in r.prompt and "**Other subjects:**" in r.prompt
    assert "  more" in r.prompt and "rest" not in r.prompt and "tail" in r.prompt
    assert "SELECTED: 00_CORE/title" in prompts.diagnostic(prompts.assemble(df)).first().diagnostic
    needs = spark.createDataFrame([("p", "a", 0, "c"), ("p", "a", 1, "b"), ("p", "b", 0, "a"), ("p", "c", 0, "d"), ("q", "a", 0, "z")], "prompt_id string, id string, nth int, needed string")
    places = spark.createDataFrame([("p", x, n) for n, x in enumerate("dcab")] + [("q", "a", 0), ("q", "z", 1)], "prompt_id string, id string, pos int")
    found = {x.id: (x.turn, x["at"], x.nth) for x in prompts.closure(spark.createDataFrame([("p", "a")], "prompt_id string, id string"), needs, places).collect()}
    assert found == {"a": (0, 0, 0), "c": (1, 2, 0), "b": (1, 2, 1), "d": (2, 1, 0)}
    chain = spark.createDataFrame([("p", f"s{i}", 0, f"s{i + 1}") for i in range(12)], needs.schema)
    spots = spark.createDataFrame([("p", f"s{i}", 20 - i) for i in range(13)], places.schema)
    assert prompts.closure(spark.createDataFrame([("p", "s0")], "prompt_id string, id string"), chain, spots).count() == 13
    filled = df.select(prompts.fill_template(F.lit("a {{X}} b {{X}}"), {"X": F.lit(1)}).alias("x")).first().x
    assert filled == "a 1 b 1"


def test_pieces(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, None), (3, "x" * 100), (4, "🙂" * 7)], "id int, t string")
    rows = lambda **k: sorted((r.id, r["index"], r["count"], r.marker, r.piece) for r in prompts.marked_pieces(df, "id", "t", **k).collect())
    plain = rows(limit=3)
    assert [r[4] for r in plain if r[0] == 1] == ["abc", "def", "g"] and [r for r in plain if r[0] == 2] == [(2, 1, 1, "[1/1]", "")]
    made = rows(limit=20, embed=True)
    assert all(len(r[4].encode("utf-16-le")) <= 40 for r in made)
    for i, t in ((3, "x" * 100), (4, "🙂" * 7)):
        own = [r for r in made if r[0] == i]
        assert "".join(r[4].split("\n", 1)[1] for r in own) == t and [r[3] for r in own] == [f"[{k + 1}/{len(own)}]" for k in range(len(own))]


def test_files(spark, tmp_path):
    (tmp_path / "bank.csv").write_text('﻿S.No.,Subject,Topic\n1,Hindi,"a, ""b"""\n2,Maths,\n3,short\n', encoding="utf-8")
    assert [tuple(r) for r in files.topic_bank(spark, str(tmp_path / "bank.csv")).collect()] == [("Hindi", 'a, "b"')]
    (tmp_path / "no.csv").write_text("A,B\n1,2\n")
    assert files.topic_bank(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "list.csv").write_text("﻿S.No.,Subject,Topic\n1,MAT,t1\n,MAT,blank\n2,XX,t2\n3,MAT,t3\nx\n", encoding="utf-8")
    got = files.numbered_topics(spark, str(tmp_path / "list.csv"), 1, 2, {"MAT": "Maths"})
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [(1, "2", "Auto-detect", "t2"), (2, "3", "Maths", "t3")]
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": "a",\n "topic": "x"}')
    (folder / "b.json").write_text("{broken")
    (folder / "index.json").write_text('["a"]')
    records = files.json_records(spark, str(folder), "id string, topic string")
    assert [r.id for r in records.collect()] == ["a"] and similarity.most_recent(records).count() == 1
    assert files.json_records(spark, str(tmp_path / "gone"), "id string").count() == 0
    assert files.by_manifest(records, files.manifest(spark, str(folder / "index.json"))).count() == 1
    (folder / "t.txt").write_text("one\ntwo")
    assert [r.text for r in files.text_tree(spark, str(folder)).collect()] == ["one\ntwo"]
    (tmp_path / "rows.json").write_text('{"keys":["q"],"clicks":1,"impressions":9,"ctr":0.11111,"position":3.14}\n')
    assert tuple(files.search_rows(spark, str(tmp_path / "rows.json")).first()) == ("q", 1.0, 9.0, 0.1111, 3.1)
    assert tuple(spark.range(1).select(files.search_window(F.lit("2026-09-30").cast("date")).alias("w")).first().w) == ("2026-08-30", "2026-09-27")


def test_book_archives(spark, tmp_path):
    import io
    import zipfile

    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    page = "<html><style>x</style><p>" + "word " * 90 + "</p></html>"
    epub = archive({"b.xhtml": "<p>last</p>", "a.xhtml": page})
    (tmp_path / "My Book (1).zip").write_bytes(archive({"x_2.epub": epub, "y_3.epub": archive({"a.html": "<p>few</p>"}), "bad.epub": b"zz"}))
    (tmp_path / "broken.zip").write_bytes(b"no")
    rows = files.book_archives(spark, str(tmp_path)).collect()
    assert [(r.book, r.chapter, r.text.endswith("last")) for r in rows] == [("my-book", 2, True)]


def test_archives_are_read_by_ranges_of_entries(spark, tmp_path):
    """One archive gives many tasks; a damaged entry loses only itself, a damaged archive only its own."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"dir/part{i:02d}.txt", f"text {i} " * 500)
        z.writestr("other.bin", b"1")
        z.writestr("empty.txt", b"")
    data = bytearray((tmp_path / "many.zip").read_bytes())
    at = zipfile.ZipFile(tmp_path / "many.zip").infolist()[7].header_offset
    data[at + 45 : at + 60] = b"\0" * 15
    (tmp_path / "many.zip").write_bytes(data)
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "B.ZIP", "w") as z:
        z.writestr("x.TXT", "y")
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    found = files.zip_entries(spark, f"file://{tmp_path}", ".txt", partition_bytes=20_000)
    assert found.rdd.getNumPartitions() >= 8
    rows = {(r.archive, r.entry): r for r in found.collect()}
    assert len(rows) == 42 and [k for k, r in rows.items() if r.error] == [("many.zip", "dir/part07.txt")]
    assert bytes(rows["many.zip", "dir/part39.txt"].content) == b"text 39 " * 500 and bytes(rows["B.ZIP", "x.TXT"].content) == b"y"
    assert files.zip_entries(spark, str(tmp_path / "sub" / "B.ZIP")).count() == 1 and files.zip_entries(spark, str(tmp_path / "sub"), ".none").count() == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("a.json", "copy.json"):
        (source / name).write_text(json.dumps(PACKAGE))
    (source / "bad.json").write_text("{")
    query = ingest.validate_stream(ingest.incoming(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    out = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.status for r in out.collect()) == ["approved", "rejected"]


def test_evidence(spark):
    hits = spark.createDataFrame([(1, 1, 2.0, "t" * 200, "b", "c1", None, "S"), (1, 2, 1.0, "<b>markup text that is long</b>", "b", "c1", None, "S"), (1, 3, 1.0, "x" * 30, "b", None, None, "")], "q int, rank int, score double, text string, book string, chapter string, chapter_title string, subject string")
    made = hits.withColumn("reasons", ft.hit_reasons(F.col("text"), F.col("subject"), F.col("chapter_title"), F.col("chapter"), F.col("score")))
    assert [r.reasons for r in made.orderBy("rank").collect()] == [[], ["LOOKS_LIKE_MARKUP"], ["MISSING_SUBJECT", "MISSING_CHAPTER_IDENTITY"]]
    r = editorial.evidence(made, ["q"]).first()
    assert (r.provenance, r.source_confidence, len(r.excerpts), len(r.excerpts[0].excerpt)) == (1, 0.07, 1, 161)
    assert (r.n_valid, r.n_invalid, r.all_valid, r.chapters) == (1, 2, False, ["b::c1"])


def test_evaluate(spark):
    seo = "struct<focusKeyword:string,seoTitle:string,slug:string,metaDescription:string,h1:string,imageAltText:string,imagePrompt:string>"
    memory = "struct<concepts_taught:array<string>,misconceptions_used:array<string>,examples_used:array<string>,pedagogical_strategy:string,article_shape:array<string>,question_types:array<string>,sources:array<string>,flavour:string>"
    fields = "concepts_taught array<string>, examples_used array<string>, misconceptions_used array<string>, question_types array<string>, card_sentences_used array<string>, article_shape array<string>, html string"
    card = '<div style="border-left:6px solid red"><p>Same words.</p></div>'
    words = " ".join(f"w{i}" for i in range(40))
    hist = spark.createDataFrame([("h", ["A"], [], [], [], None, ["x"], f"<p>{words}</p>{card}")], f"id string, {fields}")
    cand = spark.createDataFrame([("c", ["a"], [], [], [], None, ["x"], f"<p>{words}</p>{card}", None, "short", None), ("d", [], [], [], [], None, [], "<p>new</p>", ("k",) * 7, "n" * 30, None)], f"id string, {fields}, seo {seo}, publisher_notes string, memory {memory}")
    got = {r.cand_id: r for r in similarity.evaluate(cand, hist).collect()}
    assert (got["c"].overlap_concepts_taught, got["c"].lexical, got["c"].repeats, got["c"].divergence) == (1.0, 1.0, 1, 0.0)
    assert got["c"].novelty == 0.6 and "MISSING_SEO" in got["c"].errors and set(got["c"].warnings) == {"THIN_PUBLISHER_NOTES", "MISSING_CONTENT_MEMORY"}
    assert got["d"].novelty == 1.0 and got["d"].errors == ["MISSING_BODY"]


def test_gate(spark):
    seo = "struct<focusKeyword:string,seoTitle:string,slug:string,metaDescription:string,h1:string>"
    row = ("number system", "Number System Notes", "number-system", "number system " + "x" * 137, "संख्या पद्धति क्या है")
    df = spark.createDataFrame([(1, row, "<p>number system</p>"), (2, None, None)], f"id int, seo {seo}, html string")
    got = {r.id: r for r in dom.gate(df, "id", "example.com").collect()}
    assert got[1].failed == ["citations", "image-alt", "links"] and not got[1].publishable
    assert {"title", "slug", "h1", "meta", "first-100"} <= set(got[2].failed)


def test_note_bundles(spark):
    body = "<p>number system " + "w " * 110 + '</p><img alt="Number system">' + "".join(f'<a href="/p{i}">i</a>' for i in range(5)) + '<a href="https://o.org/">o</a><a href="https://n.org/">n</a>' + "".join(f'<sup id="cite-{i}"><a href="#ref-{i}">x</a></sup>' for i in range(4)) + "<ol>" + "".join(f'<li id="ref-{i}">r</li>' for i in range(4)) + "</ol>"
    seo = {"focusKeyword": "number system", "seoTitle": "Number System Notes", "slug": "number-system", "metaDescription": "number system " + "x" * 137, "h1": "संख्या पद्धति क्या है", "imageAltText": "a", "imagePrompt": "p"}
    raw = f"<<<SEO_JSON>>>{json.dumps(seo)}<<<END_SEO_JSON>>><<<NOTES_BODY_HTML>>>{body}<<<END_NOTES_BODY_HTML>>><<<PUBLISHER_NOTES>>>notes<<<END_PUBLISHER_NOTES>>>"
    got = {r.reply_id: r for r in dom.note_bundles(spark.createDataFrame([("good", raw), ("bad", raw.replace("<img", "<b")), ("none", None)], "reply_id string, raw string")).collect()}
    assert got["good"].publishable and got["good"].failed == [] and got["good"].bundle.seo.slug == "number-system" and got["good"].warnings == ["NO_BLOCKS", "ad-slots", "toc"]
    assert got["bad"].bundle is None and "image-alt" in got["bad"].failed
    assert got["none"].failed == ["EMPTY_BODY", "MISSING_SLUG", "MISSING_FOCUS_KEYWORD"] and got["none"].bundle is None


def test_decisions(spark):
    rows = [(1, i, "x", ["a"], [], ["m"], [], [], ["s1", "s2"]) for i in range(3)]
    records = spark.createDataFrame(rows, "user_id int, seq int, item string, concepts_taught array<string>, examples_used array<string>, misconceptions_used array<string>, question_types array<string>, card_sentences_used array<string>, article_shape array<string>")
    made = editorial.decision_documents(editorial.brief(editorial.genome(editorial.topic_state(records, ["user_id"]), "user_id")), ["user_id"]).first()
    document = json.loads(made.document)
    assert document["mode"] == "full" and document["editorial_genome"]["section_count"] == 2.0 and document["statistics"]["sample_size"] == 3 and document["confidence"] == made.confidence
    pairs = coverage.known_pairs(spark.createDataFrame([("E", "S")] * 3, "exam string, subject string"), spark.createDataFrame([("E", "S", "t"), ("F", "S", "v"), ("F", "S", "u")], "exam string, subject string, topic string"))
    best = editorial.recommendation(editorial.next_post(pairs), spark.createDataFrame([("F", "S", "v"), ("F", "S", "u")], "exam string, subject string, topic string")).first()
    assert (best.exam, best.suggestion, best.n_open, best.mode) == ("F", "u", 2, "recommend-only")


def test_long_articles(spark):
    from lexiloom.functions import html as fh

    df = spark.createDataFrame([("w " * 100,), ("w " * 3000,), ("w " * 6000,)], "h string")
    got = [(r.f, r.s) for r in df.select(fh.hard_failures(F.struct(F.lit("k").alias("focusKeyword"), F.lit("t").alias("seoTitle"), F.lit("s").alias("slug")), F.col("h")).alias("f"), fh.soft_warnings(F.col("h"), F.array(F.lit("P"))).alias("s")).collect()]
    assert got == [(["EMPTY_BODY", "TOO_FEW_WORDS"], ["P", "SHORT_ARTICLE"]), ([], ["P", "SHORT_ARTICLE"]), ([], ["P"])]


def test_index_is_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Cell wall, cell"), (2, "kings"), (3, "")], "doc_id int, text string")
    stored, built = search.publish_index(docs, str(tmp_path / "i")), search.build_index(docs)
    for name in ("postings", "df", "meta"):
        a, b = (sorted(map(str, getattr(x, name).collect())) for x in (stored, built))
        assert a == b
    assert sorted((r.doc_id, r.term, r.tf, r.doc_len) for r in stored.postings.collect()) == [(1, "cell", 2, 3), (1, "wall", 1, 3), (2, "kings", 1, 1)]
    assert sinks.is_published(spark, str(tmp_path / "i")) and not sinks.is_published(spark, str(tmp_path / "none"))
    assert search.load_index(spark, str(tmp_path / "i"), docs).meta.first().doc_count == 3


def test_corpus_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Bio", "b", 'a "q", x\ny'), ("Hist", "h", "z")], "subject string, book string, text string")
    sinks.corpus(rows, str(tmp_path / "corpus"))
    sinks.corpus(rows, str(tmp_path / "corpus"))
    assert sorted(r.text for r in files.csv_rows(spark, str(tmp_path / "corpus" / "csv")).collect()) == ['a "q", x\ny', "z"]
    packs = spark.createDataFrame([("a", b"1"), ("b", b"2")], "file string, content binary")
    verdict = spark.createDataFrame([("a", "approved", []), ("b", "rejected", ["EMPTY_CORPUS"])], "file string, status string, errors array<string>")
    for _ in range(2):  # a run that is repeated replaces its rows
        sinks.route(packs, verdict, str(tmp_path / "routed"), "r1")
    assert sorted((r.file, r.status, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "routed" / "packages")).collect()) == [("a", "approved", b"1"), ("b", "rejected", b"2")]
    assert spark.read.json(str(tmp_path / "routed" / "verdicts")).where("status = 'rejected'").first().errors == ["EMPTY_CORPUS"]
    sinks.state_file(rows.limit(1), str(tmp_path / "state"))
    assert spark.read.json(str(tmp_path / "state")).count() == 1
    checks = cleaning.cross_checks(rows, rows.limit(1), spark.createDataFrame([(1,)], "doc_count int"))
    assert {r.check: r.ok for r in checks.collect()} == {"files_rows": False, "rows_index": True, "books_present": False}


def test_dashboard(spark):
    rows = spark.createDataFrame([("a", None, "Cell"), ("b", "2024", "Atom"), ("c", "2025", "cell wall")], "id string, published string, topic string")
    assert [r.id for r in coverage.newest_first(rows).collect()] == ["c", "b", "a"]
    assert {r.id for r in coverage.free_text(rows, "CELL", ["topic"]).collect()} == {"a", "c"}
    assert rows.select(prompts.reference_sources(F.col("topic"), ["g"], {"Cell": ["own"]}).alias("s"), "id").orderBy("id").first().s == ["g", "own"]
    header = rows.limit(1).select(prompts.run_header(F.lit("t"), F.lit("e"), F.lit("s"), F.lit(70), F.lit(2026)).alias("x")).first().x
    assert "LANGUAGE MIX: Hindi 70% + English 30%" in header


def _best(sets, history, allowed):
    """The highest overlap of each set with those of history that are allowed, rounded."""
    out = {}
    for a, x in sets.items():
        found = [len(x & y) / len(x | y) for b, y in history.items() if allowed(a, b) and x & y]
        out[a] = math.floor(max(found, default=0.0) * 1000 + 0.5) / 1000
    return out


def test_overlap_with_hot_items(spark):
    """Items in most sets, alone and together, beside rare ones; equal sets, sets without items, nulls."""
    draw = random.Random(2)
    sets = {i: {f"hot{k}" for k in range(4) if draw.random() < 0.6} | {f"rare{draw.randint(0, 150)}" for _ in range(draw.randint(0, 4))} for i in range(300)}
    sets[7], sets[8], sets[9] = set(), {"hot0"}, {"hot0"}
    rows = spark.createDataFrame([(i, sorted(s) if i != 7 else None) for i, s in sets.items()], "cand_id long, items array<string>").repartition(3)
    hist = rows.withColumnRenamed("cand_id", "hist_id")
    for hot in (20, similarity.HOT):
        assert dict(map(tuple, similarity.max_overlap(rows, hist, "items", others_only=True, hot=hot).collect())) == _best(sets, sets, lambda a, b: a != b)
        assert dict(map(tuple, similarity.max_overlap(rows.where("cand_id < 100"), hist.where("hist_id >= 100"), "items", hot=hot).collect())) == _best({i: s for i, s in sets.items() if i < 100}, {i: s for i, s in sets.items() if i >= 100}, lambda a, b: True)
        old = {1000 + i: sets[i] for i in range(0, 60, 7)}
        got = similarity.batch_overlap(rows.withColumnRenamed("cand_id", "seq"), spark.createDataFrame([(i, sorted(s)) for i, s in old.items()], "id long, items array<string>"), "items", hot=hot)
        assert dict(map(tuple, got.collect())) == _best(sets, sets | old, lambda a, b: b < a or b >= 1000)
    pairs = lambda hot: similarity.item_pairs(rows, hist, "items", keep=2, condition=F.col("cand_id") != F.col("hist_id"), hot=hot).count()
    assert pairs(20) < 0.5 * pairs(similarity.HOT)
    assert similarity.max_overlap(rows, hist.limit(0), "items", hot=20).where("overlap > 0").count() == 0


def _drawn_sets(n, seed):
    draw = random.Random(seed)
    return {i: {f"i{draw.randint(0, 40)}" for _ in range(draw.choice([0, 1, 3, 8]))} for i in range(n)}


def test_batch_overlap_counts_pairs_in_tasks(spark):
    """Blocks of a few sets give what all pairs give; ids may be text or null; no pair of sets is shuffled."""
    sets, old = _drawn_sets(120, 3), _drawn_sets(60, 4)
    batch = spark.createDataFrame([(i, sorted(s) + ["", None]) for i, s in sets.items()], "seq long, items array<string>").repartition(3)
    history = spark.createDataFrame([(None if i == 5 else f"h{i % 50}", sorted(s)) for i, s in old.items() if i < 50] + [("none", None)], "id string, items array<string>")
    want = _best(sets, sets | {1000 + i: s for i, s in old.items() if i < 50}, lambda a, b: b < a or b >= 1000)
    for block in (30, similarity.BLOCK):
        made = similarity.batch_overlap(batch, history, "items", block=block)
        assert dict(map(tuple, made.collect())) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "block_a" in plan and not re.search(r"hashpartitioning\(seq#\w+, other#", plan)
    assert dict(map(tuple, similarity.batch_overlap(batch, history.limit(0), "items", block=30).collect())) == _best(sets, sets, lambda a, b: b < a)
    assert similarity.batch_overlap(batch.limit(0), history, "items").count() == 0


def test_overlap_with_others_counts_pairs_in_tasks(spark):
    """Each record against all others, ids as text and a record without one, through one table and through two."""
    sets = {f"k{i}": s for i, s in _drawn_sets(150, 5).items()}
    rows = spark.createDataFrame([(i, sorted(s) or None) for i, s in sets.items()], "cand_id string, items array<string>").repartition(3)
    want = _best(sets, sets, lambda a, b: a != b)
    for hot, block in ((similarity.HOT, 40), (similarity.HOT, similarity.BLOCK), (10, 40)):
        made = similarity.overlap_among(rows, "items", hot=hot, block=block)
        assert dict(map(tuple, made.collect())) == want
    made = similarity.max_overlap(rows, rows.withColumnRenamed("cand_id", "hist_id"), "items", others_only=True, block=40)
    assert dict(map(tuple, made.collect())) == want
    assert not re.search(r"hashpartitioning\(cand_id#\w+, hist_id#", made._jdf.queryExecution().executedPlan().toString())
    lone = rows.unionByName(spark.createDataFrame([(None, ["i1"])], rows.schema))
    assert {r.cand_id: r.overlap for r in similarity.overlap_among(lone, "items").collect()} == want | {None: 0.0}


def test_closest_with_a_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    old = [(f"s{i:03d}", f"{passage} " + " ".join(f"x{i % 40}w{k}" for k in range(10 + i % 25))) for i in range(200)] + [("copy", f"own text here {passage} and its end")] + [("none", None), ("other", "nothing in common with any of those texts")]
    new = spark.createDataFrame([(1, passage), (2, f"own text here {passage} and its end"), (3, "w " * 9), (4, None)], "new_id long, text string")
    old = spark.createDataFrame(old, "slug string, text string").repartition(3)
    few, whole = (sorted(map(tuple, similarity.closest(new, old, k=5, hot=hot).collect())) for hot in (50, similarity.HOT))
    assert few == whole and len(few) == 10 and few[5][1:3] == ("copy", 1.0)


def test_trees_are_made_once_and_other_columns_pass(spark):
    """Null documents and phrases, ties and a column named like a check; every row comes back with all checks."""
    rows = [(1, None, None, "a"), (1, None, None, "a"), (2, "<p>number system </p><h3>x</h3>", "number system", None), (None, "", "x", "b")]
    made = dom.with_checks(spark.createDataFrame(rows, "id long, html string, phrase string, check string"), "html", "phrase")
    found = made.select("id", "check", dom.failing("hard").alias("hard"), dom.failing("soft").alias("soft")).collect()
    assert sorted((r.id or 0, r.check or "") for r in found) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]
    assert [r.hard for r in found if r.id == 2] == [["bare-h3", "citations", "image-alt", "links"]]
    assert [r.hard for r in found if r.id == 1] == [["citations", "first-100", "image-alt", "links"]] * 2
    assert {tuple(r.soft) for r in found} == {("ad-slots", "toc")}
    assert made.limit(0).count() == 0 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_gaps_as_rows(spark):
    items = spark.createDataFrame([("s", "b", 0.1), ("s", "a", 0.1), ("s", "c", 0.35), ("t", "d", None), (None, "e", 0.0)], "subject string, concept string, coverage_probability double")
    assert sorted((r.subject or "", r.concept, r.rank) for r in st.coverage_gaps(items, ["subject"]).collect()) == [("", "e", 1), ("s", "a", 1), ("s", "b", 2)]
    assert st.coverage_gaps(items.limit(0), ["subject"]).count() == 0
