"""Each operator against its plain version, on the small tables and on hard rows."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

import brute
from pyspark.sql import functions as F

from lexiloom.llm import bpe, common, decontam, lang_id, licenses, ngram_join, quality, queries, shards, token_counts, url_filters, warc
from lexiloom.llm.common import stored

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    None, "", " \n\t ", "one", "One two THREE", "one two three four five", "a b c d e f g h i j k l", PASSAGE, PASSAGE.upper() + " tail",
    "x " * 3000, "word" * 40000, "é È ñ 中文 字 \u00a0 x\u2003y", "same line\nsame line\nsame line\n\n", "<|endoftext|> a <|endoftext|>\u00a0  b",
    "Licensed under CC BY-NC 4.0. CC by and cc  BY.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. all\nrights reserved", "Released under the MIT License.",
    PASSAGE, PASSAGE, "it's we'll 123abc  \n\n  end ", "\x00nul \x1c sep\x85x", "🙂🙂 🙂 $$$ ***",
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(3, 203)), " ".join(f"w{i}" for i in range(2, 202)) + " z", "ß " * 60,
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, None if i % 5 == 0 else "xx", None if i % 7 == 0 else "s", i, -1, "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, shard string").repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module", params=["hard", "small", "empty"])
def docs(request, hard, small):
    return {"hard": hard, "small": small, "empty": small.limit(0)}[request.param]


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.link_components(docs).collect()}
    assert got == brute.components(pairs(docs))


@pytest.mark.parametrize("blocks", [(ngram_join.LIST, ngram_join.BLOCK, ngram_join.SENT_BLOCK), (9, 7, 20)])
def test_components_of_many_near_copies(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "LIST", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK", blocks[1])
    monkeypatch.setattr(ngram_join, "SENT_BLOCK", blocks[2])
    words = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        w[(7 * i) % 110] = f"edit{i}"
        if i % 3 == 0:
            w[(11 * i + 5) % 110] = f"other{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(words[:60] + [f"p{i}x{k}" for k in range(20)])) for i in range(100)]
    rows += [(2000 + i, " ".join(words[:i])) for i in range(20, 120)]  # sizes of one component up to five times as large
    found = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.components(rows)


def test_a_task_gathers_few_ngrams():
    """The n-grams that a task gathers before it sends them, and what is made of them, stay small beside a worker."""

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    texts = [" ".join(f"w{k}x{i}" for i in range(4000)) for k in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 50])], ["text"]) for a in range(0, 300, 50)]
    run = ngram_join._blocks(Frame(), 5, 7)
    sum(1 for _ in run(iter(batches[:1])))
    tracemalloc.start()
    sent = sum(sum(map(len, b.column(1).to_pylist())) for b in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 300 * 3996 * ngram_join.SENT // 8  # every n-gram is sent
    assert peak < 25e6, peak


def test_stored_ngrams_are_few_files(spark, monkeypatch):
    """Each file takes two processes on a local file system, so bins share files; links stay as they are."""
    made = []

    def stored(df):
        made.append(common.stored(df))
        return made[-1]

    monkeypatch.setattr(ngram_join, "stored", stored)
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(400 - i % 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.link_components(docs).collect()}
    assert found == {i: (i - i % 2, 1) for i in range(400)}
    files = {tuple(t.columns): len(t.inputFiles()) for t in made}
    most = 1 << (ngram_join.LEAST_BIN_BITS - ngram_join.FILE_BITS)
    assert files["class", "key"] <= most and files["class", "keys", "n"] <= most, files


def test_blocks_of_a_component_meet_by_size(spark, monkeypatch):
    """A class is sent to blocks of sizes that it may link with only, and to as many as these sizes need."""
    monkeypatch.setattr(ngram_join, "SENT_BLOCK", 16)
    sizes = [20 + k % 400 for k in range(1600)]
    labels = spark.createDataFrame([(k, 0) for k in range(1600)], "node long, label long")
    sets = spark.createDataFrame([(k, n, list(range(n))) for k, n in enumerate(sizes)], "class long, n long, keys array<long>")
    rows = ngram_join._member_blocks(labels, sets, 80).collect()
    where = {r["class"]: (r.band, r.block) for r in rows}
    meets = {r["class"]: {(m.band, m.block) for m in r.meets} for r in rows}
    assert len(rows) == 1600 and all(where[k] in meets[k] for k in where)
    for a in range(0, 1600, 37):
        for b in range(1600):
            lo, hi = sorted((sizes[a], sizes[b]))
            assert 100 * lo < 80 * hi or where[b] in meets[a]
    every = len(set(where.values()))
    assert sum(map(len, meets.values())) < 0.45 * 1600 * every


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (None, "q")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.link_components(df).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_ROWS, 3])
def test_decontamination(spark, docs, limit):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "alpha BETA gamma"), (901, PASSAGE), (901, PASSAGE), (902, None), (903, "..."), (904, "x x x x x x x x x x x x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.judge(docs, table, broadcast_rows=limit).collect()}
    assert got == brute.decontaminate(pairs(docs), items)


def test_decontamination_removal(spark, hard):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = decontam.remove(hard, items)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(TEXTS) if "kappa" not in (t or "").lower()}
    cut = {r.doc_id: r.text for r in decontam.remove(spark.createDataFrame([(1, f"Head, {PASSAGE}; tail.\n"), (2, None), (3, "none")], "doc_id long, text string"), items, spans=True).collect()}
    assert cut == {1: "Head ; tail.\n", 2: None, 3: "none"}
    empty = spark.createDataFrame([], "item_id long, text string")
    for spans in (False, True):
        assert decontam.remove(hard, empty, spans=spans).count() == len(TEXTS)
        assert decontam.remove(hard.limit(0), items, spans=spans).count() == 0


def test_decontamination_spans(spark):
    """Several passages in one text, some that touch, and columns called like those inside the operator."""
    items = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, "three")], "item_id long, text string")
    text = f"Start one, two. mid {PASSAGE} {PASSAGE}? end one two three (stop) one"
    rows = [(1, text, "mine", "all", "hits", "key"), (2, "clean", "r", "a", "h", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, all string, hits string, key string")
    got = {r.doc_id: tuple(r) for r in decontam.remove(docs, items, spans=True).collect()}
    assert got == {1: (1, "Start . mid ? end  (stop) one", "mine", "all", "hits", "key"), 2: rows[1]}
    assert [tuple(r) for r in decontam.remove(docs, items).collect()] == [rows[1]]


def test_decontamination_of_many_hits_in_one_text(spark):
    """Work is linear in the hits: a quadratic step would take hours here."""
    docs = spark.createDataFrame([(1, "x " * 400_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 12)], "item_id long, text string")
    row = decontam.judge(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items) == (400_000, 400_000, 1)
    assert decontam.remove(docs, items, spans=True).first().text.strip() == ""


def test_quality(docs):
    measured = quality.measure(docs, ["doc_id", "lang", "source"])
    out = quality.apply_rules(measured, stored(quality.thresholds(quality.sketch(measured, ["lang", "source"])))).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out}
    assert got == {i: brute.quality(t) for i, t in pairs(docs)}
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()]
    assert {r.doc_id: r.kept for r in out} == brute.quality_kept(rows, quality.METRICS, quality.PRIOR)


def test_quality_fences_adapt(spark):
    """Fences follow their group: what is usual in one source is rejected in another, and small groups follow their language."""
    plain = " ".join(f"word{i}" for i in range(80))
    loud = " ".join(f"WORD{i}" if i % 3 else f"word{i}" for i in range(80))
    rows = [("en", "caps", loud)] * 300 + [("en", "plain", plain)] * 300 + [("en", "plain", loud), ("en", "small", plain), (None, None, plain)]
    table = spark.createDataFrame([(i, t, a, b) for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    measured = quality.measure(table, ["doc_id", "lang", "source"])
    limits = stored(quality.thresholds(quality.sketch(measured, ["lang", "source"])))
    kept = {r.doc_id: r.kept for r in quality.apply_rules(measured, limits).collect()}
    assert all(kept[i] for i in range(600)) and not kept[600] and kept[601] and kept[602]
    assert quality.apply_rules(measured.limit(0), stored(limits.limit(0))).count() == 0


def test_quality_fences_of_given_groups(spark):
    """On the given documents fences differ between groups, clean texts stay and junk goes."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    measured = stored(quality.measure(docs, ["doc_id", "lang", "source"]))
    limits = stored(quality.thresholds(quality.sketch(measured, ["lang", "source"])))
    found = limits.collect()
    assert len(found) == 80
    for k in ("dup_lines", "repeats", "upper", "word_length"):
        assert len({r[f"max_{k}"] for r in found}) >= 4, k
    judged = quality.apply_rules(measured, limits).where("not base_failed").join(labels, "doc_id")
    kept = {r.quality: (r.n, r.kept) for r in judged.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1][1] >= 0.997 * kept[1][0] and kept[0][1] <= 0.01 * kept[0][0], kept


def test_quality_slack_is_for_short_texts(spark):
    """A dozen symbols pass in a short text of a group that has none, and a share of symbols that is usual in its group passes anywhere."""
    words = [f"word{i}" for i in range(80)]
    few, many = " ".join(words + ["#"] * 12), " ".join(words + ["#"] * 60)
    rows = [("en", "prose", " ".join(words))] * 300 + [("en", "code", many)] * 300 + [("en", "prose", few), ("en", "prose", many)]
    table = spark.createDataFrame([(i, t, a, b) for i, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    measured = quality.measure(table, ["doc_id", "lang", "source"])
    kept = {r.doc_id: r.kept for r in quality.apply_rules(measured, stored(quality.thresholds(quality.sketch(measured, ["lang", "source"])))).collect()}
    assert all(kept[i] for i in range(601)) and not kept[601]


def test_quality_sketches_merge(spark, small):
    measured = quality.measure(small, ["doc_id", "lang", "source"])
    whole = sorted(map(tuple, quality.merge(quality.sketch(measured, ["lang"]), ["lang"]).collect()), key=str)
    parts = [quality.sketch(measured.where(f"doc_id % 3 = {k}"), ["lang"]) for k in range(3)]
    assert whole == sorted(map(tuple, quality.merge(parts[0].union(parts[1]).union(parts[2]), ["lang"]).collect()), key=str)


def test_licenses(docs):
    out = licenses.scan(docs).collect()
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out}
    assert got == {i: brute.license_places(t, licenses.PHRASES) for i, t in pairs(docs)}
    want = brute.license_labels(pairs(docs), licenses.TEMPLATES, licenses.PHRASES, licenses.COMMON, licenses.LEAST)
    full = brute.license_labels(pairs(docs), licenses.TEMPLATES, licenses.PHRASES, licenses.COMMON, licenses.LEAST, whole=True)
    for r in out:
        assert r.labels == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=2e-6), r.doc_id
        assert r.labels == full[r.doc_id][0]  # candidates by rarest words lose no label


def test_license_candidates_are_few(spark):
    """Texts with common licence words only are no candidates; what stands in a text is found by its rarest words."""
    common = "the software and this license may be used for any purpose by any person in this version"
    notices = [notice for _, notice, _ in licenses.TEMPLATES]
    texts = [common] * 400 + notices + [" ".join(n.split()[: len(n.split()) // 2]) for n in notices]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = stored(licenses.places(docs.withColumn("row", F.col("doc_id")), ["doc_id", "row"]))
    df = dict(found.select(F.explode(F.array_distinct(F.col("seen.word"))).alias("w")).groupBy("w").count().collect())
    index = stored(licenses.postings(spark).withColumn("idf", F.log(F.lit(len(texts) + 1) / (F.create_map(*[F.lit(x) for kv in df.items() for x in kv])[F.col("word")] + 1)) + 0.1).selectExpr("*", "idf / sum(idf) OVER (PARTITION BY template) AS weight"))
    rare = {(r.template, r.word) for r in licenses.rarest(index).collect()}
    for t, (_, notice, _) in enumerate(licenses.TEMPLATES):
        own = {w for w in notice.split() if w not in licenses.COMMON}
        mine = {w for k, w in rare if k == t}
        assert mine and mine <= own and max(df[w] for w in mine) <= min((df[w] for w in own - mine), default=10**9)
    shifts = licenses.shifts_of(found.select("row", "seen", "keys"), index)
    assert shifts.where("row < 400").count() < 0.2 * found.where("row < 400").select(F.sum(F.size("seen"))).first()[0] * len(notices)
    assert shifts.where(f"weight >= {licenses.LEAST} and row >= 400 and row < {400 + len(notices)}").select("row").distinct().count() == len(notices)


def test_license_templates(hard):
    labels = {r.doc_id: r.labels for r in licenses.scan(hard).collect()}
    assert labels[TEXTS.index("Released under the MIT License.")] == "mit"
    assert labels[14] == "cc-by,cc-by-nc-4.0" and labels[15] == "gpl,gpl-3.0"


def test_licenses_of_several_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted."
    mpl = "Subject to the terms of the Mozilla Public License, v. 2.0."
    apache = "Licensed under the Apache License, Version 2.0"
    texts = {1: f"{mit}\n{bsd}", 2: f"{bsd} x {mpl} y {mit} z {apache}", 3: mit}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("bsd,mit", 1.0), 2: ("apache-2.0,bsd,mit,mpl-2.0", 1.0), 3: ("mit", 1.0)}


def test_licenses_by_template_and_in_pairs(spark):
    """Each notice alone gives its label, and two notices in one text give both."""
    notices = [(label, notice) for label, notice, _ in licenses.TEMPLATES]
    rows = [(i, f"Head of the file. {n}. And more text.") for i, (_, n) in enumerate(notices)]
    rows += [(1000 + 50 * i + j, f"{a} ;; {b}") for i, (_, a) in enumerate(notices) for j, (_, b) in enumerate(notices) if i < j]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (a, _) in enumerate(notices):
        assert a in got[i]
        for j, (b, _) in enumerate(notices):
            assert i >= j or {a, b} <= got[1000 + 50 * i + j]


def test_shards(docs):
    rows = shards.assign(docs, 24).collect()
    texts = dict(pairs(docs))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    counts = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        counts.setdefault(r.shard, []).append(r.slot)
    if rows:
        n = [len(counts.get(s, [])) for s in range(24)]
        assert max(n) - min(n) <= 1 and set(counts) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())


def test_shards_do_not_depend_on_splits(spark):
    rows = [(i % 700 or None, f"t{i % 90}" if i % 11 else None) for i in range(2500)] + [(None, "hot")] * 900
    a = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    b = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    x, y = (sorted(map(tuple, shards.assign(d, 24).select("doc_id", "text_crc32", "shard", "slot").collect()), key=str) for d in (a, b))
    assert x == y and len(x) == 3400


def test_shards_cut_no_more_than_plain_propagation(spark, small):
    for table in (small, spark.createDataFrame([(i, f"g{i % 130}" if i % 3 else f"single{i}") for i in range(3000)], "doc_id long, text string")):
        texts, got = dict(pairs(table)), shards.assign(table, 24).collect()
        plain = brute.propagate(texts, 24)
        assert brute.cut_edges(texts, {r.doc_id: r.shard for r in got}) <= brute.cut_edges(texts, plain)


def test_shards_keep_groups_together(spark):
    rows = [(i, f"copy {i % 600}") for i in range(2400)] + [(3000 + i, "hot") for i in range(1500)] + [(9000 + i, f"single {i}") for i in range(1000)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    text, where = dict(rows), {}
    for r in out:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    cut = sum(len(s) - 1 for t, s in where.items() if t != "hot")
    assert cut <= 60, cut


def test_shards_cut_large_groups_least(spark):
    """Shards that hold each group, by the group's size: none is cut that a shard could hold."""
    small = [(i, f"pair {i % 10}") for i in range(20)] + [(100 + i, f"single {i}") for i in range(20)]
    sizes = {"a": 60, "b": 60, "c": 60, "d": 13, "e": 250, "f": 100}
    mixed = [t for t, n in sizes.items() for _ in range(n)]
    mixed = list(enumerate(mixed + [f"single {i}" for i in range(2400 - len(mixed))]))
    for rows, want in ((small, {f"pair {i}": 1 for i in range(10)}), (mixed, {t: -(-n // 100) for t, n in sizes.items()})):
        text, where, counts = dict(rows), {}, [0] * 24
        for r in shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect():
            where.setdefault(text[r.doc_id], set()).add(r.shard)
            counts[r.shard] += 1
        assert {t: len(where[t]) for t in want} == want
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_bpe(docs):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = bpe.encoding(bpe.read_ranks(path), pattern)
    assert isinstance(own, tiktoken.Encoding)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, path, pattern).collect()}
    want = {}
    for i, t in pairs(docs):
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def test_bpe_pieces():
    own = bpe.encoding(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    text = "It's 12 o'clock,  we'll go\n\n now-then ... ok's \t x" * 50
    for size in (5, 17, 64):
        pieces = list(bpe.safe_pieces(text, size))
        assert "".join(pieces) == text and len(pieces) > 20
        assert [i for p in pieces for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_bpe_of_long_white_space(spark):
    """Runs over which the library's own matching fails; the merges of long runs are checked by those of whole tokens."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    own = bpe.encoding(ranks, pattern)
    for white in (" ", "\n", " \t", "\n  \u3000"):
        for before, after in (("", ""), ("", "word"), ("a, b", ""), ("x", "!"), ("x", "\x1c y"), ("é", " z")):
            text = before + white * 40_000 + after
            assert bpe.encode_text(text, ranks, pattern) == own.encode_ordinary(text)
            parts = list(bpe.white_runs(text, 50))
            assert "".join(p for p, _ in parts) == text and sum(w for _, w in parts) == 1
            assert [i for p, w in parts for i in (own._encode_single_piece(p.encode()) if w else own.encode_ordinary(p))] == own.encode_ordinary(text)
    texts = [" " * 2_000_000, "\n" * 2_000_000, " \n\t" * 700_000 + "word", "word " + "\r\n" * 1_000_000, ("a" + " " * 1_500_000) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, path, pattern).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    longest = max((len(own.decode_bytes([k])), k) for k in range(own.n_vocab) if not own.decode_bytes([k]).strip(b" "))
    assert got[0].n_tokens >= 2_000_000 / longest[0]


def test_bpe_of_other_patterns():
    """A pattern that treats white space otherwise is left to the library."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for pattern in (r"\w+|\s*[\r\n]+|\s+(?!\S)|\s+|.", r"\S+|\s+"):
        text = "a" + " " * 70_000 + "\n b"
        assert bpe.encode_text(text, ranks, pattern) == bpe.encoding(ranks, pattern).encode_ordinary(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    path = public_tokenizers.path(name)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect()}
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    assert got == {i: (len((t or "").encode()), n := count(t or ""), n > 512) for i, t in pairs(docs)}


URLS = [None, "", "x", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "https://a.net/es/1", "http://net/fr/", "http://xnet/fr/a", "http://a.com?q=/x", "http://b.com#f", "ftp://c.org/x.com/y", "http://u://v.com/", "http://ads.x.org/a", "http://a.org/ads/b", "http://é.net/es/ü", "http://spam-farm.example.org/x", "http://a.org/" + "x/" * 3000 + "ads/q", "http://www.example.com/en/a"]


def test_urls(spark):
    table = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filters.verdicts(table).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute.url_rule(u, url_filters.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert [got[i].verdict for i in (0, 14, 15, 17, 18)] == ["block"] * 5
    assert url_filters.verdicts(table.limit(0)).count() == 0


def test_urls_canonical(spark):
    same = ["http://spam-farm.org", "http://spam-farm.org/", "http://x.ads.org", "http://x.ads.org:8080/a", "http://u@x.ads.org./a", "http://a.org/%61ds/b", "http://a.org/ADS/b", "http://a.org/x.EXE", "http://a.org/c/../ads/b", "http://a.org/./ads/./b", "http://a.org/%2e%2e/ads/"]
    other = ["http://a.org/ads", "http://a.org/ads/..", "http://a.org/ads/../b", "http://a.org", "http://a.org/%zz", "http://a.org/%ff%00"]
    table = spark.createDataFrame(list(enumerate(same + other)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.verdicts(table).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(same) + ["allow"] * len(other)
    for host, path, want in (("a.b", "", b".a.b/"), ("", "/x", b"./x"), ("a", "/b/..", b".a/"), ("a", "/b/./c", b".a/b/c"), ("a", "//", b".a//"), ("", "", b"")):
        assert url_filters.canonical(host, path) == want
    rules = spark.createDataFrame([("rule", "org/", "block"), ("glob", "**", None), ("rule", "org/", "block")], "kind string, pattern string, verdict string")
    assert url_filters.load_rules(rules) == ((("block", "org/"),), ("**",))
    assert {r.verdict for r in url_filters.verdicts(table, *url_filters.load_rules(rules)).collect()} == {"block"}


def test_url_machine_against_regular_expressions():
    import itertools
    import re

    globs = ["a*b", "**a", "*", "**", "a**b/", "/*/", "", "ab*", "*/a**"] * 9  # over one word of bits
    machine = url_filters.compile_rules(globs)
    texts = ["".join(x) for n in range(6) for x in itertools.product("ab/", repeat=n)]
    found = url_filters.simulate(machine, [t.encode() for t in texts])
    for k, g in enumerate(globs):
        own = re.compile("".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|[^*]", g)))
        assert [bool(x) for x in found[:, k]] == [bool(own.fullmatch(t)) for t in texts], g


def test_language_id(spark, small):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = table.join(lang_id.identify(table), "doc_id").collect()
    held = [r for r in rows if r.held_out and len(r.text or "") > 200]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def _language_rows(spark):
    docs = [(r.lang, r.text[:300]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    return docs + [docs[0]] * 30 + [("one", "zebra quokka xylophone"), ("none", "123 !"), (None, "abc"), ("en", None), ("twin a", "same words here"), ("twin b", "same words here")]


def test_language_id_against_plain_version(spark, monkeypatch):
    """Copies, a language of one text, one without letters, and two languages with equal centroids."""
    rows = _language_rows(spark)
    texts = [t for _, t in rows] + ["", None, "??", "quokka", "same words"]
    train = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.languages(rows, texts)
    for at_once in (256, 2):
        monkeypatch.setattr(lang_id, "LANGS_AT_ONCE", at_once)
        model = lang_id.fit(train)
        assert model.langs == sorted({x for x, _ in rows} - {None, "none"})
        got = sorted(lang_id.predict(docs, model, ["doc_id"]).collect(), key=lambda r: r.doc_id)
        assert [(r.lang_pred, r.rejected) for r in got] == [(a, c) for a, _, c in want]
        assert all(abs(r.score - b) < 1e-4 for r, (_, b, _) in zip(got, want, strict=True))


def test_language_id_learns_languages_of_copies(spark):
    """Sampling never loses a language, whatever its texts repeat."""
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]
    rows = [(f"l{n:02d}", f"{w} {w[::-1]} {w * 3}") for n, w in enumerate(words) for _ in range(400)] + [("many", f"number {i} of many texts") for i in range(900)]
    train = spark.createDataFrame(rows, "lang string, text string")
    assert lang_id.fit(train, per_lang=50).langs == sorted({x for x, _ in rows})
    sizes = {r.lang: r["count"] for r in lang_id.sample(train, 50).groupBy("lang").count().collect()}
    assert sizes == {f"l{n:02d}": 1 for n in range(12)} | {"many": 50}


def test_names_of_results_may_clash(spark):
    """Columns named like those of the operators do no harm."""
    names = ["lang_pred", "score", "rejected", "keep", "best", "row", "shard", "slot", "seen", "keys", "key", "hits", "bin", "class", "label", "n", "ids", "text_crc32"]
    docs = spark.createDataFrame([(i, t, "en", "s", *["x"] * len(names)) for i, t in enumerate(TEXTS[:8])], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert lang_id.identify(docs).count() == shards.assign(docs, 24).count() == ngram_join.link_components(docs).count() == decontam.judge(docs, items).count() == licenses.scan(docs).count() == 8
    assert quality.measure(docs, ["doc_id"]).count() == token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 8
    assert bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).columns == [c for c in docs.columns if c != "ids"] + ["ids"]


def test_language_of_many_texts_is_learned_in_one_matrix():
    """A worker that has learned a language stays small: it holds the vectors once, and no counts beside them."""
    texts = pd.Series([" ".join(f"w{k * i % 997}x{i}" for i in range(60)) for k in range(1000)])
    idf = np.linspace(0.1, 3, lang_id.DIMS).astype(np.float32)
    plain = np.stack([lang_id.vector(lang_id.gram_counts(t), idf) for t in texts])
    want = plain[np.linspace(0, 999, 4).astype(int)]
    for _ in range(12):
        near = np.argmax(plain @ want.T, axis=1)
        means = [plain[near == j].mean(axis=0) if (near == j).any() else want[j] for j in range(4)]
        want = np.stack([m / np.linalg.norm(m) for m in means])
    tracemalloc.start()
    got, least = lang_id.learned(texts, idf, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=1e-4, atol=1e-6) and least > 0
    assert peak < 1.3 * plain.nbytes, peak
    assert len(lang_id.learned(pd.Series(["12", "", None], dtype=object), idf, 4)[0]) == 0


def test_language_id_edges(spark, hard):
    got = {r.doc_id: r for r in lang_id.identify(hard.select("doc_id", "text", "lang")).collect()}
    for i, t in enumerate(TEXTS):
        letters = any(c.isalpha() for c in t or "")
        assert got[i].lang_pred == ("xx" if letters else "und") and 0 <= got[i].score <= 1
    assert lang_id.identify(hard.select("doc_id", "text", "lang").limit(0)).count() == 0


def _audited(left, right):
    """What a plain comparison of two lists of (file, id, start, digest, error) finds."""
    def keyed(rows):
        seen, out = {}, {}
        for r in sorted(rows, key=lambda r: (r.file, r.start)):
            k = (r.file, r.id) if r.error is None else (r.file, None, r.start)
            seen[k] = seen.get(k, 0) + 1
            out[*k, seen[k]] = r
        return out

    a, b = keyed(left), keyed(right)
    want = set()
    for k in a.keys() | b.keys():
        x, y = a.get(k), b.get(k)
        kind = "broken" if k[1] is None else "missing" if y is None else "extra" if x is None else "changed" if x.digest != y.digest else "moved" if x.start != y.start else None
        if kind:
            want.add((k[0], kind, x and x.start, y and y.start))
    return want


def test_warc_audit(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    nameless = pages.where("page_id < 7").selectExpr("null as page_id", "url", "cast(null as string) as html", "url as file")
    laid = stored(warc.lay_out(pages.withColumn("file", F.lit("x")).unionByName(nameless).unionByName(pages.where("page_id = 3").withColumn("file", F.lit("y"))), 20))
    whole = laid.select("file", "page_id", warc.record_bytes(laid.page_id, laid.url, laid.html).alias("record"))
    left, right = (stored(warc.facts(warc.read_archives(warc.archives(r)))) for r in (whole, queries.damaged(laid).where("page_id is null or page_id <> 33")))
    want = _audited(left.collect(), right.collect())
    assert {r.kind for r in warc.audit(left, right, 4096, 3).collect()} == {"changed", "moved", "missing", "extra", "broken"}
    assert {(r.file, r.kind, r.left_start, r.right_start) for r in warc.audit(left, right, 4096, 3).collect()} == want
    assert warc.audit(left, left).count() == 0 and warc.audit(left.limit(0), left.limit(0)).count() == 0
    assert warc.audit(left, left.limit(0)).count() == left.count() == pages.count() + 8


def test_warc_files_of_a_hot_id(spark):
    """An id that repeats thousands of times, and pages without one, are spread over files."""
    pages = spark.createDataFrame([(5, f"u{i}", "h") for i in range(3000)] + [(None, f"n{i}", "h") for i in range(900)] + [(i, "u", "h") for i in range(100, 300)], "page_id long, url string, html string")
    files = warc.lay_out(pages, 100).groupBy("file").count().collect()
    assert sum(r["count"] for r in files) == 4100 and max(r["count"] for r in files) < 200 and len(files) > 35


def test_warc_files(spark, tmp_path):
    """Real files, plain and compressed, whole and damaged: what is whole is read, what is not is reported."""
    pages = spark.createDataFrame([(1, "http://a/é", "<p>x</p>"), (2, None, None), (2, None, None), (3, "http://c", "y" * 5000)], "page_id long, url string, html string")
    records = warc.lay_out(pages).select("file", "page_id", warc.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    made = [bytes(r.record) for r in records.orderBy("page_id").collect()]
    for compress in (False, True):
        folder = tmp_path / f"w{compress}"
        warc.write_warc(warc.archives(records), f"file://{folder}", compress)
        rows = sorted(warc.read_warc(spark, str(folder)).collect(), key=lambda r: r.ordinal)
        assert [bytes(r.record) for r in rows] == made and [r.type for r in rows] == ["response"] * 4 and not any(r.error for r in rows)
        assert rows[0].uri == "http://a/é" and rows[1].start == len(made[0]) and rows[0].id == "<urn:page:1>"
    plain = lambda data: [(r[5], r[6]) for r in warc.parse(data)]
    junk, (a, b, _, c) = b"junk \xff", made
    assert plain(a + junk + b + c) == [(None, a), ("no record starts here", junk), (None, b), (None, c)]
    assert plain(a + c[:-100]) == [(None, a), ("truncated", c[:-100])]
    bad = b.replace(b"Content-Length: 0", b"Content-Length: x")
    assert plain(a + bad + c) == [(None, a), ("bad header", bad), (None, c)]
    long = b.replace(b"Content-Length: 0", b"Content-Length: 9")
    assert plain(long + c) == [("bad length", long), (None, c)] and plain(b"") == []
    member = warc._member
    packed = [member(a), member(b)[:-9], member(c), member(a)[:12]]
    got = [(r[5], r[6]) for r in warc.parse_members(b"".join(packed))]
    assert got[0] == (None, a) and got[1][0] in ("bad member", "truncated member") and (None, c) in got and got[-1][0] == "truncated member"
    (tmp_path / "damaged.warc.gz").write_bytes(b"".join(packed))
    assert {r.error is None for r in warc.read_warc(spark, str(tmp_path / "damaged.warc.gz")).collect()} == {True, False}
    assert [r[5] for r in warc.parse_members(member(a + b))] == [None, None]


def test_warc_members_in_linear_time():
    """Twice the bytes take about twice the time, for many small members and for one large one."""
    import random
    import time

    def took(data, n):
        start = time.process_time()
        assert sum(r[5] is None for r in warc.parse_members(data)) == n
        return time.process_time() - start

    body = random.Random(1).randbytes(5000)
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5000\r\n\r\n" + body + b"\r\n\r\n"
    small = warc._member(record)
    for half, n in ((small * 6000, 6000), (warc._member(record * 6000), 6000)):
        first = took(half, n)
        assert took(half * 2, 2 * n) < 2.5 * first + 0.2
