"""States that add up, tables in buckets, and streams that are resumed."""

import math
import random
import statistics as stats
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import states
from lexiloom.sources import buckets, files
from lexiloom.streaming import gate


def test_states_add_up(spark):
    """Any split of the records gives the same figures as the records themselves."""
    draw = random.Random(4)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=draw.randint(0, 2000)), f"g{i % 3}" if i % 11 else None, f"u{draw.randint(0, 400)}" if i % 13 else None, None if i % 17 == 0 else math.nan if i % 19 == 0 else draw.gauss(5, 2)) for i in range(4000)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, user_id string, value double").withColumn("nr", F.monotonically_increasing_id())
    parts = [states.daily(events.where(F.col("nr") % 3 == k), "ts", ["kind"], "user_id", "value") for k in range(3)]
    split = parts[0].union(parts[1]).union(parts[2])
    span = F.when(F.col("day") < date(2024, 2, 1), "january").otherwise("later").alias("span")
    got = {(r.kind, r.span): r for r in states.figures(split, ["kind", span]).collect()}
    assert len(got) == 8
    for (kind, name), r in got.items():
        own = [x for x in rows if x[1] == kind and (x[0] < datetime(2024, 2, 1)) == (name == "january")]
        numbers = [((x[0].date() - date(2020, 1, 1)).days, x[3]) for x in own if x[3] is not None and not math.isnan(x[3])]
        assert r.n == len(own) and r.average == pytest.approx(stats.fmean(y for _, y in numbers))
        slope = stats.linear_regression([x for x, _ in numbers], [y for _, y in numbers]).slope
        assert r.slope == pytest.approx(slope, abs=1e-9)
        exact = len({x[2] for x in own if x[2] is not None})
        assert abs(r.distinct - exact) <= max(1, 5 * 1.04 / 2 ** (states.LG / 2) * exact)
        assert abs(sum(y <= r.median for _, y in numbers) / len(numbers) - 0.5) < 0.07


def test_states_edges(spark):
    day = datetime(2024, 5, 1)
    rows = [(day, "one", None, None), (day, "flat", "a", 1.0), (day, "flat", "a", 3.0), (None, "none", "b", 2.0)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, user_id string, value double")
    got = {r.kind: r for r in states.figures(states.daily(events, "ts", ["kind"], "user_id", "value"), ["kind"]).collect()}
    assert (got["one"].n, got["one"].average, got["one"].slope, got["one"].distinct, got["one"]["median"]) == (1, None, None, 0, None)
    assert (got["flat"].average, got["flat"].slope, got["flat"].distinct) == (2.0, None, 1) and got["none"].n == 1
    assert states.figures(states.daily(events.limit(0), "ts", ["kind"], "user_id", "value"), ["kind"]).count() == 0


def test_bucket_upserts(spark, tmp_path):
    """Buckets that do not change keep their files; records are those of the whole table's upsert."""
    target = f"file://{tmp_path}/t"
    schema = "id long, v string, derived boolean"
    with pytest.raises(FileNotFoundError):
        buckets.records(spark, target)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda: sorted(map(tuple, buckets.records(spark, target).select("id", "v", "derived").collect()), key=str)
    old = [(i, f"old{i}", i % 2 == 0) for i in range(100)] + [(None, "no id", None)]
    assert len(buckets.upsert(spark, target, frame(old), buckets=8)) == 9
    assert rows() == sorted(old, key=str)
    before = {r.bucket: r.path for r in buckets.manifest(spark, target)}
    assert buckets.upsert(spark, target, frame([(5, "new", True), (6, "new", True)])) == []
    changed = buckets.upsert(spark, target, frame([(200, "new", True), (5, "new", True)]))
    after = {r.bucket: r.path for r in buckets.manifest(spark, target)}
    assert len(changed) == 1 and {b for b in after if after[b] != before[b]} == set(changed)
    assert rows() == sorted([*old, (200, "new", True)], key=str)
    buckets.upsert(spark, target, frame([(6, "forced", True), (7, "forced", True), (200, "again", True)]), force=True)
    want = [(i, "forced" if i == 6 else v, d) for i, v, d in old] + [(200, "again", True)]
    assert rows() == sorted(want, key=str)
    wider = spark.createDataFrame([(300, "x", True, 1.5)], schema + ", extra double")
    buckets.upsert(spark, target, wider)
    assert buckets.records(spark, target).where("extra = 1.5").count() == 1 and buckets.records(spark, target).count() == 103


def test_report_pages(spark, tmp_path):
    """Pages that land between runs are read once, empty and broken ones are known as such."""
    def land(day, page, content):
        folder = tmp_path / "in" / f"day={day}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"page-{page}.json").write_text(content)

    def run():
        query = files.report_pages(spark, str(tmp_path / "in"), stream=True).writeStream.format("json").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()
        found = spark.read.schema("day string, page int, query string, clicks double, empty boolean, error boolean").json(str(tmp_path / "out"))
        return sorted(map(tuple, found.collect()), key=str)

    row = '{"rows": [{"keys": ["%s", "x"], "clicks": 2}, {"clicks": null}]}'
    assert files.report_pages(spark, str(tmp_path / "in")).count() == 0
    land("2026-01-01", 0, row % "a")
    land("2026-01-01", 1, "{}")
    first = [("2026-01-01", 0, "a", 2.0, False, False), ("2026-01-01", 0, None, None, False, False), ("2026-01-01", 1, None, None, True, False)]
    assert run() == first == run()
    land("2026-01-01", 10, row % "b")
    land("2026-01-02", 0, "[no json")
    land("2026-01-02", 2, "[1]")
    (tmp_path / "in" / "other.txt").write_text("x")
    second = [*first, ("2026-01-01", 10, "b", 2.0, False, False), ("2026-01-01", 10, None, None, False, False), *[("2026-01-02", p, None, None, False, True) for p in (0, 2)]]
    assert run() == sorted(second, key=str)
    assert files.report_pages(spark, str(tmp_path / "in")).count() == 7


def _gated(spark, folder, batches):
    """The verdicts of a stream of batches, one file each, and of one far later candidate that moves the watermark."""
    schema = "exam string, topic string, at timestamp, slug string"
    (folder / "in").mkdir(parents=True)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = gate.gate(stream, timedelta(minutes=10), "1 hour").writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).start(str(folder / "out"))
    try:
        for n, batch in enumerate([*batches, [("end", "end", datetime(2030, 1, 1), "z")]]):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(folder / f"b{n}"))
            for part in (folder / f"b{n}").glob("part*"):
                part.rename(folder / "in" / f"{n}.parquet")
            query.processAllAvailable()
    finally:
        query.stop()
    found = spark.read.schema(gate.VERDICTS).parquet(str(folder / "out"))
    return sorted((r.exam, r.topic, r.at, r.slug, r.verdict) for r in found.where("exam <> 'end'").collect())


def test_streamed_gate_does_not_depend_on_order(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("e", "t", start + timedelta(minutes=m), s) for m, s in ((0, "a"), (4, "b"), (9, "c"), (10, "d"), (10, "e"), (25, "f"), (26, "g"), (26, "g"))]
    rows += [("e", "u", start + timedelta(minutes=m, microseconds=500), s) for m, s in ((3, "a"), (40, "b"))] + [("x", "t", start, "only")]
    batch = sorted((r.exam, r.topic, r.at, r.slug, r.verdict) for r in gate.judge(spark.createDataFrame(rows, "exam string, topic string, at timestamp, slug string"), timedelta(minutes=10)).collect())
    assert [v[3:] for v in batch if v[1] == "t" and v[0] == "e"] == [("a", "accepted"), ("b", "duplicate"), ("c", "duplicate"), ("d", "accepted"), ("e", "duplicate"), ("f", "accepted"), ("g", "duplicate"), ("g", "duplicate")]
    assert _gated(spark, tmp_path / "one", [rows[:4], rows[4:]]) == batch
    assert _gated(spark, tmp_path / "two", [rows[::-1][:5], rows[::-1][5:7], rows[::-1][7:]]) == batch


def test_gate_edges(spark):
    rows = [(None, None, datetime(2024, 1, 1), None), (None, None, datetime(2024, 1, 1), "a"), ("e", "t", None, "x")]
    made = gate.judge(spark.createDataFrame(rows, "exam string, topic string, at timestamp, slug string")).collect()
    assert [(r.slug, r.verdict) for r in made] == [(None, "accepted"), ("a", "duplicate")]
