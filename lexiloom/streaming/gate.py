"""The gate against duplicates over time: one state for each topic and exam.

Candidates (at, exam, topic, slug) come in any order within the watermark's
delay.  A key keeps those whose time the watermark has not passed yet; when it
does, they are judged in the order of time and slug: the first of a key is
accepted and all others within ``keep`` of the last accepted one are
duplicates.  ``keep`` after that the key is forgotten.  So replayed or reordered
files give the verdicts that ``judge``, the same rule over a table, gives.

Null exams and topics are values like any other; a null time is never judged
and a null slug sorts first.  Rows that are later than the watermark's delay are
dropped by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexiloom.session import ship_code

VERDICTS = "exam string, topic string, at timestamp, slug string, verdict string"


def verdicts(waiting: list[tuple[datetime, str]], last: datetime | None, keep: timedelta) -> tuple[list[tuple[datetime, str, str]], datetime | None]:
    """The verdicts of a key's candidates (at, slug), which are all those up to some time, and the time of the last one accepted."""
    out = []
    for at, slug in sorted(waiting, key=lambda w: (w[0], w[1] or "")):
        accepted = last is None or at >= last + keep
        out.append((at, slug, "accepted" if accepted else "duplicate"))
        last = at if accepted else last
    return out, last


class Gate(StatefulProcessor):
    def __init__(self, keep: timedelta) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType().add("at", "timestamp").add("slug", "string"))
        self.last = handle.getValueState("last", T.StructType().add("at", "timestamp"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for at, slug in zip(batch["at"], batch["slug"], strict=True):
                if pd.notna(at):
                    self.waiting.appendValue((at.to_pydatetime(), None if pd.isna(slug) else slug))
                    self.handle.registerTimer(_millis(at))
        yield pd.DataFrame(columns=["exam", "topic", "at", "slug", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Judges all that the watermark has passed, whichever of their timers fires first; the other timers find nothing left."""
        passed = timerValues.getCurrentWatermarkInMs()
        held = [(r[0], r[1]) for r in self.waiting.get()]
        due, left = ([w for w in held if (_millis(w[0]) <= passed) is gone] for gone in (True, False))
        before = self.last.get()[0] if self.last.exists() else None
        made, last = verdicts(due, before, self.keep)
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if last is not None and not left and _millis(last + self.keep) <= passed:
            self.last.clear()  # nothing can be a duplicate of it any more
        elif last != before:
            self.last.update((last,))
            self.handle.registerTimer(_millis(last + self.keep))
        yield pd.DataFrame([(key[0], key[1], *m) for m in made], columns=["exam", "topic", "at", "slug", "verdict"])

    def close(self) -> None:
        pass


def _millis(at: datetime) -> int:
    """The millisecond by which a time has passed; times without a zone are those of the session's zone, which must be UTC."""
    return math.ceil((at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at).timestamp() * 1000)


def gate(candidates: DataFrame, keep: timedelta = timedelta(days=30), late: str = "1 day") -> DataFrame:
    """exam, topic, at, slug, verdict of a stream of candidates, each once the watermark has passed it."""
    spark = candidates.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = candidates.select("exam", "topic", "at", "slug").withWatermark("at", late).groupBy("exam", "topic")
    return keyed.transformWithStateInPandas(Gate(keep), VERDICTS, "Append", "EventTime")


def judge(candidates: DataFrame, keep: timedelta = timedelta(days=30)) -> DataFrame:
    """The same verdicts of a table of candidates.

    A key's candidates pass a task one after the other, in their order, and
    only the last one accepted is remembered, so no key has to fit into memory.
    """
    ship_code(candidates.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            made = []
            text = lambda c: batch[c].astype(object).where(batch[c].notna(), None)  # noqa: B023, E731
            for exam, topic, at, slug in zip(text("exam"), text("topic"), batch["at"], text("slug"), strict=True):
                if (exam, topic) != key:
                    key, last = (exam, topic), None
                (one,), last = verdicts([(at, slug)], last, keep)
                made.append(one[2])
            yield batch.assign(verdict=made)

    rows = candidates.select("exam", "topic", "at", "slug").where("at is not null")
    return rows.repartition("exam", "topic").sortWithinPartitions("exam", "topic", "at", F.coalesce("slug", F.lit(""))).mapInPandas(run, VERDICTS)
