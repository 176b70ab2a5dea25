"""The driver contract."""

import sys

import __spark_entry__ as entry
from lexiloom.catalogue import ORACLES, QUERIES


def test_every_query_of_the_library_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_parts_are_left_out(monkeypatch):
    monkeypatch.setitem(sys.modules, "lexiloom.llm.queries", None)  # importing it raises ModuleNotFoundError
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
