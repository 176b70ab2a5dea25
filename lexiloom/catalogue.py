"""All registered queries of the library; importing the modules registers them."""

from lexiloom import more_queries, queries, source_queries, state_queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "more_queries", "source_queries", "state_queries"]
