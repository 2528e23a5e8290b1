"""The registered queries and the SQL that gives the same rows."""

from pairloom.plans import decision_queries, selection_queries, stream_queries, text_queries

_PARTS = (selection_queries, text_queries, decision_queries, stream_queries)
QUERIES = {name: f for p in _PARTS for name, f in p.QUERIES.items()}
ORACLES = {name: sql for p in _PARTS for name, sql in p.ORACLES.items()}
