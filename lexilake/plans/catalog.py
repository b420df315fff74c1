"""All registered queries of the library and, for each, the SQL that says what it returns."""

from __future__ import annotations

from lexilake.plans import answer_queries, decision_queries, ingest_queries, library_queries, search_queries

_parts = (search_queries, library_queries, ingest_queries, answer_queries, decision_queries)
QUERIES = {name: query for part in _parts for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _parts for name, sql in part.ORACLE.items()}
