"""All registered queries and their SQL."""

from __future__ import annotations

from checks import rules, runs, scores, windows

_PARTS = (rules, windows, scores, runs)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
flagship = scores.query_explanations
