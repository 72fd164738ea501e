"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from reviewlens.plans import feature_queries, report_queries, scoring_queries, text_queries, training_queries

MODULES = [text_queries, feature_queries, scoring_queries, report_queries, training_queries]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
