"""All queries of the annotation engine, and their SQL."""

from __future__ import annotations

from strandline.plans import evidence_queries, names_queries

QUERIES = names_queries.QUERIES | evidence_queries.QUERIES
SQL = names_queries.SQL | evidence_queries.SQL
