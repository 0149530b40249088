"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from barline.plans import bar_queries, event_queries, text_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (bar_queries, text_queries, event_queries):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
