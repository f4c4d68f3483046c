"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and ORACLE_SQL.
MODULES = ["indicator_queries", "rank_queries", "option_queries", "content_queries", "audit_queries", "forecast_queries", "research_queries", "context_queries", "pattern_queries", "landed_queries"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
