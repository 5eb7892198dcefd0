"""Every registered query of the engine, with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import evidence_queries, page_queries, relational_queries, stateful_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (relational_queries, stateful_queries, evidence_queries, page_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
