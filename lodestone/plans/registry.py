"""Every query of the core package by name, with the SQL that checks it."""

from __future__ import annotations

from . import arrays, audit, batches, evaluate, explain, groups, images, integrity, sections, similarity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (audit, similarity, groups, arrays, evaluate, explain, integrity, images, sections, batches):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL
