"""Registered queries over the given tables, and the SQL that states what each returns."""

from __future__ import annotations

from textward.plans import conversations, decoding, records, scans, scores, streams, structure, vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (scans, scores, conversations, vectors, decoding, streams, records, structure):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
