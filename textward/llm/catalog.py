"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "simhash", "warc", "token_count", "packing", "media", "repeats", "secrets", "language", "licenses", "whitening", "id_files", "search")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
