"""All queries of the search engine with their SQL."""

from __future__ import annotations

import importlib

from .common import ORACLE_SQL, QUERIES

MODULES = ("storage", "facets", "searching", "dataflow", "federated", "flows", "rewriting", "stores")

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
