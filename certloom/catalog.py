"""All queries over the given tables, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


for _name in ("capture", "metrics", "relational", "names", "pages", "graph", "plans", "evidence", "mail", "datasets", "signals", "lookups", "forms", "triage", "exfil", "letters", "enrichment", "diagnosis"):
    import_module(f"certloom.operators.{_name}")
import_module("certloom.sources.landed")
import_module("certloom.sources.followed")
