"""All queries of the library, and their SQL."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function under a name."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    """Imports the modules whose queries register themselves."""
    for name in ("basics", "matching", "evaluating", "topic_queries", "graph_queries", "rule_queries", "report_queries", "case_queries", "catalogue_stages"):
        importlib.import_module(f"matchloom.plans.{name}")


def queries() -> dict:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
