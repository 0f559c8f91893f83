"""Registered queries: name -> (plan, reference SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidepanel.plans.views import Views

MODULES = ["ingest", "alignment", "rolling", "sections", "matrices", "rules",
           "strategies", "studies", "latest", "reports", "model", "streams"]
_PLANS: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, reference: str | None = None):
    def register(fn):
        if name in _PLANS:
            raise ValueError(f"query {name} registered twice")
        _PLANS[name] = fn
        if reference:
            _SQL[name] = reference
        return fn
    return register


def reference(name: str) -> str:
    """Reference SQL of a query registered before, for use as a subquery."""
    return _SQL[name]


def _load() -> None:
    for m in MODULES:
        import_module(f"tidepanel.plans.catalog.{m}")


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Views(spark, folder))
    return {name: bind(fn) for name, fn in _PLANS.items()}


def references() -> dict[str, str]:
    _load()
    return dict(_SQL)
