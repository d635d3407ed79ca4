"""All queries of the library proper, by operator id."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalogue import Catalogue

Query = Callable[[SparkSession, str], DataFrame]

#: One module per section of the operator inventory.
MODULES = ("q_filters", "q_joins", "q_aggregates", "q_windows", "q_topk", "q_sets", "q_similarity", "q_evaluation", "q_geometry", "q_sources", "q_parsing", "q_quality", "q_text", "q_recommend", "q_resolve", "q_extra")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a Catalogue as a query, with the SQL that must give the same rows."""

    def add(f: Callable[[Catalogue], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered already")
        _QUERIES[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"sparkloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
