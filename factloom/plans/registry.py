"""All queries of the memory engine, by operator id, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.model import Store, with_model

_queries: dict[str, Callable[[Store], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over the store, and the DuckDB text that gives the same rows."""

    def put(function: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return put


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    from factloom.plans import aggregates, claims, contexts, experiments, lifecycle, more, relational, retrieval, streams, texts  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Store(spark, sf_dir))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_model(sql) for name, sql in _sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["R12_hybrid_search"](Store(spark, sf_dir))
