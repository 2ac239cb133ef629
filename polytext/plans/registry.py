"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables.  The oracle SQL runs in DuckDB against the same parquet tables
(registered as views under their table names).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator registering a query builder and its oracle SQL."""

    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


CATALOGS = ("catalog_core", "catalog_synth", "catalog_metrics", "catalog_text", "catalog_tuples", "catalog_codes", "catalog_contamination", "catalog_tokens", "catalog_langid", "catalog_io",
            "catalog_stream", "catalog_more", "catalog_batching", "catalog_scoring")


def _load_all() -> None:
    # Importing the catalog modules fills the registry.
    for mod in CATALOGS:
        importlib.import_module(f"polytext.plans.{mod}")


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
