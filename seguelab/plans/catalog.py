"""The registered queries over the driver's tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chains, lists, records, scores, texts

_MODULES = (records, scores, lists, texts, chains)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
