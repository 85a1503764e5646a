"""Named queries over the supplied tables, each beside the SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import Tables

_FRAMES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL text if there is one."""

    def register(fn):
        if name in _FRAMES:
            raise ValueError(f"query {name} is registered twice")
        _FRAMES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


def _load() -> None:
    for section in iter_modules(__path__):
        import_module(f"{__name__}.{section.name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _FRAMES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
