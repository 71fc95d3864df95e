"""Every query of the library by name, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrule.sources.views import view, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def operator(name: str, inputs: list[str], oracle: str | None = None, also: tuple[str, ...] = (), **options):
    """Registers an operator under a query name: its inputs are views, its oracle SQL over the same views (and those in ``also``)."""
    def add(f):
        _QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in inputs], **options)
        if oracle:
            _SQL[name] = with_views([*inputs, *also], oracle)
        return f

    return add


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Registers a (spark, sf_dir) function under a query name."""
    def add(f):
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = with_views(views, oracle)
        return f

    return add


def _load() -> None:
    from ferrule.operators import load

    load()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
