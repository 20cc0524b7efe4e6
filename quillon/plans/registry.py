"""All queries over the scheduling tables, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.views import oracle, view

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
MODULES = ("dispatching", "listing", "scheduling", "admitting", "observing", "operating", "streams")


class Tables:
    """Views by attribute: ``t.jobs`` is the view ``jobs`` of the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None, reads: str = ""):
    """Registers a function of Tables under its name; ``sql`` runs over the views named in ``reads``."""

    def register(f: Callable[[Tables], DataFrame]):
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _sql[f.__name__] = oracle(sql, *reads.split())
        return f

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"quillon.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
