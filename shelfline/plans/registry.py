"""Registry of named queries: an operator bound to the canonical tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import rounded
from ..sources.tables import Tables
from .sqltext import with_tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS: dict[str, int] = {}


AREAS = [
    "sales", "marketing", "inventory", "performance", "attribution", "snapshot",
    "features", "quality", "validation", "kpi", "feeds",
]


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(fn):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = fn
        DIGITS[name] = digits
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for area in AREAS:
        import_module(f"{__package__}.{area}")


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(PLANS[name](Tables(spark, sf_dir)), DIGITS[name])

    run.__name__ = name
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {n: runner(n) for n in PLANS}


def all_sql() -> dict[str, str]:
    load()
    return {n: with_tables(s) for n, s in ORACLES.items()}
