"""Every named query of the engine and its DuckDB SQL. Importing the operator modules fills both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derive import derived, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "fn06_bm25"


def register(name: str, tables: str, plan: Callable[..., DataFrame], sql: str | None = None) -> None:
    """``plan`` takes the named tables, driver or derived, as DataFrames; ``sql`` is read by DuckDB over the same."""
    names = tuple(tables.split())
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plan(*[derived(spark, sf_dir, t) for t in names])
    if sql:
        ORACLE_SQL[name] = with_tables(names, sql)


def rounded(x: Column, places: int = 4) -> Column:
    """Half up on the scaled value, which both engines compute alike."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def _fill() -> None:
    import importlib

    for module in ("operators.trace", "operators.evals", "operators.search", "operators.retrieval", "operators.cards", "operators.steps", "operators.filters", "operators.ledger", "operators.renderers", "operators.metering", "operators.meters", "operators.runs", "operators.surface", "functions.scalars", "functions.pages", "functions.retries", "sources.catalog", "sources.connectors", "sources.fetching", "sources.researchers", "sources.registries", "streaming.journal", "streaming.hub", "streaming.subscribe", "streaming.reserve"):
        importlib.import_module(f"tessella.{module}")


def load() -> None:
    if not QUERIES:
        _fill()
