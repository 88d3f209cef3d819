"""The register of queries and of the SQL that checks them."""
from __future__ import annotations

import functools
import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recoup.plans.fixture_sql import FIXTURES
from recoup.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ["sources", "verbs", "joins", "aggregates", "windows", "bands", "quality", "profile",
           "outliers", "sampling", "neighbours", "components", "models", "clusters", "boosting", "margins", "linear", "scoring",
           "backtest"]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may use the fixture tables by name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return wrap


def with_fixtures(sql: str) -> str:
    """Prefix the statement with the fixture sub-tables it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in FIXTURES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    head = ",\n".join(f"{n} AS MATERIALIZED ({FIXTURES[n].strip()})" for n in needed)
    if not head:
        return sql
    if re.match(r"(?i)with\s+recursive\s", sql):
        return f"WITH RECURSIVE {head},\n{sql[14:].strip()}"
    if re.match(r"(?i)with\s", sql):
        return f"WITH {head},\n{sql[4:].strip()}"
    return f"WITH {head}\n{sql}"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"recoup.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
