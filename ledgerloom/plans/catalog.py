"""Queries over the derived books, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Books

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Registers a function of ``Books`` under a name, with its SQL where there is one."""

    def add(build):
        QUERIES[name] = lambda spark, folder: build(Books(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import queries_cash, queries_controls, queries_corrections, queries_coverage, queries_headers, queries_layouts, queries_ledger, queries_mapping, queries_matching, queries_mt940, queries_posting, queries_receivables, queries_registers, queries_relational, queries_reviews, queries_staging, queries_typed  # noqa: F401
