"""Queries of the operators, one opN_<name> each, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from llm import queries  # noqa: F401

    return QUERIES
