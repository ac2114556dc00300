"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barweave.functions.exprs import canonical
from barweave.sources.fixtures import Inputs


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return canonical(self.build(Inputs(spark, sf_dir)))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    from barweave.plans import (  # noqa: F401
        backtests,
        expectancy,
        features,
        forward,
        learning,
        signals,
        sources,
        streams,
    )

    return QUERIES
