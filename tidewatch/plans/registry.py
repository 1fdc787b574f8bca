"""Collects the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.views import Domain, sql
from tidewatch.session import tune

DIGITS = 8  # enough that no mean of up to 20 readings lies halfway between two roundings


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Domain], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return self.build(Domain(spark, folder))


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable[[Callable[[Domain], DataFrame]], Callable[[Domain], DataFrame]]:
    """Register a function of the domain under its own name, with its SQL counterpart if there is one."""
    def add(build: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql(oracle) if oracle else None)
        return build
    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the columns, or every double column when none is named."""
    chosen = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, DIGITS) for c in chosen})


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns])
