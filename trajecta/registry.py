"""A query is a Spark callable plus, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trajecta.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a file or a directory of files, whichever is there."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Registry:
    """Named queries in the order in which they were added."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep
