"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """Access to tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return views.spark_view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Source], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = views.duckdb_sql(sql)
        return build

    return register
