"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Section:
    """Collects the queries of one section; used as a decorator with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def register(function):
            key = name or function.__name__
            self.queries[key] = function
            if sql:
                self.oracles[key] = sql
            return function

        return register

    def sql(self, name: str, text: str, spark_text: str | None = None) -> None:
        """A query that is one SQL statement in both engines."""
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for table in TABLES:
                if table in text:
                    load(spark, sf_dir, table).createOrReplaceTempView(table)
            return spark.sql(spark_text or text)

        self.queries[name] = run
        self.oracles[name] = text


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
