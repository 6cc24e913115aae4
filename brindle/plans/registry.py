"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for work that is dear by the row: rows of files that are cut into fewer parts than cores are dealt out."""
        df, cores = getattr(self, name).select(*columns), self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query and, where SQL can express it, the SQL that DuckDB checks it by."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put


def same(name: str, of: str) -> None:
    """Registers a query under a second name: one operator that an inventory lists twice."""
    QUERIES[name] = QUERIES[of]
    if of in SQL:
        SQL[name] = SQL[of]
