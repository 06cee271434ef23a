"""Registered queries: a name, a plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers ``plan(tables) -> DataFrame`` under its own name."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return register
