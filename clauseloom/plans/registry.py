"""The register of whole-table queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under the name of its operators."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add


def scalar(name: str, table: str, key: str, exprs: dict[str, Column], sql: str | None = None, where: str | None = None) -> None:
    """Registers a projection of one table."""

    def run(t: Tables) -> DataFrame:
        df = getattr(t, table)
        return (df.where(where) if where else df).select(key, *[c.alias(n) for n, c in exprs.items()])

    QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
    if sql:
        SQL[name] = f"SELECT {key}, {sql} FROM {table}" + (f" WHERE {where}" if where else "")


def digest(c: Column) -> Column:
    """A text column as its MD5, to keep results small."""
    return F.md5(F.encode(c, "UTF-8"))
