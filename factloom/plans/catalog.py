"""The catalog of registered queries, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.views import view, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The moment at which "now" stands in registered queries.
NOW = "TIMESTAMP '1999-06-01 00:00:00'"


def _counts(sql: str) -> str:
    """DuckDB's count_if gives 128-bit numbers; count over a CASE gives longs as Spark does."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


class World:
    """The tables and views of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("facts", "entities", "edges", "turns", "links", "registry"):
            return view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of a World; sql may use the named views as tables."""

    def register(fn: Callable[[World], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(World(spark, sf_dir))
        if sql is not None:
            head = view_sql(*views.split()) if views else ""
            body = sql.strip()
            if head and body.upper().startswith("WITH RECURSIVE "):
                head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), ", " + body[15:]
            elif head and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLES[name] = _counts(f"{head}\n{body}")
        return fn

    return register
