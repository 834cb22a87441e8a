"""The registry of queries and their SQL, and what the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.model import commerce_graph, event_versions, nanos, node_id, table
from strataflow.session import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: now() of the queries: 2024-02-01.
NOW = 1706745600 * 10**9
SPAN = 10**12


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The relational tables, times as nanoseconds; a plan reads only those that it names."""
    out = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part")}
    out["orders"] = table(spark, sf_dir, "orders").withColumn("o_orderdate", nanos(F.col("o_orderdate")))
    out["lineitem"] = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", nanos(F.col("l_shipdate")))
    out["events"] = table(spark, sf_dir, "events").withColumn("ts", nanos(F.col("ts")))
    return out


def relational(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, tables=tables(spark, sf_dir), now=NOW)


def versioned(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, tables={"user_state": event_versions(spark, sf_dir)}, now=NOW)


def graph(spark: SparkSession, sf_dir: str) -> Engine:
    accounts = table(spark, sf_dir, "customer").select(node_id("customer", F.col("c_custkey")).alias("node"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return Engine(spark, commerce_graph(spark, sf_dir), {"accounts": accounts}, now=NOW)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


def tql(name: str, engine: Callable, text: str, sql: str | None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a query given in the query language."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).query(text)
        return df if finish is None else finish(df)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql
