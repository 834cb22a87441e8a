"""The engine: a catalog of tables and a graph, and one entry point for statements."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from strataflow.model import Graph
from strataflow.plans import ast as A
from strataflow.plans.compiler import Compiler
from strataflow.plans.parser import parse
from strataflow.sources.tables import TableStore

#: Settings that results depend on, or that plans count on; session() applies them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
MAX_STATEMENT = 4096


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("strataflow")
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class Engine:
    """Runs statements over registered DataFrames, stored tables and a graph.

    ``compat`` reproduces the older executors' value semantics; ``now`` fixes the time that now(), ago()
    and WHEN LAST mean (nanoseconds), else each statement takes the clock's; ``max_rows`` caps results.
    """

    def __init__(self, spark: SparkSession, graph: Graph | None = None, tables: dict[str, DataFrame] | None = None, store: TableStore | None = None,
                 compat: bool = False, now: int | None = None, max_rows: int | None = None):
        self.spark, self.graph, self.registered, self.store = spark, graph, dict(tables or {}), store
        self.compat, self.now, self.max_rows = compat, now, max_rows
        self.subscriptions: dict = {}

    def register(self, name: str, df: DataFrame) -> "Engine":
        self.registered[name] = df
        return self

    def _clock(self) -> int:
        return self.now if self.now is not None else time.time_ns()

    def _compiler(self) -> Compiler:
        tables = dict(self.registered)
        if self.store is not None:
            tables |= {n: self.store.read(n) for n in self.store.names()}
        return Compiler(self.spark, self.graph, tables, self._clock(), self.compat, self.max_rows)

    def query(self, text: str) -> DataFrame:
        """The result of a MATCH or FROM query, lazily."""
        q = parse(text)
        if not isinstance(q, A.Query):
            raise ValueError("not a query; use execute()")
        return self._compiler().compile(q)

    def execute(self, text: str):
        """Any statement. Queries give a DataFrame, SUBSCRIBE a Subscription, changes the number of rows."""
        s = parse(text)
        if isinstance(s, A.Query):
            return self._compiler().compile(s)
        if isinstance(s, A.Subscribe):
            from strataflow.streaming.subscriptions import Subscription

            sub = Subscription(self, s.query, max(self.subscriptions, default=0) + 1)
            self.subscriptions[sub.id] = sub
            return sub
        if isinstance(s, A.Unsubscribe):
            return self.subscriptions.pop(s.id, None) is not None
        if self.store is None:
            raise ValueError("this engine has no table store")
        return self.store.apply(s, self._clock())
