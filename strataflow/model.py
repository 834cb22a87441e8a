"""Canonical schemas, and the graph over relational tables that the queries run on.

All times are BIGINT nanoseconds since the epoch; a null bound is open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = (
    "id BIGINT, node_type STRING, concept_type STRING, label STRING, created_at BIGINT, updated_at BIGINT, "
    "group_id STRING, confidence DOUBLE, props MAP<STRING,STRING>"
)
HISTORY = "ARRAY<STRUCT<t:BIGINT,v:DOUBLE>>"
EDGES = (
    "id BIGINT, source BIGINT, target BIGINT, edge_kind STRING, assoc_type STRING, weight DOUBLE, confidence DOUBLE, "
    "cost_signal DOUBLE, created_at BIGINT, updated_at BIGINT, valid_from BIGINT, valid_until BIGINT, is_valid BOOLEAN, "
    f"observation_count INT, group_id STRING, props MAP<STRING,STRING>, confidence_history {HISTORY}, weight_history {HISTORY}"
)
SYSTEM_COLUMNS = ("_row_id", "_version_id", "_group_id", "_valid_from", "_valid_until", "_created_at")
NODE_TYPES = ("Agent", "Event", "Context", "Concept", "Goal", "Episode", "Memory", "Strategy", "Tool", "Result", "Claim")
EDGE_KINDS = (
    "Causality", "Temporal", "Contextual", "Interaction", "GoalRelation", "Association", "Communication", "DerivedFrom", "SupportedBy", "CodeStructure", "About",
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the given schema: columns that it lacks are null, others are cast or left out."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(ddl)))


@dataclass(frozen=True)
class Graph:
    """Nodes and edges, both conforming."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> "Graph":
        return Graph(conform(nodes, NODES), conform(edges, EDGES))


def nanos(ts: Column) -> Column:
    """Nanoseconds of a timestamp (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("long")


def to_timestamp(n: Column) -> Column:
    """Timestamp of nanoseconds; what is below a microsecond goes."""
    return F.timestamp_micros(F.expr("0") + F.floor(n / 1000).cast("long"))


#: Node ids are kind * 10**12 + key.
KINDS = {"customer": 1, "order": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6, "user": 7, "event": 8, "event_type": 9}
SPAN = 10**12


def node_id(kind: str, key: Column) -> Column:
    return (F.lit(KINDS[kind] * SPAN) + key.cast("long")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions with their relations.

    Only columns that a query uses are read: every piece is a projection of its table.
    """
    t = lambda name: table(spark, sf_dir, name)
    none = F.lit(None)

    def nodes(df: DataFrame, kind: str, key: str, label: Column, created: Column, **props: Column) -> DataFrame:
        pairs = [x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]
        return df.select(
            node_id(kind, F.col(key)).alias("id"), F.lit("Concept").alias("node_type"), F.lit(kind.capitalize()).alias("concept_type"), label.alias("label"),
            created.cast("long").alias("created_at"), created.cast("long").alias("updated_at"), none.cast("string").alias("group_id"), F.lit(1.0).alias("confidence"),
            (F.create_map(*pairs) if pairs else none.cast("map<string,string>")).alias("props"),
        )

    zero = F.lit(0)
    all_nodes = [
        nodes(t("customer"), "customer", "c_custkey", F.col("c_name"), zero, segment=F.col("c_mktsegment"), acctbal=F.col("c_acctbal")),
        nodes(t("orders"), "order", "o_orderkey", F.col("o_orderkey").cast("string"), nanos(F.col("o_orderdate")), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")),
        nodes(t("part"), "part", "p_partkey", F.col("p_name"), zero, brand=F.col("p_brand"), type=F.col("p_type"), size=F.col("p_size")),
        nodes(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), zero, acctbal=F.col("s_acctbal")),
        nodes(t("nation"), "nation", "n_nationkey", F.col("n_name"), zero),
        nodes(t("region"), "region", "r_regionkey", F.col("r_name"), zero),
    ]

    def edges(df: DataFrame, source: Column, target: Column, assoc: str, since: Column, until: Column, weight: Column, number: Column) -> DataFrame:
        return df.select(
            number.cast("long").alias("id"), source.alias("source"), target.alias("target"), F.lit("Association").alias("edge_kind"), F.lit(assoc).alias("assoc_type"),
            weight.cast("double").alias("weight"), F.lit(1.0).alias("confidence"), weight.cast("double").alias("cost_signal"),
            F.coalesce(since, zero).cast("long").alias("created_at"), F.coalesce(since, zero).cast("long").alias("updated_at"), since.cast("long").alias("valid_from"), until.cast("long").alias("valid_until"),
            F.lit(True).alias("is_valid"), F.lit(1).alias("observation_count"), none.cast("string").alias("group_id"), none.cast("map<string,string>").alias("props"),
            none.cast(HISTORY).alias("confidence_history"), none.cast(HISTORY).alias("weight_history"),
        )

    from pyspark.sql import Window

    orders = t("orders").withColumn("_from", nanos(F.col("o_orderdate")))
    following = F.lead("_from").over(Window.partitionBy("o_custkey").orderBy("_from", "o_orderkey"))
    items = t("lineitem").withColumn("_from", nanos(F.col("l_shipdate")))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    one = F.lit(1.0)
    all_edges = [
        edges(orders.withColumn("_until", following), node_id("customer", F.col("o_custkey")), node_id("order", F.col("o_orderkey")), "commerce:placed", F.col("_from"), F.col("_until"), one, SPAN + F.col("o_orderkey")),
        edges(items, node_id("order", F.col("l_orderkey")), node_id("part", F.col("l_partkey")), "commerce:contains", F.col("_from"), none.cast("long"), F.col("l_discount"), 2 * SPAN + line),
        edges(items, node_id("part", F.col("l_partkey")), node_id("supplier", F.col("l_suppkey")), "commerce:supplied_by", F.col("_from"), none.cast("long"), F.col("l_discount"), 3 * SPAN + line),
        edges(t("customer"), node_id("customer", F.col("c_custkey")), node_id("nation", F.col("c_nationkey")), "location:in_nation", none.cast("long"), none.cast("long"), one, 4 * SPAN + F.col("c_custkey")),
        edges(t("supplier"), node_id("supplier", F.col("s_suppkey")), node_id("nation", F.col("s_nationkey")), "location:in_nation", none.cast("long"), none.cast("long"), one, 5 * SPAN + F.col("s_suppkey")),
        edges(t("nation"), node_id("nation", F.col("n_nationkey")), node_id("region", F.col("n_regionkey")), "location:in_region", none.cast("long"), none.cast("long"), one, 6 * SPAN + F.col("n_nationkey")),
    ]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return Graph(union(all_nodes), union(all_edges))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a versioned table: one row per user, a version per event."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("_valid_from", nanos(F.col("ts")))
    after = F.lead("_valid_from").over(Window.partitionBy("user_id").orderBy("_valid_from", "event_id"))
    return e.select(
        F.col("user_id").alias("_row_id"), F.col("event_id").alias("_version_id"), F.lit(0).cast("long").alias("_group_id"), "_valid_from", after.alias("_valid_until"),
        F.col("_valid_from").alias("_created_at"), "event_id", "user_id", "event_type", "value", "props",
    )
