"""Measures of whole graphs, and filters of nodes and edges by specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.operators import components, paths


@shared.tidy
def path_lengths(nodes: DataFrame, edges: DataFrame, samples: int = 100) -> DataFrame:
    """(start, node, depth): hops from each of the ``samples`` nodes of the least ids to those of larger ids among them."""
    some = shared.cut(nodes.select(F.col("id").alias("start")).distinct().orderBy("start").limit(samples), "samples")
    depths = paths.reach(edges, some, 1, None)
    return depths.join(F.broadcast(some.select(F.col("start").alias("node"))), "node", "left_semi").where("start < node").select("start", "node", "depth")


@shared.tidy
def graph_metrics(nodes: DataFrame, edges: DataFrame, length_samples: int = 100, diameter_samples: int = 50) -> DataFrame:
    """One row: nodes, edges, components, largest_component, average_path_length, diameter, average_degree, density.

    Components take edges both ways. Lengths are directed hops between pairs of the sampled nodes that have a path;
    no pair gives 0. The samples are parameters, and bound the search to so many starts.
    """
    sizes = components.connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest_component"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nodes"))
    lengths = shared.cut(path_lengths(nodes, edges, max(length_samples, diameter_samples)), "lengths")

    def among(samples: int) -> DataFrame:
        ids = nodes.select(F.col("id").alias("node")).distinct().orderBy("node").limit(samples)
        return lengths.join(F.broadcast(ids), "node", "left_semi")

    mean = among(length_samples).agg(F.coalesce(F.avg("depth"), F.lit(0.0)).alias("average_path_length"))
    high = among(diameter_samples).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("diameter"))
    out = shape.join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(mean)).join(F.broadcast(high))  # one row each
    n = F.col("nodes")
    return out.select(
        "nodes", "edges", "components", "largest_component", "average_path_length", "diameter",
        F.when(n > 0, 2.0 * F.col("edges") / n).otherwise(0.0).alias("average_degree"), F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
    )


# ---- filters by specification


def by_type(*names: str) -> Column:
    """Nodes of these node or concept types, in any case."""
    low = [n.lower() for n in names]
    return F.lower("node_type").isin(low) | F.lower("concept_type").isin(low)


def created(after: int | None = None, before: int | None = None) -> Column:
    """Nodes or edges created after, and before, a time."""
    c = F.lit(True) if after is None else F.col("created_at") > after
    return c if before is None else c & (F.col("created_at") < before)


def edges_of(edges: DataFrame, kind: str | None = None, min_weight: float | None = None, min_confidence: float | None = None) -> DataFrame:
    """Edges by type (exact, or a category's prefix), least weight and confidence."""
    out = edges
    if kind is not None:
        low = F.lower("assoc_type")
        out = out.where((low == kind.lower()) | F.startswith(low, F.lit(kind.lower() + ":")) | (F.lower("edge_kind") == kind.lower()))
    out = out if min_weight is None else out.where(F.col("weight") >= min_weight)
    return out if min_confidence is None else out.where(F.col("confidence") >= min_confidence)


def with_degree(nodes: DataFrame, edges: DataFrame, least: int, direction: str = "both") -> DataFrame:
    """Nodes with ``least`` edges or more, out, in or both ways."""
    if least <= 0:
        return nodes
    ends = paths.directed(edges, direction).groupBy(F.col("source").alias("_id")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return nodes.join(ends, nodes["id"] == ends["_id"], "left_semi")


def by_property(nodes: DataFrame, key: str, equal=None, low=None, high=None, contains: list[str] = ()) -> DataFrame:
    """Nodes by a property: equal to a value, within inclusive bounds (as numbers), or with all of some words in any case."""
    value = F.try_element_at("props", F.lit(key))
    out = nodes.where(value.isNotNull())
    if equal is not None:
        out = out.where(value == str(equal))
    if low is not None:
        out = out.where(value.try_cast("double") >= float(low))
    if high is not None:
        out = out.where(value.try_cast("double") <= float(high))
    if contains:
        words = F.filter(F.split(F.lower(value), "[^a-z0-9]+"), lambda w: w != "")
        out = out.where(F.size(F.array_except(F.array(*[F.lit(w.lower()) for w in contains]), words)) == 0)
    return out


# ---- aggregates of a graph


def count_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("concept_type", "node_type").alias("type")).agg(F.count("*").alias("n"))


def property_aggregate(nodes: DataFrame, key: str, kind: str, node_type: str | None = None) -> DataFrame:
    """One row (value) of a numeric property: sum, min, max or avg; or, for count, a row (value, n) for each value."""
    n = nodes if node_type is None else nodes.where(by_type(node_type))
    value = F.try_element_at("props", F.lit(key))
    if kind == "count":
        return n.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return n.agg({"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[kind](value.try_cast("double")).alias("value"))
