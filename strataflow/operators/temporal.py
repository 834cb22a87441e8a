"""Temporal views of edges and versioned rows, version histories, and temporal joins.

Views are filters on plain columns, so they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.model import Graph

KINDS = ("active", "all", "point", "range")
WEEK = 7 * 86400 * 10**9


def _check(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown view {kind!r}; one of {KINDS}")


def edge_viewport(edges: DataFrame, kind: str = "active", start: int | None = None, end: int | None = None, as_of: int | None = None) -> DataFrame:
    """Edges that a valid-time view shows; ranges are strict on both sides.

    ``active``: no end. ``point``: valid at ``start``. ``range``: overlaps (start, end). Edges marked as not valid never show.
    ``as_of`` keeps what was recorded by then.
    """
    _check(kind)
    out = edges.where("is_valid is null or is_valid")
    since, until = F.col("valid_from"), F.col("valid_until")
    if kind == "active":
        out = out.where(until.isNull())
    elif kind == "point":
        out = out.where((since.isNull() | (since <= start)) & (until.isNull() | (until > start)))
    elif kind == "range":
        out = out.where((since.isNull() | (since < end)) & (until.isNull() | (until > start)))
    return out if as_of is None else out.where(F.col("created_at") <= as_of)


def row_viewport(rows: DataFrame, kind: str = "active", start: int | None = None, end: int | None = None, as_of: int | None = None, newest: bool = False) -> DataFrame:
    """Row versions that a view shows; ranges include both bounds.

    A row's versions do not overlap when this engine wrote them, so a point shows one of each; with ``newest``
    that is enforced for other histories, at the price of a shuffle.
    """
    _check(kind)
    since, until = F.col("_valid_from"), F.col("_valid_until")
    out = rows if as_of is None else rows.where(F.col("_created_at") <= as_of)
    if kind == "active":
        out = out.where(until.isNull())
    elif kind == "point":
        out = out.where((since.isNull() | (since <= start)) & (until.isNull() | (until > start)))
    elif kind == "range":
        out = out.where((since.isNull() | (since <= end)) & (until.isNull() | (until >= start)))
    if newest and kind in ("active", "point"):
        latest = Window.partitionBy("_group_id", "_row_id").orderBy(F.desc("_valid_from"), F.desc("_version_id"))
        out = out.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")
    return out


def graph_as_of(graph: Graph, cutoff: int) -> Graph:
    """Nodes recorded by the cutoff, and edges recorded by then between such nodes."""
    return _induced(graph, F.col("created_at") <= cutoff)


def graph_window(graph: Graph, start: int, end: int) -> Graph:
    """Nodes and edges recorded within [start, end], edges between such nodes only."""
    return _induced(graph, F.col("created_at").between(start, end))


def _induced(graph: Graph, keep: Column) -> Graph:
    nodes = graph.nodes.where(keep)
    ids = nodes.select(F.col("id").alias("_id"))
    edges = graph.edges.where(keep)
    edges = edges.join(ids, edges["source"] == ids["_id"], "left_semi")
    return Graph(nodes, edges.join(ids, edges["target"] == ids["_id"], "left_semi"))


def close_versions(rows: DataFrame, key: list[str], since: str, tie: str, until: str = "valid_until") -> DataFrame:
    """``until`` of each row = the next row's ``since`` within the key; the last stays open."""
    return rows.withColumn(until, F.lead(since).over(Window.partitionBy(*key).orderBy(since, tie)))


def timeline(rows: DataFrame, key: list[str], since: str, tie: str) -> DataFrame:
    """``position`` within the key, and ``is_current`` on the last row when it is open."""
    w = Window.partitionBy(*key).orderBy(since, tie)
    last = F.lead(since).over(w).isNull()
    return rows.withColumn("position", F.row_number().over(w)).withColumn("is_current", last & F.col("valid_until").isNull())


def compact(rows: DataFrame, now: int, keep: int = WEEK) -> DataFrame:
    """Without versions closed more than ``keep`` before ``now``; the newest version of a row stays."""
    newest = Window.partitionBy("_group_id", "_row_id").orderBy(F.desc("_valid_from"), F.desc("_version_id"))
    ranked = rows.withColumn("_rank", F.row_number().over(newest))
    return ranked.where((F.col("_rank") == 1) | F.col("_valid_until").isNull() | (F.col("_valid_until") >= now - keep)).drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """``left`` with the ``columns`` of the last row of ``right`` at or before each time, by key.

    Both sides are interleaved in one sort and the last values carried forward: one shuffle, and
    no pair is ever formed that is not wanted.
    """
    carried = F.struct(*columns)
    kind = "struct<" + ",".join(f"`{c}`:{right.schema[c].dataType.simpleString()}" for c in columns) + ">"
    sides = left.select(*on, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_value"))
    row = sides.schema["_row"].dataType.simpleString()
    other = right.select(*on, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_row"), carried.alias("_value"))
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = sides.unionByName(other).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *(F.col(f"_last.{c}").alias(c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, lo: tuple[str, str], ro: tuple[str, str], width: int, on: list[str] = (), horizon: int | None = None) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, as an equi-join on time buckets of ``width``.

    A pair is kept in the bucket of the later start only, so no deduplication is needed, and no interval is spread beyond
    the last start of all. ``lo`` and ``ro`` name (start, end) columns, which must differ between the sides; open ends
    count as ``horizon``, or without one as endless.
    """
    far = F.lit(horizon if horizon is not None else (1 << 63) - 1).cast("long")
    starts = [df.agg(F.max(start)).first()[0] for df, start in ((left, lo[0]), (right, ro[0]))]
    latest = F.lit(max([0, *(s for s in starts if s is not None)])).cast("long")

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        s = F.coalesce(F.col(start), F.lit(0).cast("long"))
        e = F.coalesce(F.col(end), far)
        first, last = F.floor(s / width), F.floor(F.least(e - 1, latest) / width)
        return df.where(s < e).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = spread(left, *lo), spread(right, *ro)
    ls, rs = F.coalesce(F.col(lo[0]), F.lit(0)), F.coalesce(F.col(ro[0]), F.lit(0))
    le, re = F.coalesce(F.col(lo[1]), far), F.coalesce(F.col(ro[1]), far)
    pairs = a.join(b, ["_bucket", *on])
    return pairs.where((ls < re) & (rs < le) & (F.col("_bucket") == F.floor(F.greatest(ls, rs) / width))).drop("_bucket")
