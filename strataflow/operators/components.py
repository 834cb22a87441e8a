"""Connected and strongly connected components of a table of links.

Every round is a few shuffles of narrow rows, written to the shared folder; links never reach the
driver, only their number and a checksum do. Minima are pre-aggregated, so a node with very many
neighbours is one row per task, and the joins are plain ones, whose skew adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strataflow import shared


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    j = both.join(least, F.col("u") == F.col("_u"))
    if large:
        # neighbours above u are hung on the least of u and its neighbours
        out = j.where("v > u").select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
    else:
        # neighbours below u, and u itself, are hung on the least of them
        out = j.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v")))
    return out.where("u > v").distinct()


ROUND_ROWS = 1 << 20


def _round(links: DataFrame, name: str, rows: int | None = None) -> tuple[str, tuple]:
    """Write links, of which there are about ``rows``; the path, and their number and checksum, which the writing itself observes."""
    seen = Observation()
    links = links if rows is None else links.coalesce(1 + rows // ROUND_ROWS)
    path = shared.write(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return path, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, component (the least node it reaches) of every node on a link; links are (u, v), any order."""
    spark = links.sparkSession
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path, state = _round(now, name)
    mark = None
    while True:
        table = shared.read(spark, path, now.schema)
        if state == mark or not state[0]:
            break
        mark = state
        after, state = _round(_star(_star(table, True), False), name, state[0])
        shared.remove(spark, path)
        path = after
    # every link is now (node, component)
    nodes = table.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node, edges taken both ways; a component is named by its least node."""
    found = components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")), "edges")
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))


def strongly_connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of every node: nodes that reach each other; named by the largest node.

    Colouring: the largest reachable-from node is passed along the edges until nothing changes; within a colour, what
    reaches its root backwards is a component. It is set aside, and the rest is coloured anew.
    """
    spark = nodes.sparkSession
    left = shared.cut(nodes.select(F.col("id").alias("node")).distinct(), "left")
    links = shared.cut(edges.select("source", "target").where("source <> target").distinct(), "links")
    done = None
    while not left.isEmpty():
        colour = left.select("node", F.col("node").alias("colour"))
        while True:
            step = links.join(colour, F.col("source") == F.col("node")).groupBy(F.col("target").alias("_t")).agg(F.max("colour").alias("_c"))
            new = colour.join(step, F.col("node") == F.col("_t"), "left").select("node", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), (F.col("_c") > F.col("colour")).alias("_up"))
            new = shared.cut(new, "colour")
            colour = new.select("node", "colour")
            if new.where("_up").isEmpty():
                break
        same = links.join(colour.select(F.col("node").alias("_s"), F.col("colour").alias("_sc")), F.col("source") == F.col("_s"))
        same = same.join(colour.select(F.col("node").alias("_t"), F.col("colour").alias("_tc")), F.col("target") == F.col("_t")).where("_sc = _tc").select("source", "target")
        same = shared.cut(same, "same")
        found = frontier = colour.where("node = colour")
        while True:
            back = same.join(frontier, F.col("target") == F.col("node")).select(F.col("source").alias("node"), "colour").distinct()
            frontier = shared.cut(back.join(found.select("node"), "node", "left_anti"), "back")
            if frontier.isEmpty():
                break
            found = shared.cut(found.unionByName(frontier), "found")
        part = found.select("node", F.col("colour").alias("component"))
        done = part if done is None else shared.cut(done.unionByName(part), "done")
        left = shared.cut(left.join(part, "node", "left_anti"), "left")
        links = same.join(left, F.col("source") == F.col("node"), "left_semi").join(left, F.col("target") == F.col("node"), "left_semi")
        links = shared.cut(links, "links")
    return done if done is not None else spark.createDataFrame([], "node long, component long")
