"""Reachability, paths and traversal as iterated joins.

Edges are (source, target) tables; the caller applies a temporal view first. A round is a join of the
frontier with the edges; rounds are cut by written tables, and a search ends when its frontier is empty.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataflow import shared

#: Searches of up to this many hops are one plan; deeper ones are cut into rounds.
ONE_PLAN = 3


def _rounds(most: int | None) -> Iterable[int]:
    """1, 2, ... up to ``most``, or without end."""
    return count(1) if most is None else range(1, most + 1)


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(source, target) pairs to follow: out, in or both ways."""
    out = edges.select("source", "target")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise ValueError(f"unknown direction {direction!r}")


@shared.tidy
def reach(edges: DataFrame, starts: DataFrame, low: int = 1, high: int | None = 10, direction: str = "out") -> DataFrame:
    """(start, node, depth): nodes within ``high`` hops of each start, or with None any number, once, at their least depth.

    ``starts`` has a column ``start``. Starts are not in their own result; ``low`` applies to the least depth.
    """
    links = directed(edges, direction).distinct()
    frontier = starts.select("start").distinct().select("start", F.col("start").alias("node"))
    seen = frontier.select("start", "node", F.lit(0).alias("depth"))
    rounds = high is None or high > ONE_PLAN
    if rounds:
        links = shared.cut(links, "reach-links")
    for depth in _rounds(high):
        step = frontier.join(links, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        frontier = step.join(seen, ["start", "node"], "left_anti")
        if rounds:
            frontier = shared.cut(frontier, "reach")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier.select("start", "node", F.lit(depth).alias("depth")))
    found = seen.where(F.col("depth") >= max(low, 1))
    return found if high is None else found.where(F.col("depth") <= high)


def neighbours(edges: DataFrame, start: int, hops: int, direction: str = "out") -> DataFrame:
    """(node, depth) within ``hops`` of one node."""
    one = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
    return reach(edges, one, 1, hops, direction).select("node", "depth")


def subgraph(nodes: DataFrame, edges: DataFrame, start: int, radius: int, node_types: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes within the radius, the centre included, and the edges among them."""
    ids = neighbours(edges, start, radius, direction).select(F.col("node").alias("_id"))
    ids = ids.unionByName(edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("_id")))
    near = nodes.join(ids, nodes["id"] == ids["_id"], "left_semi")
    if node_types:
        near = near.where(F.col("node_type").isin(node_types))
    keep = near.select(F.col("id").alias("_id"))
    inner = edges.join(keep, edges["source"] == keep["_id"], "left_semi")
    return near, inner.join(keep, inner["target"] == keep["_id"], "left_semi")


def edge_cost(signal: Column) -> Column:
    """max(0.001, 1 - signal)."""
    return F.greatest(F.lit(0.001), F.lit(1.0) - F.coalesce(signal, F.lit(0.0)))


def costs(edges: DataFrame) -> DataFrame:
    """source, target, cost: of parallel edges the cheapest."""
    return edges.groupBy("source", "target").agg(F.min(edge_cost(F.col("cost_signal"))).alias("cost"))


#: rows of a frontier that are sent to every executor instead of moving the edges
SMALL = 1 << 16


@shared.tidy
def least_costs(priced: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, cost) of the cheapest path of any length from each start to every node, as shortest_paths() finds them.

    The paths themselves are not kept, so a row has a fixed size.
    """
    priced = shared.cut(priced.select("source", "target", "cost"), "priced")
    best = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(True).alias("_fell"))
    best, fell = shared.cut(best, "costs"), None
    while fell != 0:
        f = best.where("_fell").select("start", F.col("node").alias("source"), F.col("cost").alias("_cost"))
        f = F.broadcast(f) if fell is not None and fell <= SMALL else f.hint("merge")
        step = priced.join(f, "source").select("start", F.col("target").alias("node"), F.round(F.col("_cost") + F.col("cost"), 9).alias("cost"))
        least = step.groupBy("start", "node").agg(F.min("cost").alias("_new"))
        new = best.select("start", "node", "cost").join(least, ["start", "node"], "full")
        falls = F.col("_new").isNotNull() & (F.col("cost").isNull() | (F.col("_new") < F.col("cost")))
        new = new.select("start", "node", F.when(falls, F.col("_new")).otherwise(F.col("cost")).alias("cost"), falls.alias("_fell"))
        seen, old = Observation(), best
        best = shared.cut(new.observe(seen, F.count_if("_fell").alias("fell")), "costs")
        shared.drop(old)
        fell = seen.get["fell"]
    return best.select("start", "node", "cost")


@shared.tidy
def shortest_paths(priced: DataFrame, starts: DataFrame, targets: DataFrame | None = None, rounds: int | None = None, max_cost: float | None = None) -> DataFrame:
    """(start, node, cost, path) of the cheapest path from each start to every node, or to ``targets``.

    Frontier relaxation: only nodes whose cost fell are expanded, for ``rounds`` edges or, with None, until no cost falls. Equal costs are settled by the path of least ids.
    Dijkstra, A* without a heuristic and bidirectional search give this same result. Tables with paths are merged, not broadcast: their
    files are far smaller than their rows.
    """
    priced = shared.cut(priced.select("source", "target", "cost"), "priced")
    best = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    best = shared.cut(best, "paths")
    frontier = best
    for _ in _rounds(rounds):
        f = frontier.select("start", F.col("node").alias("source"), F.col("cost").alias("_cost"), F.col("path").alias("_path"))
        step = f.hint("merge").join(priced, "source").where(~F.array_contains("_path", F.col("target")))
        step = step.select("start", F.col("target").alias("node"), F.round(F.col("_cost") + F.col("cost"), 9).alias("cost"), F.concat("_path", F.array("target")).alias("path"))
        if max_cost is not None:
            step = step.where(F.col("cost") <= max_cost)
        least = step.groupBy("start", "node").agg(F.min(F.struct("cost", "path")).alias("new"))
        old = best.select("start", "node", F.struct("cost", "path").alias("old"))
        better = least.join(old.hint("merge"), ["start", "node"], "left").where(F.col("old").isNull() | (F.col("new") < F.col("old")))
        frontier = shared.cut(better.select("start", "node", "new.cost", "new.path"), "paths")
        if frontier.isEmpty():
            break
        best = shared.cut(best.join(frontier.select("start", "node").hint("merge"), ["start", "node"], "left_anti").unionByName(frontier), "paths")
    return best if targets is None else best.join(targets.select("node").distinct(), "node", "left_semi").select("start", "node", "cost", "path")


def simple_paths(edges: DataFrame, starts: DataFrame, high: int) -> DataFrame:
    """(start, node, cost, path) of all simple paths of 1 to ``high`` edges; edges have source, target, cost."""
    e = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("cost").alias("_c"))
    level = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    found = None
    for _ in range(high):
        level = level.join(e, F.col("node") == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        level = level.select("start", F.col("_t").alias("node"), F.round(F.col("cost") + F.col("_c"), 9).alias("cost"), F.concat("path", F.array("_t")).alias("path"))
        found = level if found is None else found.unionByName(level)
    return found


def _cheap_paths(priced: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """(start, node, cost, path) of the simple paths from start to end that cost no more than the k-th cheapest.

    The cheapest ways to and from each edge make simple paths, whose k-th cost is a bound. All paths are grown of which the
    cost so far and the cheapest rest stay within it; with fewer than k such paths there is no bound.
    """
    node = lambda x: priced.sparkSession.range(1).select(F.lit(x).cast("long").alias("start"))
    priced = shared.cut(priced.select("source", "target", "cost").where("source <> target"), "priced")
    ahead = shortest_paths(priced, node(start), rounds=None).select(F.col("node").alias("source"), F.col("cost").alias("_a"), F.col("path").alias("_to"))
    back = priced.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
    rest = shortest_paths(back, node(end), rounds=None).select(F.col("node").alias("target"), F.col("cost").alias("_b"), F.reverse("path").alias("_from"))
    via = priced.join(ahead.hint("merge"), "source").join(rest.hint("merge"), "target").select((F.col("_a") + F.col("cost") + F.col("_b")).alias("cost"), F.concat("_to", "_from").alias("path"))
    via = via.where(F.size(F.array_distinct("path")) == F.size("path")).groupBy("path").agg(F.min("cost").alias("cost"))
    known = [r["cost"] for r in via.select("cost").orderBy("cost").limit(k).collect()]
    links = priced.join(rest.select("target", "_b"), "target").select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("cost").alias("_c"), "_b")
    if len(known) == k:
        links = links.where(F.col("_c") + F.col("_b") <= known[-1] + 1e-6)  # above the rounding of sums
    links = shared.cut(links, "links")
    level = node(start).select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    found = level.where("false")
    while start != end:
        level = level.where(F.col("node") != end).join(links, F.col("node") == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        level = level.select("start", F.col("_t").alias("node"), F.round(F.col("cost") + F.col("_c"), 9).alias("cost"), F.concat("path", F.array("_t")).alias("path"), "_b")
        if len(known) == k:
            level = level.where(F.col("cost") + F.col("_b") <= known[-1] + 1e-6)
        level = shared.cut(level.drop("_b"), "paths")
        if level.isEmpty():
            break
        found = found.unionByName(level.where(F.col("node") == end))
    return found


@shared.tidy
def k_shortest(priced: DataFrame, start: int, end: int, k: int = 3, high: int | None = None) -> DataFrame:
    """The k cheapest simple paths (cost, path, rank) of at most ``high`` edges, or with None of any number."""
    one = priced.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
    paths = _cheap_paths(priced, start, end, k) if high is None else simple_paths(priced, one, high).where(F.col("node") == end)
    ranked = paths.withColumn("rank", F.row_number().over(Window.partitionBy("start", "node").orderBy("cost", "path")))
    return ranked.where(F.col("rank") <= k).select("cost", "path", "rank")


@shared.tidy
def constrained_path(
    nodes: DataFrame, edges: DataFrame, start: int, end: int, max_length: int | None = None, avoid_types: list[str] = (), require_types: list[str] = (),
    min_weight: float | None = None, condition: Column | None = None,
) -> DataFrame:
    """The cheapest simple path (cost, path) that meets the constraints, of any number of edges or ``max_length`` at most; all are
    applied to every path, so a feasible path is found whenever there is one. ``condition`` is on edges.

    Without required types this is a cheapest path over the usable edges. With them, paths are grown of which the cost so far
    and the cheapest rest stay below the best that is complete.
    """
    usable = edges if min_weight is None else edges.where(F.col("weight") >= min_weight)
    usable = usable if condition is None else usable.where(condition)
    kinds = nodes.select(F.col("id").alias("_id"), F.col("node_type").alias("_type"))
    if avoid_types:
        good = kinds.where(~F.col("_type").isin(list(avoid_types)) | F.col("_id").isin(start, end)).select("_id")
        usable = usable.join(good, usable["target"] == good["_id"], "left_semi")
    node = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast("long").alias("start"))
    priced = shared.cut(costs(usable).where("source <> target"), "priced")
    if not require_types:
        return shortest_paths(priced, node(start), node(end).select(F.col("start").alias("node")), rounds=max_length).select("cost", "path").where(F.size("path") > 1)
    back = priced.select(F.col("target").alias("source"), F.col("source").alias("target"), "cost")
    rest = shortest_paths(back, node(end)).select(F.col("node").alias("target"), F.col("cost").alias("_b"))
    needed = kinds.where(F.col("_type").isin(list(require_types)))
    links = priced.join(rest, "target").join(needed, F.col("target") == F.col("_id"), "left")
    links = shared.cut(links.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("cost").alias("_c"), "_b", F.array_compact(F.array("_type")).alias("_met")), "links")
    none = F.array().cast("array<string>")
    level = node(start).select(F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.array("start").alias("path"))
    level = level.join(needed, F.col("node") == F.col("_id"), "left").select("node", "cost", "path", F.array_compact(F.array("_type")).alias("met"))
    wanted = F.array(*[F.lit(t) for t in require_types])
    found, best = level.where("false").select("cost", "path"), None
    for _ in _rounds(max_length):
        level = level.where(F.col("node") != end).join(links, F.col("node") == F.col("_s")).where(~F.array_contains("path", F.col("_t")))
        level = level.select(F.col("_t").alias("node"), F.round(F.col("cost") + F.col("_c"), 9).alias("cost"), F.concat("path", F.array("_t")).alias("path"), F.array_union(F.coalesce("met", none), "_met").alias("met"), "_b")
        if best is not None:
            level = level.where(F.col("cost") + F.col("_b") <= best + 1e-6)
        level = shared.cut(level.drop("_b"), "paths")
        if level.isEmpty():
            break
        done = level.where((F.col("node") == end) & (F.size(F.array_except(wanted, F.col("met"))) == 0)).select("cost", "path")
        least = done.agg(F.min("cost")).first()[0]
        best = least if best is None else best if least is None else min(best, least)
        found = found.unionByName(done)
    return found.orderBy("cost", "path").limit(1)


def traverse(
    nodes: DataFrame, edges: DataFrame, start: int, low: int = 1, high: int = 5, direction: str = "out", since: int | None = None, until: int | None = None,
    node_filter: Column | None = None, edge_filter: Column | None = None, mode: str = "collect",
) -> DataFrame:
    """Recursive traversal with a window on created_at of edges and neighbours, and filters.

    ``collect``: (node, depth). ``paths``: the maximal simple paths (path). ``shortest``: (node, cost, path).
    """
    e, n = edges, nodes
    if since is not None:
        e, n = e.where(F.col("created_at") >= since), n.where((F.col("created_at") >= since) | (F.col("id") == start))
    if until is not None:
        e, n = e.where(F.col("created_at") <= until), n.where((F.col("created_at") <= until) | (F.col("id") == start))
    e = e if edge_filter is None else e.where(edge_filter)
    n = n if node_filter is None else n.where(node_filter | (F.col("id") == start))
    ids = n.select(F.col("id").alias("_id"))
    e = e.join(ids, e["target"] == ids["_id"], "left_semi")
    e = e.join(ids, e["source"] == ids["_id"], "left_semi")
    if mode == "collect":
        one = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
        return reach(e, one, low, high, direction).select("node", "depth")
    one = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
    if mode == "shortest":
        return shortest_paths(costs(e), one, rounds=high).where(F.col("node") != start).select("node", "cost", "path")
    if mode != "paths":
        raise ValueError(f"unknown mode {mode!r}")
    every = simple_paths(costs(e), one, high)
    # a path is maximal when no longer one begins with it
    longer = every.where(F.size("path") > 2).select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct()
    return every.join(longer, "path", "left_anti").where(F.size("path") > low).select("path")


@shared.tidy
def temporal_reach(edges: DataFrame, starts: DataFrame, since: int | None = None, until: int | None = None, min_weight: float | None = None, hops: int | None = 10) -> DataFrame:
    """(start, node, arrival, hops, path): earliest arrival over edges recorded in non-decreasing order.

    An edge may be followed when its created_at is not before the arrival at its source. ``starts``
    has a column start; with ``hops`` None routes may have any number of edges. Of equal arrivals the path of fewer hops, then of least ids, is kept.
    """
    e = edges if since is None else edges.where(F.col("created_at") >= since)
    e = e if until is None else e.where(F.col("created_at") <= until)
    e = e if min_weight is None else e.where(F.col("weight") >= min_weight)
    e = shared.cut(e.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("created_at").alias("_at")).distinct(), "timed")
    zero = F.lit(since if since is not None else 0).cast("long")
    best = starts.select("start").distinct().select("start", F.col("start").alias("node"), zero.alias("arrival"), F.lit(0).alias("hops"), F.array("start").alias("path"))
    frontier = best
    for _ in _rounds(hops):
        step = frontier.join(e, (F.col("node") == F.col("_s")) & (F.col("_at") >= F.col("arrival")))
        step = step.select("start", F.col("_t").alias("node"), F.struct(F.col("_at").alias("arrival"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("_t")).alias("path")).alias("new"))
        least = step.groupBy("start", "node").agg(F.min("new").alias("new"))
        old = best.select("start", "node", F.col("arrival").alias("_old"))
        better = least.join(old, ["start", "node"], "left").where(F.col("_old").isNull() | (F.col("new.arrival") < F.col("_old")))
        frontier = shared.cut(better.select("start", "node", "new.arrival", "new.hops", "new.path"), "arrivals")
        if frontier.isEmpty():
            break
        best = shared.cut(best.join(frontier, ["start", "node"], "left_anti").unionByName(frontier), "arrivals")
    return best.where(F.col("node") != F.col("start"))


#: edges of a slice of time, which one task for each start goes through
SLICE = 1 << 18
ARRIVALS = "start long, node long, arrival long"


def _arrive(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes that a start reaches first within a slice; the rows are (start, _s, _t, _at, and whether _s was reached before)."""
    part = part.sort_values("_at")
    source, target, at = part["_s"].tolist(), part["_t"].tolist(), part["_at"].tolist()
    reached = set(part["_s"][part["_in"]].tolist())
    new, i = {}, 0
    while i < len(at):
        end = i + 1
        while end < len(at) and at[end] == at[i]:
            end += 1
        open_, grew = range(i, end), True
        while grew and open_:  # edges of one time may follow each other in any order
            grew, rest = False, []
            for j in open_:
                if source[j] not in reached:
                    rest.append(j)
                elif target[j] not in reached:
                    reached.add(target[j])
                    new[target[j]] = at[j]
                    grew = True
            open_ = rest if end - i > 1 else ()
        i = end
    return pd.DataFrame({"start": part["start"].iloc[0], "node": list(new), "arrival": list(new.values())}).astype("int64")


@shared.tidy
def earliest_arrivals(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, arrival) as temporal_reach() finds them over routes of any length, without the routes.

    A node reached before a slice of time may be left at any time within it, so slices are taken once each, in order, and no arrival is ever corrected.
    """
    e = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("created_at").alias("_at")).where("_at >= 0 and _s <> _t")
    starts = shared.cut(starts.select("start").distinct(), "starts")
    e = shared.cut(e.repartitionByRange("_at").sortWithinPartitions("_at"), "timed")
    n = starts.count()
    slices = -(-e.count() * max(1, n) // SLICE)
    marks = (e.agg(F.percentile_approx("_at", [i / slices for i in range(1, slices)], 100 * slices)).first()[0] or []) if slices > 1 else []
    marks = [None, *sorted(set(marks)), None]
    best, new = starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("arrival")), []
    for i, (low, high) in enumerate(zip(marks, marks[1:]), 1):
        part = e if low is None else e.where(F.col("_at") >= low)
        part = (part if high is None else part.where(F.col("_at") < high)).crossJoin(F.broadcast(starts))
        known = best.select("start", F.col("node").alias("_n"))
        part = part.join(known.withColumnRenamed("_n", "_t"), ["start", "_t"], "left_anti")
        part = part.join(known.select("start", F.col("_n").alias("_s"), F.lit(True).alias("_in")), ["start", "_s"], "left")
        found = part.select("start", "_s", "_t", "_at", F.coalesce("_in", F.lit(False)).alias("_in")).groupBy("start").applyInPandas(_arrive, ARRIVALS)
        best = best.unionByName(shared.cut(found, "arrivals", files=1 if n == 1 else None))
        if i % 8 == 0:
            best = shared.cut(best, "arrivals")
    return best.where("node <> start")


def causal_path(edges: DataFrame, start: int, end: int, **limits) -> DataFrame:
    """(path, arrival) of the earliest arrival at ``end``; no row when it cannot be reached."""
    one = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
    return temporal_reach(edges, one, **limits).where(F.col("node") == end).select("path", "arrival")


def suggestions(edges: DataFrame, start: int, hops: int = 3, limit: int = 50) -> DataFrame:
    """Continuations (node, cost, path) of up to ``hops`` edges, cheapest first: a report of ``limit`` rows."""
    one = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("start"))
    found = shortest_paths(costs(edges), one, rounds=hops).where(F.col("node") != start)
    return found.orderBy("cost", "node").limit(limit).select("node", "cost", "path")


def dead_ends(edges: DataFrame, least: int = 3, ratio: float = 0.5) -> DataFrame:
    """(node, failures, outcomes): targets of outcomes of which ``ratio`` or more failed.

    Outcomes are edges whose props have ``outcome``; a node needs ``least`` of them.
    """
    o = edges.where(F.try_element_at("props", F.lit("outcome")).isNotNull())
    failed = F.sum(F.when(F.try_element_at("props", F.lit("outcome")) == "Failure", 1).otherwise(0))
    out = o.groupBy(F.col("target").alias("node")).agg(failed.alias("failures"), F.count("*").alias("outcomes"))
    return out.where((F.col("outcomes") >= least) & (F.col("failures") >= ratio * F.col("outcomes")))
