"""Centralities. Edges have source, target; scores are of every node in ``nodes`` (id).

Iterations are joins and pre-aggregated sums; each is cut by a written table, and what an iteration
needs of the whole graph (dangling mass, norms) is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strataflow import shared

CUT_EVERY = 5


def _ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("id").distinct()


def degree_centrality(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, degree, score): degree / (n - 1)."""
    end = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
    ends = None
    for c in end:
        part = edges.select(F.col(c).alias("_id"))
        ends = part if ends is None else ends.unionByName(part)
    degree = ends.groupBy("_id").agg(F.count("*").alias("_d"))
    n = _ids(nodes).agg(F.count("*").alias("_n"))  # one row
    out = _ids(nodes).join(degree, F.col("id") == F.col("_id"), "left").join(F.broadcast(n))
    d = F.coalesce("_d", F.lit(0))
    return out.select(F.col("id").alias("node"), d.alias("degree"), F.when(F.col("_n") > 1, d / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias("score"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-4, dangling: bool = True,
    normalise: bool = False, restart: DataFrame | None = None,
) -> DataFrame:
    """(node, score). Parallel edges count once each.

    ``dangling`` spreads the mass of nodes without outgoing edges. With ``tolerance`` None all rounds run, as
    one plan cut every CUT_EVERY rounds. ``restart`` (id) restricts where the walk restarts: personalized PageRank.

    With a tolerance the scores are those that the rounds tend to. What dangling nodes give goes where the walk restarts, so it only scales
    the scores z = base + damping * (what z sends along the edges); z is iterated, and where edges form no cycle it is exact
    after as many rounds as the longest path has edges.
    """
    ids = _ids(nodes)
    n = ids.count()
    if n == 0:
        return ids.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    out_degree = edges.groupBy("source").agg(F.count("*").alias("_deg"))
    links = shared.cut(edges.select("source", "target").join(out_degree, "source").groupBy("source", "target", "_deg").agg(F.count("*").alias("_k")), "links")
    links = shared.placed(links, "source")
    if restart is None:
        base = ids.withColumn("_base", F.lit(1.0 / n))
    else:
        r = restart.select(F.col("id").alias("_r")).distinct()
        m = r.join(ids, F.col("_r") == F.col("id"), "left_semi").count()
        base = ids.join(r, F.col("id") == F.col("_r"), "left").select("id", F.when(F.col("_r").isNotNull(), 1.0 / max(m, 1)).otherwise(F.lit(0.0)).alias("_base"))
    senders = out_degree.select(F.col("source").alias("_s"), F.lit(True).alias("_sends"))
    base = shared.cut(base.join(senders, F.col("id") == F.col("_s"), "left").select("id", "_base", F.coalesce("_sends", F.lit(False)).alias("_sends")), "base")
    start = F.col("_base") / (1 - damping) if tolerance is not None and damping < 1 else F.col("_base")
    rank = base.select("id", "_sends", "_base", start.alias("score"))
    scale = 1.0
    for i in range(1, rounds + 1):
        sent = rank.select(F.col("id").alias("source"), "score").where("score <> 0")
        given = links.join(sent, "source").groupBy(F.col("target").alias("_t")).agg(F.sum(F.col("score") * F.col("_k") / F.col("_deg")).alias("_in"))
        new = rank.join(given, F.col("id") == F.col("_t"), "left")
        if tolerance is not None:
            score = F.col("_base") + damping * F.coalesce("_in", F.lit(0.0))
            new = new.select("id", "_sends", "_base", score.alias("score"), F.abs(score - F.col("score")).alias("_delta"))
            rank, seen = _observed(new, "rank", F.max("_delta").alias("delta"), F.max("score").alias("high"), F.sum("score").alias("mass"), F.sum(F.when(~F.col("_sends"), F.col("score"))).alias("stuck"))
            before, scale = scale, _scale(damping, seen["mass"], (seen["stuck"] or 0.0) if dangling else 0.0)
            if scale * seen["delta"] + abs(scale - before) * seen["high"] < tolerance:
                break
            continue
        lost = F.lit(0.0)
        if dangling:
            stuck = rank.agg(F.coalesce(F.sum(F.when(~F.col("_sends"), F.col("score"))), F.lit(0.0)).alias("_stuck"))
            new = new.join(F.broadcast(stuck))  # one row
            lost = F.col("_stuck")
        score = (1 - damping) * F.col("_base") + damping * (F.coalesce("_in", F.lit(0.0)) + lost * F.col("_base"))
        rank = new.select("id", "_sends", "_base", score.alias("score"))
        if i % CUT_EVERY == 0 and i < rounds:
            rank = shared.cut(rank, "rank")
    if tolerance is None:
        rank = shared.cut(rank, "rank")
    links.unpersist()
    rank = rank.withColumn("score", F.col("score") * scale)
    if normalise:
        rank = rank.join(F.broadcast(rank.agg(F.sum("score").alias("_sum")))).withColumn("score", F.col("score") / F.col("_sum"))
    return rank.select(F.col("id").alias("node"), "score")


def _observed(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """The written table, and measures of it that its writing observes."""
    seen = Observation()
    return shared.cut(df.observe(seen, *measures), name), seen.get


def _scale(damping: float, mass: float, stuck: float) -> float:
    """What turns z into scores, where dangling nodes hold ``stuck`` of its ``mass``."""
    rest = 1 - damping * stuck
    return (1 - damping) / rest if rest > 1e-12 and damping < 1 else 1 / mass if mass else 0.0


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float | None = 1e-6) -> DataFrame:
    """Power iteration with restart at ``start`` (id): the expectation of what random walks estimate."""
    return pagerank(nodes, edges, damping, rounds, tolerance, True, False, start)


def eigenvector_centrality(nodes: DataFrame, edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-4) -> DataFrame:
    """(node, score): sums over out-neighbours, scaled to sum 1 each round.

    Rounds hold the nodes with a score, or with one before, and no others.
    """
    ids = shared.cut(_ids(nodes), "ids")
    n = max(ids.count(), 1)
    links = edges.groupBy("source", "target").agg(F.count("*").alias("_k")).join(ids, F.col("source") == F.col("id"), "left_semi")
    links = shared.placed(shared.cut(links, "links"), "target")
    value = ids.select("id", F.lit(1.0 / n).alias("score"))
    for _ in range(rounds):
        given = links.join(value.where("score <> 0").select(F.col("id").alias("target"), "score"), "target").groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("score") * F.col("_k")).alias("_in"))
        both = value.join(given, F.col("id") == F.col("_s"), "full").select(F.coalesce("id", "_s").alias("id"), F.coalesce("_in", F.lit(0.0)).alias("_raw"), F.coalesce("score", F.lit(0.0)).alias("_old"))
        new, seen = _observed(both.where("_raw <> 0 or _old <> 0"), "eigen", F.sum("_raw").alias("sum"))
        new = new.select("id", (F.col("_raw") / (seen["sum"] or 1.0)).alias("score"), "_old")
        value = new.select("id", "score")
        if tolerance is not None and (new.agg(F.max(F.abs(F.col("score") - F.col("_old")))).first()[0] or 0.0) < tolerance:
            break
    links.unpersist()
    value = value.where("score <> 0").select(F.col("id").alias("node"), "score")
    return ids.join(value, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: longs of a row of reached nodes: a row stands for WORDS * 64 ids in a row
WORDS = 4


@shared.tidy
def reach_counts(edges: DataFrame, high: int | None = None) -> DataFrame:
    """(node, reached, depths): of each node that reaches others, how many within ``high`` hops, and the sum of their least depths.

    The pairs are never rows. What a node reaches in exactly d hops is a set of bits, a row for each block of ids that it touches; in
    d + 1 hops it is the union of its neighbours' sets, without what it reached before and itself.
    """
    width = WORDS * 64
    words = [f"_w{i}" for i in range(WORDS)]
    links = shared.cut(edges.select("source", "target").where("source <> target").distinct(), "links")
    own = lambda i, c: F.expr(f"if(pmod({c}, {width}) div 64 = {i}, shiftleft(1L, cast({c} & 63 as int)), 0L)")
    union = [F.expr(f"bit_or({w})").alias(w) for w in words]
    block = lambda c: F.expr(f"({c} - pmod({c}, {width})) div {width}")
    level = links.select(F.col("source").alias("node"), block("target").alias("_block"), *(own(i, "target").alias(w) for i, w in enumerate(words)))
    level = shared.cut(level.groupBy("node", "_block").agg(*union), "reached")
    levels = [level]
    zero = F.lit(0).cast("long")
    for _ in count(2) if high is None else range(2, high + 1):
        step = links.join(levels[-1], F.col("target") == F.col("node")).select(F.col("source").alias("node"), "_block", *words, *(zero.alias(f"{w}_old") for w in words))
        for seen in levels:
            step = step.unionByName(seen.select("node", "_block", *(zero.alias(w) for w in words), *(F.col(w).alias(f"{w}_old") for w in words)))
        both = step.groupBy("node", "_block").agg(*union, *(F.expr(f"bit_or({w}_old)").alias(f"{w}_old") for w in words))
        self_bit = lambda i: F.when(F.col("_block") == block("node"), own(i, "node")).otherwise(zero)
        new = both.select("node", "_block", *(F.col(w).bitwiseAND(F.bitwise_not(F.col(f"{w}_old").bitwiseOR(self_bit(i)))).alias(w) for i, w in enumerate(words)))
        new = shared.cut(new.where(" or ".join(f"{w} <> 0" for w in words)), "reached")
        if new.isEmpty():
            break
        levels.append(new)
    bits = sum((F.bit_count(w).cast("long") for w in words), zero)
    out = None
    for depth, level in enumerate(levels, 1):
        part = level.groupBy("node").agg(F.sum(bits).alias("reached")).withColumn("depths", depth * F.col("reached"))
        out = part if out is None else out.unionByName(part)
    return shared.cut(out.groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("depths").alias("depths")), "counts")


def closeness_centrality(nodes: DataFrame, edges: DataFrame, high: int | None = None) -> DataFrame:
    """(node, score): Wasserman-Faust closeness over outgoing paths."""
    ids = _ids(nodes)
    n = ids.agg(F.count("*").alias("_n"))
    far = reach_counts(edges, high).select(F.col("node").alias("_s"), F.col("reached").alias("_r"), F.col("depths").alias("_d"))
    out = ids.join(far, F.col("id") == F.col("_s"), "left").join(F.broadcast(n))
    score = F.when((F.col("_d") > 0) & (F.col("_n") > 1), (F.col("_r") / F.col("_d")) * (F.col("_r") / (F.col("_n") - 1))).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias("node"), score.alias("score"))


def betweenness_centrality(nodes: DataFrame, edges: DataFrame, high: int | None = None) -> DataFrame:
    """(node, score): Brandes' algorithm on distinct directed edges, unweighted, over (n - 1)(n - 2).

    The forward pass counts shortest paths level by level for all sources at once, the backward pass
    adds dependencies from the deepest level up. Both are joins on (source, node), so the graph need not fit anywhere.
    """
    ids = shared.cut(_ids(nodes), "ids")
    n = ids.count()
    links = shared.cut(edges.select("source", "target").where("source <> target").distinct(), "links")
    level = ids.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths"))
    seen, levels = level, [level]
    for depth in count(1) if high is None else range(1, high + 1):
        step = levels[-1].join(links, F.col("node") == F.col("source")).groupBy("root", F.col("target").alias("node")).agg(F.sum("paths").alias("paths"))
        new = shared.cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "paths"), "level")
        if new.isEmpty():
            break
        levels.append(new)
        seen = shared.cut(seen.unionByName(new), "seen")
    credit = None
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):
        own = lower.withColumn("delta", F.lit(0.0)) if credit is None else lower.join(credit, ["root", "node"], "left").fillna(0.0, ["delta"])
        share = own.select("root", F.col("node").alias("target"), ((1 + F.col("delta")) / F.col("paths")).alias("_share")).join(links, "target")
        share = share.groupBy("root", F.col("source").alias("node")).agg(F.sum("_share").alias("_share"))
        below = upper.join(share, ["root", "node"]).select("root", "node", (F.col("paths") * F.col("_share")).alias("delta"))
        credit = shared.cut(below, "credit")
        total = credit.where("root <> node").select("node", "delta")
        levels_total = total if upper is levels[-2] else shared.cut(levels_total.unionByName(total), "total")
    scale = (n - 1) * (n - 2)
    if len(levels) < 2 or scale <= 0:
        return ids.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    summed = levels_total.groupBy(F.col("node").alias("_n")).agg(F.sum("delta").alias("_d"))
    return ids.join(summed, F.col("id") == F.col("_n"), "left").select(F.col("id").alias("node"), (F.coalesce("_d", F.lit(0.0)) / scale).alias("score"))


def combined_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The five centralities and their mean, per node."""
    parts = {
        "degree": degree_centrality(nodes, edges).select("node", "score"), "betweenness": betweenness_centrality(nodes, edges), "closeness": closeness_centrality(nodes, edges),
        "eigenvector": eigenvector_centrality(nodes, edges), "pagerank": pagerank(nodes, edges),
    }
    out = None
    for name, df in parts.items():
        df = df.withColumnRenamed("score", name)
        out = df if out is None else out.join(df, "node")
    return out.withColumn("combined", sum((F.col(c) for c in parts), F.lit(0.0)) / len(parts))


def top_nodes(scores: DataFrame, k: int, column: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(column), "node").limit(k)


def clustering(edges: DataFrame) -> DataFrame:
    """(node, triangles, degree, coefficient) on the simple undirected graph.

    Each triangle is found once, at its edge between the two nodes of lower degree, so a hub's wedges are not formed; a node's neighbours of
    higher degree, at most the root of twice the edges, are one array, and wedges move as such arrays.
    """
    simple = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    simple = shared.cut(simple, "simple")
    ends = simple.select(F.col("a").alias("node")).unionByName(simple.select(F.col("b").alias("node")))
    degree = shared.cut(ends.groupBy("node").agg(F.count("*").alias("degree")), "degree")
    da, db = (degree.select(F.col("node").alias(c), F.col("degree").alias(f"d{c}")) for c in "ab")
    ranked = simple.join(da, "a").join(db, "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    ends = lambda d, c: F.struct(F.col(d).alias("d"), F.col(c).alias("n"))
    arcs = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, ends("db", "b")).otherwise(ends("da", "a")).alias("high"))
    out = arcs.groupBy("low").agg(F.transform(F.array_sort(F.collect_list("high")), lambda x: x["n"]).alias("out"))
    out = shared.cut(out, "out")
    # to each higher neighbour go the neighbours still higher, as one row; those that it has too close triangles
    wedges = out.select("low", "out", F.posexplode("out").alias("_i", "mid")).select("low", "mid", F.expr("slice(out, _i + 2, size(out))").alias("rest")).where("size(rest) > 0")
    closed = wedges.join(out.select(F.col("low").alias("mid"), "out"), "mid").select("low", "mid", F.array_intersect("rest", "out").alias("top")).where("size(top) > 0")
    each = F.concat(F.array(*(F.struct(F.col(c).alias("n"), F.size("top").cast("long").alias("k")) for c in ("low", "mid"))), F.transform("top", lambda x: F.struct(x.alias("n"), F.lit(1).cast("long").alias("k"))))
    count = closed.select(F.explode(each).alias("_e")).groupBy(F.col("_e.n").alias("_n")).agg(F.sum("_e.k").alias("_t"))
    t, d = F.coalesce("_t", F.lit(0)), F.col("degree")
    score = F.when(d > 1, 2 * t / (d * (d - 1))).otherwise(F.lit(0.0))
    return degree.join(count, F.col("node") == F.col("_n"), "left").select("node", t.alias("triangles"), "degree", score.alias("coefficient"))


def global_clustering(local: DataFrame) -> DataFrame:
    """One row: closed triplets over triplets, and the mean of the local coefficients."""
    d = F.col("degree")
    return local.agg((2 * F.sum("triangles") / F.sum(d * (d - 1))).alias("global_clustering"), F.avg("coefficient").alias("average_clustering"))


def random_walks(edges: DataFrame, starts: DataFrame, length: int = 80, walks: int = 10, restart: float = 0.0, seed: int = 42) -> DataFrame:
    """(start, walk, path): weighted walks, reproducible by seed; a walk ends where no edge leads on.

    All walks advance together: a step is a join with cumulative edge weights, so no task holds the graph.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("target")
    merged = edges.groupBy("source", "target").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight")).where("weight > 0")
    total = F.sum("weight").over(Window.partitionBy("source"))
    high = F.sum("weight").over(w)
    steps = shared.cut(merged.select("source", "target", ((high - F.col("weight")) / total).alias("_lo"), (high / total).alias("_hi")), "steps")
    state = starts.select("start").distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select("start", "walk", F.col("start").alias("at"), F.array("start").alias("path"))
    for i in range(length):
        u = (F.pmod(F.xxhash64("start", "walk", F.lit(i), F.lit(seed)), F.lit(1 << 40)).cast("double")) / float(1 << 40)
        back = (F.pmod(F.xxhash64("start", "walk", F.lit(i), F.lit(seed + 1)), F.lit(1 << 40)).cast("double")) / float(1 << 40) < restart
        state = state.withColumn("_u", u).withColumn("_from", F.when(back, F.col("start")).otherwise(F.col("at")))
        moved = state.join(steps, (F.col("_from") == F.col("source")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")), "left")
        state = moved.select("start", "walk", F.coalesce("target", "_from").alias("at"), F.when(F.col("target").isNotNull(), F.concat("path", F.array("target"))).otherwise(F.col("path")).alias("path"))
        if (i + 1) % CUT_EVERY == 0:
            state = shared.cut(state, "walks")
    return state.select("start", "walk", "path")


def per_node(df: DataFrame, function, schema: str) -> DataFrame:
    """Apply a Python function of a pandas frame to batches of nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return df.mapInPandas(run, schema)
