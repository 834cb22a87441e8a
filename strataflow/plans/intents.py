"""Structured intents: what a question asks for, as data, answered by the engine's operators.

An intent is a mapping with a ``kind``; the words of a question are not read here, so no model is needed. ``answer`` gives a
DataFrame; ``fused`` runs several intents and fuses their ranked results by reciprocal ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.model import Graph
from strataflow.operators import analytics, centrality, memory, paths, search

#: Kinds of intents, and what each must say.
KINDS = {
    "node_count": (), "edge_count": (), "count_by_type": (), "average_degree": (), "stats": (), "sum_property": ("property",), "group_by_count": ("property",), "min_max_property": ("property", "find_min"),
    "shortest_path": ("start", "end"), "k_shortest": ("start", "end", "k"), "neighbours": ("start",), "subgraph": ("start",), "ranking": ("metric",), "temporal": ("start", "direction"),
    "ledger_balance": (), "current_state": (), "preference_ranking": (), "tree_children": ("parent",), "words": ("terms",),
}


def check(intent: dict) -> None:
    if intent.get("kind") not in KINDS:
        raise ValueError(f"unknown intent {intent.get('kind')!r}")
    missing = [f for f in KINDS[intent["kind"]] if intent.get(f) is None]
    if missing:
        raise ValueError(f"{intent['kind']} needs {', '.join(missing)}")


def answer(graph: Graph, intent: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of one intent. ``tables``: ledger, states, preferences, tree, texts, as their operators take them.

    ``node_type`` narrows aggregates; ``negated`` turns a ranking or a list of nodes into what it leaves out.
    """
    check(intent)
    nodes, edges, t = graph.nodes, graph.edges, tables or {}
    kind, of_type = intent["kind"], intent.get("node_type")
    some = nodes if of_type is None else nodes.where(analytics.by_type(of_type))
    match kind:
        case "node_count":
            return some.agg(F.count("*").alias("value"))
        case "edge_count":
            return analytics.edges_of(edges, intent.get("edge_type")).agg(F.count("*").alias("value"))
        case "count_by_type":
            return analytics.count_by_type(some)
        case "average_degree":
            ends = nodes.agg(F.count("*").alias("_n")).join(F.broadcast(edges.agg(F.count("*").alias("_e"))))  # one row each
            return ends.select(F.when(F.col("_n") > 0, 2.0 * F.col("_e") / F.col("_n")).otherwise(0.0).alias("value"))
        case "stats":
            return analytics.graph_metrics(nodes, edges)
        case "sum_property" | "min_max_property" | "group_by_count":
            how = {"sum_property": "sum", "group_by_count": "count"}.get(kind) or ("min" if intent["find_min"] else "max")
            return analytics.property_aggregate(nodes, intent["property"], how, of_type)
        case "shortest_path":
            one = edges.sparkSession.range(1).select(F.lit(intent["start"]).cast("long").alias("start"))
            goal = one.select(F.lit(intent["end"]).cast("long").alias("node"))
            return paths.shortest_paths(paths.costs(edges), one, goal).select("cost", "path")
        case "k_shortest":
            return paths.k_shortest(paths.costs(edges), intent["start"], intent["end"], intent["k"])
        case "neighbours":
            near = paths.neighbours(edges, intent["start"], intent.get("hops", 1), intent.get("edge_direction", "both"))
            return _not(nodes, near) if intent.get("negated") else near
        case "subgraph":
            return paths.subgraph(nodes, edges, intent["start"], intent.get("radius", 2))[1].select("source", "target", "assoc_type")
        case "ranking":
            if intent["metric"] == "centrality":
                scores = centrality.combined_centrality(nodes, edges).select("node", F.col("combined").alias("score"))
            else:
                scores = {"pagerank": centrality.pagerank, "degree": centrality.degree_centrality}[intent["metric"]](nodes, edges).select("node", "score")
            order = F.col("score").asc() if intent.get("negated") else F.col("score").desc()
            return scores.orderBy(order, "node").limit(intent.get("limit", 10))  # a report
        case "temporal":
            one = edges.sparkSession.range(1).select(F.lit(intent["start"]).cast("long").alias("start"))
            if intent["direction"] == "before":  # time runs backwards along reversed edges
                back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), (-F.col("created_at")).alias("created_at"), "weight")
                low = None if intent.get("until") is None else -intent["until"]
                return paths.temporal_reach(back, one, since=low if low is not None else -(1 << 62), hops=None).select("node", (-F.col("arrival")).alias("arrival"))
            return paths.temporal_reach(edges, one, intent.get("since"), intent.get("until"), hops=None).select("node", "arrival")
        case "ledger_balance":
            balance = memory.ledger_balance(t["ledger"])
            return balance if intent.get("key") is None else balance.where(F.col("key") == intent["key"])
        case "current_state":
            state = memory.current_state(t["states"])
            return state if intent.get("entity") is None else state.where(F.col("entity") == intent["entity"])
        case "preference_ranking":
            ranked = memory.rank_preferences(t["preferences"])
            return ranked if intent.get("entity") is None else ranked.where(F.col("entity") == intent["entity"])
        case "tree_children":
            return memory.children(t["tree"], intent["parent"])
    return search.bm25(t["texts"], [w.lower() for w in intent["terms"]], intent.get("key", "doc_id"))


def _not(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, nodes["id"] == found["node"], "left_anti").select(F.col("id").alias("node"))


def fused(graph: Graph, intents: list[dict], tables: dict[str, DataFrame] | None = None, key: str = "node", per_source: int = 50, k: int = 10) -> DataFrame:
    """(key, score): the ranked results of several intents with a ``key`` column, fused by reciprocal ranks."""
    lists = []
    for intent in intents:
        found = answer(graph, intent, tables)
        score = F.col("score") if "score" in found.columns else -F.col("depth").cast("double") if "depth" in found.columns else F.lit(1.0)
        lists.append(search.ranked(found.select(key, score.alias("score")), key, per_source))
    return search.top(search.rrf(lists, key), k, key)
