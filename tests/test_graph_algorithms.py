"""Graph algorithms against plain Python on small random graphs."""

import heapq
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from strataflow.operators import centrality, community, components, paths


def graph(spark, seed, n=14, m=30):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(n), rng.randrange(n), round(rng.random(), 3), rng.randrange(1, 100)) for i in range(m)]
    nodes = spark.createDataFrame([(i, "A" if i % 3 else "B") for i in range(n)], "id long, node_type string")
    df = spark.createDataFrame([(i, a, b, w, t, w) for i, a, b, w, t in edges], "id long, source long, target long, weight double, created_at long, cost_signal double")
    return nodes, df, n, [(a, b, w, t) for _, a, b, w, t in edges]


def bfs(adj, start):
    depth = {start: 0}
    q = deque([start])
    while q:
        u = q.popleft()
        for v in adj[u]:
            if v not in depth:
                depth[v] = depth[u] + 1
                q.append(v)
    return depth


def adjacency(edges):
    adj = defaultdict(set)
    for a, b, *_ in edges:
        adj[a].add(b)
    return adj


def test_reach_gives_least_depth_once(spark):
    _, df, n, edges = graph(spark, 1)
    starts = spark.createDataFrame([(0,), (3,)], "start long")
    for high in (2, 6):
        found = {(r.start, r.node): r.depth for r in paths.reach(df, starts, 1, high).collect()}
        adj = adjacency(edges)
        assert found == {(s, v): d for s in (0, 3) for v, d in bfs(adj, s).items() if 0 < d <= high}


def test_shortest_paths_equal_dijkstra(spark):
    _, df, n, edges = graph(spark, 2)
    cost = {}
    for a, b, w, _ in edges:
        cost[a, b] = min(cost.get((a, b), 9.0), max(0.001, 1 - w))
    dist, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for (a, b), c in cost.items():
            if a == u and d + c < dist.get(b, 99):
                dist[b] = d + c
                heapq.heappush(heap, (d + c, b))
    found = {r.node: (r.cost, r.path) for r in paths.shortest_paths(paths.costs(df), spark.createDataFrame([(0,)], "start long")).collect()}
    assert {k: round(v[0], 6) for k, v in found.items()} == {k: round(v, 6) for k, v in dist.items()}
    for node, (c, path) in found.items():
        assert path[0] == 0 and path[-1] == node
        assert abs(sum(cost[a, b] for a, b in zip(path, path[1:])) - c) < 1e-6


def test_k_shortest_and_constrained(spark):
    nodes, df, n, edges = graph(spark, 3)
    every = [r for r in paths.simple_paths(paths.costs(df), spark.createDataFrame([(0,)], "start long"), 4).collect() if r.node == 5]
    best = sorted((round(r.cost, 9), r.path) for r in every)[:3]
    assert [(round(r.cost, 9), r.path) for r in paths.k_shortest(paths.costs(df), 0, 5, 3, 4).orderBy("rank").collect()] == best
    kinds = {r.id: r.node_type for r in nodes.collect()}
    good = sorted((round(r.cost, 9), r.path) for r in every if all(kinds[x] == "A" for x in r.path[1:-1]))
    got = paths.constrained_path(nodes, df, 0, 5, 4, avoid_types=["B"]).collect()
    assert [(round(r.cost, 9), r.path) for r in got] == good[:1]
    need = sorted((round(r.cost, 9), r.path) for r in every if {"A", "B"} <= {kinds[x] for x in r.path})
    got = paths.constrained_path(nodes, df, 0, 5, 4, require_types=["A", "B"]).collect()
    assert [(round(r.cost, 9), r.path) for r in got] == need[:1]


def test_temporal_reachability(spark):
    _, df, n, edges = graph(spark, 4)
    best = {0: 0}
    changed = True
    while changed:
        changed = False
        for a, b, _, t in edges:
            if a in best and t >= best[a] and t < best.get(b, 10**9):
                best[b] = t
                changed = True
    found = {r.node: r.arrival for r in paths.temporal_reach(df, spark.createDataFrame([(0,)], "start long"), hops=20).collect()}
    assert found == {k: v for k, v in best.items() if k != 0}
    end = max(found)
    path = paths.causal_path(df, 0, end, hops=20).first()
    assert path.path[0] == 0 and path.path[-1] == end and path.arrival == found[end]


def test_traverse_and_subgraph(spark):
    nodes, df, n, edges = graph(spark, 5)
    nodes = nodes.selectExpr("*", "0L as created_at")
    kinds = {r.id: r.node_type for r in nodes.collect()}
    window = adjacency((a, b) for a, b, _, t in edges if 20 <= t <= 90 and all(kinds[x] == "A" or x == 0 for x in (a, b)))
    got = {r.node: r.depth for r in paths.traverse(nodes.withColumn("created_at", F.lit(50)), df, 0, 1, 3, since=20, until=90, node_filter=F.col("node_type") == "A").collect()}
    assert got == {v: d for v, d in bfs(window, 0).items() if 0 < d <= 3}
    near, inner = paths.subgraph(nodes, df, 0, 2)
    both = defaultdict(set)
    for a, b, *_ in edges:
        both[a].add(b)
        both[b].add(a)
    ids = {v for v, d in bfs(both, 0).items() if d <= 2}
    assert {r.id for r in near.collect()} == ids
    assert inner.count() == sum(a in ids and b in ids for a, b, *_ in edges)
    maximal = {tuple(r.path) for r in paths.traverse(nodes, df, 0, 1, 2, mode="paths").collect()}
    adj = adjacency(edges)
    expected = set()
    for a in adj[0] - {0}:
        tails = adj[a] - {0, a}
        expected |= {(0, a, b) for b in tails} if tails else {(0, a)}
    assert maximal == expected


@pytest.mark.parametrize("seed", [6, 7])
def test_components(spark, seed):
    nodes, df, n, edges = graph(spark, seed, 16, 14)
    both = defaultdict(set)
    for a, b, *_ in edges:
        both[a].add(b)
        both[b].add(a)
    weak = {r.node: r.component for r in components.connected_components(nodes, df).collect()}
    assert weak == {i: min(bfs(both, i)) for i in range(n)}
    adj = adjacency(edges)
    seen = {i: set(bfs(adj, i)) for i in range(n)}
    strong = {r.node: r.component for r in components.strongly_connected_components(nodes, df).collect()}
    assert strong == {i: max(j for j in range(n) if j in seen[i] and i in seen[j]) for i in range(n)}


def test_pagerank_with_dangling_nodes(spark):
    nodes, df, n, edges = graph(spark, 8, 10, 15)
    out = defaultdict(list)
    for a, b, *_ in edges:
        out[a].append(b)
    r = {i: 1 / n for i in range(n)}
    for _ in range(60):
        lost = sum(r[i] for i in range(n) if not out[i])
        r = {i: 0.15 / n + 0.85 * (lost / n + sum(r[a] / len(out[a]) for a in out for b in out[a] if b == i)) for i in range(n)}
    found = {x.node: x.score for x in centrality.pagerank(nodes, df, rounds=60, tolerance=1e-9).collect()}
    assert all(abs(found[i] - r[i]) < 1e-6 for i in range(n)) and abs(sum(found.values()) - 1) < 1e-6


def test_closeness_and_betweenness(spark):
    nodes, df, n, edges = graph(spark, 9, 10, 18)
    adj = adjacency((a, b) for a, b, *_ in edges if a != b)
    for r in centrality.closeness_centrality(nodes, df).collect():
        d = {k: v for k, v in bfs(adj, r.node).items() if v > 0}
        assert abs(r.score - ((len(d) / sum(d.values())) * (len(d) / (n - 1)) if d else 0)) < 1e-9
    score = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        depth, count, order = bfs(adj, s), defaultdict(float), []
        count[s] = 1.0
        for u in sorted(depth, key=depth.get):
            order.append(u)
            for v in adj[u]:
                if depth[v] == depth[u] + 1:
                    count[v] += count[u]
        delta = defaultdict(float)
        for u in reversed(order):
            for v in adj[u]:
                if depth.get(v) == depth[u] + 1:
                    delta[u] += count[u] / count[v] * (1 + delta[v])
            if u != s:
                score[u] += delta[u]
    found = {r.node: r.score for r in centrality.betweenness_centrality(nodes, df).collect()}
    assert all(abs(found[i] - score[i] / ((n - 1) * (n - 2))) < 1e-9 for i in range(n))


def test_clustering(spark):
    _, df, n, edges = graph(spark, 10, 10, 30)
    adj = defaultdict(set)
    for a, b, *_ in edges:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    for r in centrality.clustering(df).collect():
        t = sum(b in adj[a] for a in adj[r.node] for b in adj[r.node]) // 2
        assert (r.triangles, r.degree) == (t, len(adj[r.node]))


def test_two_cliques_are_two_communities(spark):
    pairs = [(a, b) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a < b] + [(3, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source long, target long, weight double")
    nodes = spark.range(8)
    expected = {i: 0 if i < 4 else 4 for i in range(8)}
    found = {r.node: r.community for r in community.louvain(nodes, edges).collect()}
    assert found == expected
    c = spark.createDataFrame(list(expected.items()), "node long, community long")
    m = len(pairs)
    q = 2 * (6 / m - (13 / (2 * m)) ** 2)
    assert abs(community.modularity(edges, c).first()[0] - q) < 1e-9
    assert {r.node for r in community.label_propagation(nodes, edges).collect()} == set(range(8))


def test_random_walks_follow_edges_and_repeat(spark):
    _, df, n, edges = graph(spark, 11)
    starts = spark.createDataFrame([(0,), (1,)], "start long")
    walks = centrality.random_walks(df, starts, 6, 3)
    first = sorted((r.start, r.walk, tuple(r.path)) for r in walks.collect())
    again = sorted((r.start, r.walk, tuple(r.path)) for r in centrality.random_walks(df, starts, 6, 3).collect())
    pairs = {(a, b) for a, b, *_ in edges}
    assert first == again and all((x, y) in pairs for _, _, p in first for x, y in zip(p, p[1:]))
