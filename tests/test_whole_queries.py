"""Queries over whole tables and graphs against plain Python, on small tables with ids beyond the ranges that other queries keep to."""

import datetime as dt
import heapq
import random
from collections import Counter

import pytest

from strataflow.operators import centrality, paths
from strataflow.queries import QUERIES

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables, and their rows."""
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("small")
    events = [(i, START + dt.timedelta(minutes=30 * i + rng.randint(0, 29)), rng.choice([1, 2, 29, 30, 31, 40, 77]), rng.choice(["error", "click"]), round(rng.uniform(0, 200), 3), "{}") for i in range(160)]
    customers = [(k, f"Customer{k}", k % 3, 1.0 * k, "BUILDING") for k in (1, 2, 150, 199, 200, 201, 900)]
    orders = [(i, rng.choice([1, 150, 200, 900]), rng.choice("FOP"), 10.0 * i, START + dt.timedelta(days=i), "5-LOW") for i in range(1, 26)]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    write("customer", customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    write("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    for name in ("region", "nation", "supplier", "part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), {"events": events, "customer": customers, "orders": orders}


def test_error_overlaps_of_all_users(spark, small):
    folder, rows = small
    states = []
    for user in {e[2] for e in rows["events"]}:
        own = sorted((e[1], e[0], e[3]) for e in rows["events"] if e[2] == user)
        ends = [x[0] for x in own[1:]] + [dt.datetime(2024, 2, 1)]
        states += [(user, i, t, end) for (t, i, kind), end in zip(own, ends) if kind == "error"]
    expected = sorted((a[1], b[1]) for a in states for b in states if a[0] < b[0] and a[2] < b[3] and b[2] < a[3])
    found = sorted((r.a, r.b) for r in QUERIES["interval_join_errors"](spark, folder).collect())
    assert found == expected


def test_statuses_of_all_customers(spark, small):
    folder, rows = small
    expected = Counter((o[1], o[2]) for o in rows["orders"])
    expected.update((c[0], "none") for c in rows["customer"] if c[0] not in {o[1] for o in rows["orders"]})
    found = {(r.k, r.status): r.n for r in QUERIES["coalesce_case_fns"](spark, folder).collect()}
    assert found == expected and (900, "F") in found and (201, "none") in found


@pytest.fixture(scope="module")
def routes(spark, tmp_path_factory):
    """A folder with events of nine users, and the edges between consecutive ones: (source, target, time, cost)."""
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("routes")
    users = [0, 2, 3, 4, 5, 6, 1] + [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(40)]
    # cheap along the first seven events, dear elsewhere
    events = [(i, START + dt.timedelta(hours=i), u, "click", rng.uniform(185, 199) if i < 7 else rng.uniform(0, 60), "{}") for i, u in enumerate(users)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder), [(a[2], b[2], b[1], max(0.001, 1 - b[4] / 200)) for a, b in zip(events, events[1:])]


def test_cheapest_paths_of_any_length_equal_dijkstra(spark, routes):
    folder, edges = routes
    dist, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        for a, b, _, c in edges:
            if a == u and d == dist[u] and d + c < dist.get(b, 99):
                dist[b] = d + c
                heapq.heappush(heap, (d + c, b))
    expected = {u: round(d, 6) for u, d in dist.items() if u}
    assert {r.node: r.cost for r in QUERIES["shortest_paths"](spark, folder).collect()} == expected


def test_earliest_arrivals_by_routes_of_any_length(spark, routes):
    folder, edges = routes
    arrival = {0: START}
    for a, b, t, _ in edges:  # in order of time
        if a in arrival and t >= arrival[a]:
            arrival.setdefault(b, t)
    nanos = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 10**9
    expected = {u: nanos(t) for u, t in arrival.items() if u}
    assert {r.node: r.arrival for r in QUERIES["temporal_reachability"](spark, folder).collect()} == expected


def simple_paths(edges, path, end):
    if path[-1] == end:
        yield path
        return
    for b in sorted({b for a, b, *_ in edges if a == path[-1] and b not in path}):
        yield from simple_paths(edges, [*path, b], end)


def test_k_cheapest_paths_of_any_length(spark, routes):
    folder, edges = routes
    cost = {}
    for a, b, _, c in edges:
        cost[a, b] = min(cost.get((a, b), 9), c)
    every = sorted((round(sum(cost[x] for x in zip(p, p[1:])), 6), "-".join(map(str, p))) for p in simple_paths(edges, [0], 1))
    found = sorted((r.cost, r.path) for r in QUERIES["k_shortest_paths"](spark, folder).collect())
    assert found == every[:3] and max(p.count("-") for _, p in found) > 2
    priced = spark.createDataFrame([(*k, c) for k, c in cost.items()], "source long, target long, cost double")
    more = paths.k_shortest(priced, 0, 1, k=40, high=None).orderBy("rank").collect()  # more than ways through single edges
    assert [round(r.cost, 6) for r in more] == [c for c, _ in every[:40]]
    assert paths.k_shortest(priced, 0, 0, k=2, high=None).collect() == []


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A folder with the tables of a small commerce graph, its nodes and its edges (source, target, weight)."""
    rng = random.Random(21)
    folder, at = tmp_path_factory.mktemp("shop"), START
    rows = {
        "region": ("r_regionkey int, r_name string", [(k, f"R{k}") for k in range(2)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(k, f"N{k}", k % 2) for k in range(3)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"C{k}", k % 3, 1.0, "X") for k in range(1, 6)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"S{k}", k % 3, 1.0) for k in range(1, 4)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, f"P{k}", "b", "t", 1, 1.0) for k in range(1, 5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", [(k, rng.randint(1, 5), "F", 1.0, at, "5-LOW") for k in range(1, 9)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
            [(rng.randint(1, 8), rng.randint(1, 4), rng.randint(1, 3), k, 1.0, 1.0, rng.randint(1, 10) / 100, 0.0, "N", "O", at) for k in range(1, 21)],
        ),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    kinds = {"customer": 1, "orders": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6}
    nodes = [kind * 10**12 + x[0] for name, kind in kinds.items() for x in rows[name][1]]
    n = lambda kind, key: kind * 10**12 + key
    edges = [(n(1, x[1]), n(2, x[0]), 1.0) for x in rows["orders"][1]] + [(n(1, x[0]), n(5, x[2]), 1.0) for x in rows["customer"][1]] + [(n(4, x[0]), n(5, x[2]), 1.0) for x in rows["supplier"][1]]
    edges += [(n(5, x[0]), n(6, x[2]), 1.0) for x in rows["nation"][1]] + [(n(2, x[0]), n(3, x[1]), x[6]) for x in rows["lineitem"][1]] + [(n(3, x[1]), n(4, x[2]), x[6]) for x in rows["lineitem"][1]]
    return str(folder), nodes, edges


def scores(df):
    return {r[0]: r["score"] for r in df.collect()}


@pytest.mark.parametrize("name", ["pagerank_all", "personalized_pagerank_all"])
def test_pagerank_of_the_whole_graph(spark, shop, name):
    folder, nodes, edges = shop
    out = Counter(a for a, *_ in edges)
    base = {u: 1 / len(nodes) if name == "pagerank_all" else float(u == 10**12 + 1) for u in nodes}
    rank = dict(base)
    for _ in range(400):
        stuck = sum(rank[u] for u in nodes if not out[u])
        new = {u: (0.15 + 0.85 * stuck) * base[u] for u in nodes}
        for a, b, _w in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    found = scores(QUERIES[name](spark, folder))
    assert set(found) == set(nodes) and all(abs(found[u] - rank[u]) < 1e-7 for u in nodes)


def test_degree_closeness_betweenness_and_eigenvector_of_the_whole_graph(spark, shop):
    folder, nodes, edges = shop
    n, after, dist, ways = len(nodes), {u: {b for a, b, _ in edges if a == u} for u in nodes}, {}, {}
    for s in nodes:
        dist[s], ways[s], level = {s: 0}, Counter({s: 1}), [s]
        while level:
            for u in level:
                for v in after[u]:
                    if dist[s].setdefault(v, dist[s][u] + 1) == dist[s][u] + 1:
                        ways[s][v] += ways[s][u]
            level = [v for v, d in dist[s].items() if d == dist[s][level[0]] + 1]
    out = Counter(a for a, *_ in edges)
    close = {s: (len(d) - 1) ** 2 / sum(d.values()) / (n - 1) if len(d) > 1 else 0.0 for s, d in dist.items()}
    between = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nodes if s != v and v in dist[s] for t in dist[v] if t not in (s, v) and dist[s][v] + dist[v][t] == dist[s][t]) / (n - 1) / (n - 2) for v in nodes}
    for name, expected in {"degree_centrality": {u: out[u] / (n - 1) for u in nodes}, "closeness": close, "betweenness": between, "eigenvector": dict.fromkeys(nodes, 0.0)}.items():
        found = scores(QUERIES[name](spark, folder))
        assert set(found) == set(nodes) and all(abs(found[u] - expected[u]) < 1e-8 for u in nodes), name


def modularity(edges, of):
    m = sum(w for *_, w in edges)
    inner, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[of[a]] += w
        degree[of[b]] += w
        inner[of[a]] += w * (of[a] == of[b])
    return sum(inner[c] / m - (degree[c] / 2 / m) ** 2 for c in degree)


def test_communities_of_the_whole_graph(spark, shop):
    folder, nodes, edges = shop
    up = {a: b for a, b, _ in edges if b >= 5 * 10**12}
    region = {u: up[up[u]] if u in up and up[u] in up else up.get(u, u) for u in nodes}
    region |= {b: region[a] for a, b, _ in edges if 2 * 10**12 <= b < 3 * 10**12}
    assert abs(QUERIES["modularity_by_region"](spark, folder).first()[0] - modularity(edges, region)) < 1e-6
    found = {r.node: r.community for r in QUERIES["louvain"](spark, folder).collect()}
    assert set(found) == set(nodes) and modularity(edges, found) > modularity(edges, {u: u for u in nodes}) + 0.1
    found = {r.node: r.community for r in QUERIES["label_propagation"](spark, folder).collect()}
    assert set(found) == set(nodes)
    for u in nodes:  # settled: no other label has more weight around a node
        votes = Counter()
        for a, b, w in edges:
            if u in (a, b):
                votes[found[b if u == a else a]] += w
        assert not votes or votes[found[u]] >= max(votes.values()) - 1e-9


def test_searches_go_beyond_fifty_hops(spark):
    """By the operators' defaults, along a chain of 53 nodes."""
    n = 53
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(n - 1)], "source long, target long, cost double").coalesce(1)
    one = spark.createDataFrame([(0,)], "start long")
    assert {r.node: r.cost for r in paths.shortest_paths(edges, one).collect()} == {i: i / 2 for i in range(n)}
    close = scores(centrality.closeness_centrality(spark.range(n).coalesce(1), edges))
    assert abs(close[0] - (n - 1) / (n * (n - 1) / 2)) < 1e-12
