"""What the operators write, move and repeat, counted on small graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.operators import centrality, paths


@pytest.fixture()
def written(monkeypatch):
    """The numbers of rows of the tables that shared.cut() writes, by name."""
    found, cut = defaultdict(list), shared.cut

    def counted(df, name="step", *args, **kwargs):
        out = cut(df, name, *args, **kwargs)
        found[name].append(out.count())
        return out

    monkeypatch.setattr(shared, "cut", counted)
    return found


def test_closeness_writes_no_pairs(spark, written):
    """30 nodes reach 200 others in two hops and 50 more in three: 7,550 pairs, but ids in a row share rows; ids may be negative."""
    pairs = [(i, 1000 + i % 2) for i in range(30)] + [(1000 + k, 2000 + j) for k in (0, 1) for j in range(200)] + [(2000, -60 + j) for j in range(50)] + [(3, 3), (1000, 0)]
    edges = spark.createDataFrame(pairs, "source long, target long")
    ids = {x for p in pairs for x in p}
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
    found = {r.node: r.score for r in centrality.closeness_centrality(spark.createDataFrame([(i,) for i in ids], "id long"), edges).collect()}
    for s in ids:
        depth, now = {s: 0}, {s}
        while now:
            now = {b for a in now for b in adj[a]} - depth.keys()
            depth.update(dict.fromkeys(now, 1 + max(depth.values())))
        r, d = len(depth) - 1, sum(depth.values())
        assert found[s] == pytest.approx(r / d * r / (len(ids) - 1) if r else 0, abs=1e-12)
    assert sum(map(sum, written.values())) < 2000


def test_pagerank_without_cycles_settles_in_the_depth_of_the_graph(spark, written):
    """Before, what dangling nodes give back kept the rounds going until 0.85 ** rounds was small."""
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5), (0, 5)], "source long, target long")
    out = {0: [1, 2, 5], 1: [3], 2: [3], 3: [4], 4: [5], 5: [], 6: []}
    for start in (None, 0):
        written.clear()
        base = {i: 1 / 7 if start is None else float(i == start) for i in out}
        r = dict(base)
        for _ in range(300):
            lost = sum(r[i] for i in out if not out[i])
            r = {i: 0.15 * base[i] + 0.85 * (lost * base[i] + sum(r[a] / len(out[a]) for a in out if i in out[a])) for i in out}
        restart = None if start is None else spark.createDataFrame([(start,)], "id long")
        found = {x.node: x.score for x in centrality.pagerank(spark.range(7), edges, tolerance=1e-9, restart=restart).collect()}
        assert found == {i: pytest.approx(v, abs=1e-12) for i, v in r.items()}
        assert len(written["rank"]) <= 7


def test_eigenvector_rounds_hold_scored_nodes_only(spark, written):
    edges = spark.createDataFrame([(i, 100 + i) for i in range(50)] + [(100, 200)], "source long, target long")
    nodes = spark.createDataFrame([(i,) for i in [*range(50), *range(100, 150), 200]], "id long")
    assert {r.score for r in centrality.eigenvector_centrality(nodes, edges, tolerance=1e-9).collect()} == {0.0}
    assert written["eigen"] == [101, 51, 1, 0]


def test_triangles_move_as_arrays(spark, written):
    """A clique of 12: 220 wedges would be rows; its arrays are 11."""
    pairs = [(a, b) for a in range(12) for b in range(a)]
    found = {r.node: (r.triangles, r.degree) for r in centrality.clustering(spark.createDataFrame(pairs, "source long, target long")).collect()}
    assert found == dict.fromkeys(range(12), (55, 11)) and written["out"] == [11]


def test_arrivals_by_slices_of_time(spark, written, monkeypatch):
    """Two starts, edges of equal times in any order, slices of a few edges; no arrival is written twice."""
    monkeypatch.setattr(paths, "SLICE", 12)
    rng = random.Random(5)
    edges = [(rng.randrange(15), rng.randrange(15), rng.randrange(12)) for _ in range(40)]
    expected = {}
    for start in (0, 7):
        best, changed = {start: 0}, True
        while changed:
            changed = False
            for a, b, t in edges:
                if a in best and t >= best[a] and t < best.get(b, 99):
                    best[b], changed = t, True
        expected |= {(start, v): t for v, t in best.items() if v != start}
    e = spark.createDataFrame(edges, "source long, target long, created_at long").repartition(3)
    rows = paths.earliest_arrivals(e, spark.createDataFrame([(0,), (7,)], "start long")).collect()
    assert len(rows) == len(expected) and {(r.start, r.node): r.arrival for r in rows} == expected and len(written["arrivals"]) > 3


def test_batches_of_a_stream_do_not_grow(spark, monkeypatch):
    from strataflow.queries import records
    from strataflow.streaming import events

    monkeypatch.setattr(records, "STEP", 16)
    rows, files = [("d", i, [i - 1] if i else []) for i in range(50)], []
    read = events.read_events
    monkeypatch.setattr(events, "read_events", lambda s, path, *a: files.extend(r[1] for r in s.read.parquet(path).groupBy(F.input_file_name()).count().collect()) or read(s, path, *a))
    found = records._run(spark, spark.createDataFrame(rows, "domain string, event_id long, parents array<long>"), events.causally_ordered, parts=2, at="event_id").collect()
    assert sorted(r.event_id for r in found) == list(range(50)) and max(files) <= 16 and sum(files) == 50


def test_labels_settle_and_moves_alone_are_written(spark, written):
    from strataflow.operators import community

    pairs = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b]
    found = community.label_propagation(spark.range(8), spark.createDataFrame(pairs, "source long, target long, weight double"))
    labels = {r.node: r.community for r in found.collect()}
    assert len(labels) == 8 and all(len({labels[i] for i in g}) == 1 for g in (range(4), range(4, 8)))
    assert written["moves"][-3:] == [0, 0, 0] and all(n <= 8 for n in written["moves"])
