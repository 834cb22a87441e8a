"""Whole-graph measures, constrained paths, causes, parsers and intents against plain Python."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import text as X
from strataflow.model import Graph
from strataflow.operators import analytics, inference, paths, search
from strataflow.plans import intents
from strataflow.streaming import ingest


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def line(spark):
    """A chain of 16 nodes, a dear shortcut, and a lone node; types alternate."""
    nodes = spark.createDataFrame([(i, "Tool" if i % 4 == 3 else "Concept", "Thing", f"n{i}", i, {"size": str(i)}) for i in range(17)], "id long, node_type string, concept_type string, label string, created_at long, props map<string,string>")
    edges = [(i, i, i + 1, "road:next", 1.0, 0.9, i) for i in range(15)] + [(99, 0, 15, "road:leap", 0.2, -9.0, 3)]
    edges = spark.createDataFrame(edges, "id long, source long, target long, assoc_type string, weight double, cost_signal double, created_at long").withColumn("edge_kind", F.lit("Association"))
    return Graph.of(nodes, edges)


def test_metrics(line):
    m = analytics.graph_metrics(line.nodes, line.edges).first()
    hops = [1 if (a, b) == (0, 15) else b - a for a in range(16) for b in range(a + 1, 16)]
    assert (m.nodes, m.edges, m.components, m.largest_component, m.diameter) == (17, 16, 2, 16, max(hops))
    assert abs(m.average_path_length - sum(hops) / len(hops)) < 1e-9 and abs(m.average_degree - 32 / 17) < 1e-9


def test_filters(line):
    assert rows(line.nodes.where(analytics.by_type("tool")).select("id")) == [(11,), (15,), (3,), (7,)]
    assert line.nodes.where(analytics.created(3, 6)).count() == 2
    assert rows(analytics.with_degree(line.nodes, line.edges, 2, "out").select("id")) == [(0,)]
    assert analytics.edges_of(line.edges, "road", min_weight=0.5).count() == 15
    assert rows(analytics.by_property(line.nodes, "size", low=4, high=5).select("id")) == [(4,), (5,)]
    assert analytics.property_aggregate(line.nodes, "size", "sum", "Tool").first().value == 36.0


def test_paths_of_many_edges(spark, line):
    priced = paths.costs(line.edges)
    found = paths.k_shortest(priced, 0, 15, 2).collect()
    assert [len(r.path) for r in sorted(found, key=lambda r: r.rank)] == [16, 2]
    assert len(paths.constrained_path(line.nodes, line.edges, 0, 15).first().path) == 16
    assert paths.constrained_path(line.nodes, line.edges, 0, 15, max_length=5).first().path == [0, 15]
    assert paths.constrained_path(line.nodes, line.edges, 0, 15, avoid_types=["Tool"]).first().path == [0, 15]
    assert len(paths.constrained_path(line.nodes, line.edges, 0, 14, require_types=["Tool"]).first().path) == 15
    assert paths.constrained_path(line.nodes, line.edges, 0, 2, require_types=["Tool"]).count() == 0


def test_long_chains_of_causes(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 61)], "event_id long, parent long")
    assert inference.cycles(chain).count() == 0 and inference.ancestors_of(chain.where("event_id > 30"), 60).count() == 30
    ring = chain.unionByName(spark.createDataFrame([(5, 9)], "event_id long, parent long"))
    assert rows(inference.cycles(ring)) == sorted(((i,) for i in range(5, 61)), key=str)


def test_intents(line):
    ask = lambda **i: intents.answer(line, i)
    assert ask(kind="node_count").first().value == 17 and ask(kind="edge_count", edge_type="road:leap").first().value == 1
    assert len(ask(kind="shortest_path", start=0, end=15).first().path) == 16
    assert ask(kind="min_max_property", property="size", find_min=False).first().value == 16.0
    assert rows(ask(kind="temporal", start=3, direction="after").select("node"))[0] == (10,)
    assert rows(ask(kind="neighbours", start=16, negated=True)) == sorted(((i,) for i in range(17)), key=str)
    top = intents.fused(line, [{"kind": "neighbours", "start": 0, "hops": 2}, {"kind": "neighbours", "start": 4, "hops": 2}], k=3).collect()
    assert top[0].node == 2
    for bad in ({"kind": "what"}, {"kind": "shortest_path", "start": 1}):
        with pytest.raises(ValueError):
            intents.check(bad)


def test_text_expressions_equal_python(spark):
    texts = ["The dog's well-known running, of A!", "classes ponies rationalization hopping falling", "", None, "it’s state-of-the-art (really)", "  x  "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.search_terms(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in got} == {t: X.words(t) for t in texts}
    numbers = ["twenty-five", "1.5k", "$1,200", "two hundred and six", "one thousand", "fish", None, "", "and five", "-3", "three million two", "5 hundred"]
    got = spark.createDataFrame([(t,) for t in numbers], "t string").select("t", X.number_of(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: X.parse_number(t) for t in numbers}


def test_superseded_results(spark):
    e = [(1, 2, "Tokyo", "location:lives_in", 1, 5, None), (1, 3, "Berlin", "location:lives_in", 5, None, None), (1, 4, "Sushi bar", "food:eats_at", 2, None, {"depends_on": "lives in Tokyo"}), (9, 8, "Oslo", "note", 1, 2, None)]
    edges = spark.createDataFrame(e, "source long, target long, label string, assoc_type string, valid_from long, valid_until long, props map<string,string>")
    assert rows(search.superseded_targets(edges)) == [(2,)]  # 4 depends on it, but is itself current
    cut = edges.where("target <> 4").unionByName(spark.createDataFrame([(1, 4, "Sushi bar", "eats", 2, None, {"depends_on": "lives in Tokyo"})], edges.schema))
    assert rows(search.superseded_targets(cut)) == [(2,), (4,)]
    results = spark.createDataFrame([(2, 1.0), (3, 1.0), (7, 1.0)], "node long, score double")
    assert rows(search.valid_results(results, edges)) == [(3, 1.0), (7, 1.0)]
    assert rows(search.anchored_results(results, edges, 1)) == [(2, 0.5), (3, 1.5), (7, 1.0)]


def test_requests_that_lack_something_are_rejected(spark):
    bodies = ['{"kind": "simple", "agent_id": "a", "action": "x", "ts": 1}', '{"kind": "simple", "ts": 1}', "{broken", '{"kind": "transaction", "payer": "a", "payee": "b", "amount": -1, "ts": 1}', '{"kind": "odd", "ts": 1}', '{"kind": "state_change", "entity": "e", "new_state": "on"}']
    r = ingest.requests(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert sorted((x.reason for x in r.collect()), key=str) == sorted([None, "simple needs agent_id", "unknown kind", "the amount must be positive", "unknown kind", "no time"], key=str)
    assert ingest.events(r).count() == 1 and ingest.rejected(r).count() == 5
