import pytest

from strataflow.model import Graph
from strataflow.plans.parser import parse
from strataflow.session import Engine
from strataflow.streaming import subscriptions as S

DELTAS = S.DELTAS


def engine(spark):
    nodes = spark.createDataFrame([(1, "Concept", "Person", "Alice", 0), (2, "Concept", "Location", "London", 0), (3, "Concept", "Location", "Berlin", 0)], "id long, node_type string, concept_type string, label string, created_at long")
    edges = spark.createDataFrame([(1, 1, 2, "Association", "location:lives_in", 0)], "id long, source long, target long, edge_kind string, assoc_type string, created_at long")
    return Engine(spark, Graph.of(nodes, edges), now=1000)


def deltas(spark, *rows):
    return spark.createDataFrame(rows, DELTAS)


@pytest.mark.parametrize(
    "text, incremental",
    [("MATCH (a)-[r:location]->(b) RETURN a.name, b.name", True), ("MATCH (a)-[r:location]->(b) RETURN b.name, count(*) AS n", True), ("MATCH (a)-[*1..2]->(b) RETURN b.name", False),
     ("MATCH (a)-[r:location]->(b) RETURN count(a) AS n, min(b.name) AS low, max(a.id) AS high, sum(b.id) AS total, avg(a.id) AS mean, collect(b.name) AS names", True),
     ("MATCH (a)-[r:location]->(b) RETURN b.name, count(*) AS n ORDER BY n", False),
     ("MATCH (a:Person) WHERE a.id > 0 RETURN a.name", True), ("MATCH (a)-[r]->(b) WHERE open_ended(r) RETURN a.name", False)],
)
def test_classification_and_maintenance(spark, text, incremental):
    e = engine(spark)
    sub = e.execute(f"SUBSCRIBE {text}")
    assert sub.incremental == incremental
    batches = [
        deltas(spark, (1, "superseded", "edge", 1, 1, 2, "location:lives_in", None, 500), (2, "added", "edge", 2, 1, 3, "location:lives_in", None, None)),
        deltas(spark, (3, "added", "node", 9, None, None, "Person", None, None), (4, "added", "edge", 3, 9, 3, "location:lives_in", None, None)),
        deltas(spark, (5, "removed", "node", 9, None, None, "Person", None, None)),
        deltas(spark, (6, "merged", "node", 3, None, 2, "Location", None, None)),
    ]
    for b in batches:
        S.push(e, b)
        expected = sorted(map(tuple, e.query(text).collect()), key=str)
        assert sorted(map(tuple, sub.result.collect()), key=str) == expected
    seen = []
    S.on_change(sub, lambda i, d: seen.append((i.count(), d.count())))
    assert seen and sub.poll() == []
    assert e.execute(f"UNSUBSCRIBE {sub.id}") and not e.execute(f"UNSUBSCRIBE {sub.id}")


def test_batches_that_do_not_concern_a_query_are_skipped(spark):
    e = engine(spark)
    sub = e.execute("SUBSCRIBE MATCH (a:Person)-[r:location]->(b:Location) RETURN b.name")
    assert S.push(e, deltas(spark, (1, "added", "edge", 7, 1, 3, "social:knows", None, None))) == {}
    assert list(S.push(e, deltas(spark, (2, "added", "edge", 8, 1, 3, "location:visits", None, None)))) == [sub.id]
    assert S.triggers(parse("MATCH (a:Person)-[r:location]->(b) RETURN a.name")) == (None, {"location"})


def test_signed_aggregates(spark):
    state = spark.createDataFrame([("a", 2, 5.0), ("b", 1, 1.0)], "k string, n long, total double")
    changes = spark.createDataFrame([("a", 4.0, -1), ("a", 7.0, 1), ("b", 1.0, -1), ("c", 3.0, 1)], "k string, v double, sign int")
    assert sorted(map(tuple, S.signed_aggregate(state, changes, ["k"], "v").collect())) == [("a", 2, 8.0, 4.0), ("c", 1, 3.0, 3.0)]
    values = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 1), ("b", 1.0, 1)], "k string, v double, n long")
    _, ends = S.multiset_aggregate(values, changes, ["k"], "v")
    assert sorted(map(tuple, ends.collect())) == [("a", 1.0, 7.0), ("c", 3.0, 3.0)]


def test_following_a_stream(spark, tmp_path):
    e = engine(spark)
    sub = e.execute("SUBSCRIBE MATCH (a)-[r:location]->(b) RETURN a.name, b.name")
    source = tmp_path / "deltas"
    deltas(spark, (1, "added", "edge", 2, 1, 3, "location:lives_in", None, None)).write.parquet(str(source))
    stream = spark.readStream.schema(DELTAS).parquet(str(source))
    q = S.follow(e, stream, str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    assert sorted(map(tuple, sub.result.collect())) == [("Alice", "Berlin"), ("Alice", "London")]


def test_a_gap_in_the_generations_runs_the_query_again(spark):
    """A batch that was missed changed the graph; the next one's generation shows it."""
    e = engine(spark)
    sub = e.execute("SUBSCRIBE MATCH (a)-[r:location]->(b) RETURN b.name, count(*) AS n")
    S.push(e, deltas(spark, (1, "added", "edge", 2, 1, 3, "location:lives_in", None, None)))
    e.graph = S.apply_deltas(e.graph, deltas(spark, (2, "added", "edge", 3, 2, 3, "location:lives_in", None, None)))
    S.push(e, deltas(spark, (5, "added", "node", 9, None, None, "Person", None, None)))
    assert sorted(map(tuple, sub.result.collect())) == [("Berlin", 2), ("London", 1)] and sub.last == 5


def test_following_again_takes_up_the_graph(spark, tmp_path):
    source, checkpoint = tmp_path / "deltas", str(tmp_path / "checkpoint")
    text = "SUBSCRIBE MATCH (a)-[r:location]->(b) RETURN b.name, count(*) AS n"
    for number, target in ((1, 3), (2, 2)):
        e = engine(spark)  # a new process knows the first graph only
        sub = e.execute(text)
        deltas(spark, (number, "added", "edge", 10 + number, 2, target, "location:lives_in", None, None)).write.mode("append").parquet(str(source))
        S.follow(e, spark.readStream.schema(DELTAS).parquet(str(source)), checkpoint).awaitTermination(60)
    assert sorted(map(tuple, sub.result.collect())) == [("Berlin", 1), ("London", 2)]
