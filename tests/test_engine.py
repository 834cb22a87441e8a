"""The engine on the moves fixture and small tables."""

import pytest

from strataflow.model import Graph
from strataflow.plans.lexer import QueryError
from strataflow.session import Engine
from strataflow.sources.tables import ConstraintError, TableStore

NODES = [(1, "Concept", "Person", "Alice", 0), (2, "Concept", "Location", "London", 0), (3, "Concept", "Location", "Berlin", 0), (4, "Concept", "Location", "Tokyo", 0), (5, "Concept", "Person", "Bob", 0)]
EDGES = [
    (1, 1, 2, "location:lives_in", 100, 200, 10, [(1, 0.2), (5, 0.6), (9, 0.9)]), (2, 1, 3, "location:lives_in", 200, 300, 20, None), (3, 1, 4, "location:lives_in", 300, None, 30, None),
    (4, 5, 2, "location:lives_in", 50, None, 5, None), (5, 1, 5, "social:knows", None, None, 1, None),
]


@pytest.fixture(scope="module")
def moves(spark):
    nodes = spark.createDataFrame(NODES, "id long, node_type string, concept_type string, label string, created_at long")
    edges = spark.createDataFrame(EDGES, "id long, source long, target long, assoc_type string, valid_from long, valid_until long, created_at long, confidence_history array<struct<t:bigint,v:double>>")
    from pyspark.sql import functions as F

    return Graph.of(nodes, edges.withColumn("edge_kind", F.lit("Association")))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ask(spark, graph, text, **options):
    return rows(Engine(spark, graph, now=1000, **options).query(text))


@pytest.mark.parametrize(
    "when, places",
    [("", ["Tokyo"]), ("WHEN 150", ["London"]), ("WHEN 200", ["Berlin"]), ("WHEN 150 TO 250", ["Berlin", "London"]), ("WHEN 200 TO 300", ["Berlin"]), ("WHEN ALL", ["Berlin", "London", "Tokyo"]),
     ("WHEN ALL AS OF 20", ["Berlin", "London"]), ("WHEN 350 AS OF 20", []), ("WHEN 99", [])],
)
def test_viewports(spark, moves, when, places):
    assert ask(spark, moves, f'MATCH (p {{name: "Alice"}})-[r:location]->(l) {when} RETURN l.name') == [(p,) for p in places]


def test_shared_variables_join(spark, moves):
    q = "MATCH (a:Person)-[r:location]->(l), (b:Person)-[s:location]->(l) WHEN ALL WHERE a.id != b.id AND overlap(r, s) RETURN a.name, b.name, l.name"
    assert ask(spark, moves, q) == [("Alice", "Bob", "London"), ("Bob", "Alice", "London")]
    assert ask(spark, moves, "MATCH (a)-[:knows]->(b), (b)-[:location]->(l) RETURN a.name, b.name, l.name") in ([("Alice", "Bob", "London")], [])
    assert ask(spark, moves, "MATCH (a)-[:social]->(b), (b)-[:location]->(l) RETURN a.name, b.name, l.name") == [("Alice", "Bob", "London")]


def test_target_labels_and_props_constrain(spark, moves):
    assert ask(spark, moves, "MATCH (a)-[r]->(b:Person) RETURN b.name") == [("Bob",)]
    assert ask(spark, moves, 'MATCH (a)-[r]->(b {name: "Tokyo"}) RETURN a.name') == [("Alice",)]


def test_cycle_pattern_compares_nodes(spark, moves):
    assert ask(spark, moves, "MATCH (a)-[]->(b)-[]->(a) WHEN ALL RETURN a.name") == []


def test_variable_length_reaches_each_node_once(spark, moves):
    assert ask(spark, moves, 'MATCH (a {name: "Alice"})-[*1..2]->(b) RETURN b.name') == [("Bob",), ("London",), ("Tokyo",)]
    assert ask(spark, moves, 'MATCH (a {name: "Alice"})-[*2..5]->(b) RETURN b.name') == [("London",)]


def test_functions(spark, moves):
    q = "MATCH (a)-[r]->(b) WHEN ALL WHERE CHANGED(r, 190, 210) RETURN b.name, change_type(r, 190, 210), duration(r), open_ended(r), type(r)"
    assert ask(spark, moves, q) == [("Berlin", "started", 100, False, "location:lives_in"), ("London", "ended", 100, False, "location:lives_in")]
    assert ask(spark, moves, "MATCH (a)-[r]->(b) WHEN ALL WHERE r.id = 1 RETURN confidence_at(r, 6), confidence_at(r, 0)") == [(0.6, None)]
    assert ask(spark, moves, 'MATCH (a {name: "Alice"}), (b {name: "London"}) RETURN path(a, b) AS p, hops(path(a, b)) AS h') == [(["Alice", "London"], 1)]
    assert ask(spark, moves, 'MATCH (a:Person) RETURN a.name, a.degree, toUpper(a.name) AS u, coalesce(a.nothing, "x") AS c') == [("Alice", 2, "ALICE", "x"), ("Bob", 2, "BOB", "x")]


def test_aggregates_having_order_limit(spark, moves):
    q = "MATCH (a)-[r]->(b) WHEN ALL HAVING n > 1 RETURN a.name AS name, count(*) AS n, collect(b.name) AS places ORDER BY n DESC LIMIT 1"
    assert ask(spark, moves, q) == [("Alice", 4, ["Berlin", "Bob", "London", "Tokyo"])]


def test_errors_name_the_problem(spark, moves):
    for text in ("MATCH (a) RETURN b.name", "MATCH (a) RETURN nosuch(a)", "MATCH (a)-[r*1..2]->(b) RETURN r.id", "FROM nowhere RETURN x", "MATCH (a) HAVING a.id > 1 RETURN a.name"):
        with pytest.raises(QueryError):
            ask(spark, moves, text)


def test_null_semantics_by_mode(spark):
    t = spark.createDataFrame([(1, None, "A"), (2, 5, "b"), (3, 7, None)], "id long, x long, s string")
    run = lambda where, compat=False: [r[0] for r in rows(Engine(spark, tables={"t": t}, compat=compat).query(f"FROM t WHERE {where} RETURN id"))]
    assert run("x < 6") == [2] and run("x < 6", True) == [1, 2]
    assert run("x != 5") == [3] and run("x != 5", True) == [1, 3]
    assert run("NOT x = 5") == [3] and run("NOT x = 5", True) == [1, 3]
    assert run("x NOT IN (5)") == [3] and run("x NOT IN (5)", True) == [1, 3]
    assert run('s = "a"') == [] and run('s = "a"', True) == []
    assert run('s LIKE "_"') == [1, 2] and run("x BETWEEN 5 AND 6") == [2] and run("s IS NULL") == [3]


def test_compat_graph_compares_without_case(spark, moves):
    assert ask(spark, moves, 'MATCH (a:Person) WHERE a.name = "alice" RETURN a.name', compat=True) == [("Alice",)]
    assert ask(spark, moves, 'MATCH (a:Person) WHERE a.name = "alice" RETURN a.name') == []
    assert ask(spark, moves, 'MATCH (a:Person) WHERE a.name CONTAINS "LIC" RETURN a.name', compat=True) == [("Alice",)]


def test_tables_join_ambiguity_and_sides(spark):
    c = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    o = spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.0), (12, None, 1.0)], "id long, customer_id long, amount double")
    e = Engine(spark, tables={"customers": c, "orders": o})
    assert rows(e.query("FROM orders JOIN customers ON customers.id = orders.customer_id RETURN orders.id, customers.id")) == [(10, 1), (11, 1)]
    assert rows(e.query("FROM customers c LEFT JOIN orders o ON c.id = o.customer_id RETURN c.name, count(o.id) AS n, sum(amount) AS total")) == [("A", 2, 12.0), ("B", 0, None)]
    with pytest.raises(QueryError):
        e.query("FROM orders JOIN customers ON customers.id = orders.customer_id RETURN id")


@pytest.fixture
def shop(spark, tmp_path):
    e = Engine(spark, store=TableStore(spark, str(tmp_path / "store")), now=100)
    e.execute('CREATE TABLE customers (id Int64 PRIMARY KEY, name String NOT NULL, region String DEFAULT "eu")')
    e.execute('INSERT INTO customers (id, name) VALUES (1, "A"), (2, "B")')
    return e


def test_versions_of_changed_rows(shop):
    shop.now = 200
    assert shop.execute('UPDATE customers SET region = "us" WHERE name = "A"') == 1
    assert shop.execute("DELETE FROM customers WHERE id = 2") == 1
    assert rows(shop.query("FROM customers RETURN id, region, valid_from")) == [(1, "us", 200)]
    assert rows(shop.query("FROM customers WHEN 150 RETURN id, region")) == [(1, "eu"), (2, "eu")]
    assert rows(shop.query("FROM customers WHEN ALL RETURN count(*) AS n")) == [(3,)]
    shop.store.compact("customers", 10**18)
    assert rows(shop.query("FROM customers WHEN ALL RETURN id, region")) == [(1, "us"), (2, "eu")]


@pytest.mark.parametrize("text", ['INSERT INTO customers (id, name) VALUES (1, "x")', "INSERT INTO customers (id) VALUES (9)", 'INSERT INTO customers (id, name) VALUES ("a", "b")',
                                  'UPDATE customers SET id = 1 WHERE name = "B"', "CREATE UNIQUE INDEX r ON customers (region)", "ALTER TABLE customers ADD COLUMN z Int64 NOT NULL"])
def test_constraints(shop, text):
    with pytest.raises(ConstraintError):
        shop.execute(text)
    assert rows(shop.query("FROM customers RETURN id")) == [(1,), (2,)]


def test_added_columns_read_their_default(shop):
    shop.execute("ALTER TABLE customers ADD COLUMN tier Int64 DEFAULT 4")
    shop.execute('INSERT INTO customers (id, name, tier) VALUES (3, "C", NULL)')
    assert rows(shop.query("FROM customers RETURN id, tier ORDER BY id")) == [(1, 4), (2, 4), (3, None)]
    assert shop.store.stats("customers").first()["active"] == 3
    shop.execute("DROP TABLE customers")
    assert shop.store.names() == []


def test_bulk_load_and_node_merge(spark, tmp_path):
    e = Engine(spark, store=TableStore(spark, str(tmp_path / "store")), now=5)
    e.execute("CREATE TABLE t (k Int64 AUTOINCREMENT, who NodeRef REFERENCES GRAPH)")
    assert e.store.load("t", spark.range(10).selectExpr("id % 3 as who").repartition(3), 5) == 10
    assert sorted(r[0] for r in rows(e.query("FROM t RETURN k"))) == list(range(1, 11))
    e.store.merge_nodes("t", spark.createDataFrame([(2, 0)], "absorbed long, survivor long"))
    assert rows(e.query("FROM t RETURN who, count(*) AS n")) == [(0, 7), (1, 3)]
    assert e.store.by_node("t", "who", 1).count() == 3 and e.store.scan("t", limit=4).count() == 4
