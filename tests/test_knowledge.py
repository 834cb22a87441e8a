"""Search, memory, ontology, inference, importers and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import scoring
from strataflow.functions import text as X
from strataflow.operators import inference, memory, ontology, parsing, search
from strataflow.sources import importers
from strataflow.streaming import events as streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_stems_and_numbers():
    assert X.words("The dog's well-known running, of A!") == ["the", "dog", "wellknown", "well", "known", "run", "of"]
    assert "http" in X.code_words("HttpServer::parse_url(x) // a") and "parse_url" in X.code_words("parse_url") and "httpserver::parse_url" in X.code_words("HttpServer::parse_url")
    assert [X.parse_number(t) for t in ("twenty-five", "1.5k", "$1,200", "two hundred and six", "one thousand", "fish", None)] == [25.0, 1500.0, 1200.0, 206.0, 1000.0, None, None]


def test_rrf_order(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    b = spark.createDataFrame([(3, 1), (1, 2), (4, 3)], "id long, rank int")
    got = [r.id for r in search.top(search.rrf([a, b], "id"), 10, "id").collect()]
    assert got == [1, 3, 2, 4]


def test_bm25_prefers_rare_terms_and_short_texts(spark):
    d = spark.createDataFrame([(1, "red fish"), (2, "red red red boat on the wide sea"), (3, "blue boat"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in search.bm25(d, ["fish", "red"]).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]
    assert rows(search.match_all(d, ["red", "boat"])) == [(2,)]
    assert {r.doc_id for r in search.bm25_mixed(d, "boats red").collect()} == {1, 2, 3}


def test_vector_metrics_and_filters(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 0.0], None)], "vec_id long, embedding array<float>, tag string")
    assert [r.vec_id for r in search.vector_search(v, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r.vec_id for r in search.vector_search(v, [1.0, 0.0], 3, unequal={"tag": "a"}).collect()] == [2, 3]
    assert search.vector_search(v, [1.0, 0.0], 3, metric="euclid").first().score == 0.0
    assert search.vector_search(v, [1.0, 0.0], 3, least=0.7).count() == 1


def test_weighted_fusion_of_equal_scores(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 1.0)], "id long, score double")
    assert rows(search.weighted_fusion(a, b, "id", 0.5)) == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_memory_retrieval_boosts_tiers(spark):
    m = spark.createDataFrame(
        [(1, "likes tea", [1.0, 0.0], ["g"], 0.5, 0, 1, "Episodic"), (2, "likes tea", [1.0, 0.0], ["g"], 0.5, 0, 1, "Schema")],
        "memory_id long, text string, embedding array<float>, goals array<string>, importance double, accessed_at long, access_count int, tier string",
    )
    assert [r.memory_id for r in search.retrieve_memories(m, ["tea"], [1.0, 0.0], 10**12, ["g"]).collect()] == [2, 1]


def test_ledgers_and_debts(spark):
    p = spark.createDataFrame([("A", "B", 10.0), ("B", "C", 4.0), ("A", "C", 1.5)], "payer string, payee string, amount double").withColumn("currency", F.lit("EUR"))
    net = memory.net_balances(p)
    assert rows(net) == [("A", "EUR", -11.5), ("B", "EUR", 6.0), ("C", "EUR", 5.5)]
    assert rows(memory.simplify_debts(net)) == [("EUR", "A", "B", 6.0), ("EUR", "A", "C", 5.5)]
    assert rows(memory.pair_balances(p)) == [("A", "B", "EUR", 10.0), ("A", "C", "EUR", 1.5), ("B", "C", "EUR", 4.0)]
    t = spark.createDataFrame([(1, "Alice paid Bob $12.50 for lunch. Bob lent Carol twenty dollars.")], "id long, text string")
    assert rows(parsing.parse_ledger(t).select("payer", "payee", "amount")) == [("Alice", "Bob", 12.5), ("Bob", "Carol", 20.0)]


def test_facts_supersede_and_cascade(spark):
    ddl = "entity long, assoc_type string, target string, valid_from long, valid_until long, depends_on string"
    old = spark.createDataFrame([(1, "location:lives_in", "London", 1, None, None), (1, "work:commutes", "Tube", 2, None, "London")], ddl)
    new = spark.createDataFrame([(1, "location:lives_in", "Berlin", 9, None, None), (1, "location:lives_in", "London", 5, None, None)], ddl)
    single = spark.createDataFrame([("location:lives_in",)], "assoc_type string")
    got = {(r.target, r.valid_from): r.valid_until for r in memory.write_facts(old, new, single).collect()}
    assert got == {("London", 1): 9, ("Berlin", 9): None, ("Tube", 2): 9}


def test_consolidation_in_threes(spark):
    m = spark.createDataFrame([(1, i, i, 0.0 if i < 3 else 1.0, "Episodic") for i in range(8)], "bucket long, memory_id long, formed_at long, signal double, tier string")
    assert [(r.chunk, r.members) for r in memory.consolidate(m).collect()] == [(1, [3, 4, 5])]
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [1.0, 0.1]), (1, 4, [0.0, 1.0])], "bucket long, memory_id long, embedding array<double>")
    assert [r.members for r in memory.group_by_embedding(v).collect()] == [[1, 2, 3]]


def test_tree_and_scores(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    assert rows(memory.descendants(t, "a")) == [("b", 1), ("c", 2), ("d", 1)]
    df = spark.createDataFrame([(0, "Success", 20, 5, 0.5)], "seen int, outcome string, events int, bucket int, red double")
    s = df.select(scoring.strategy_eligibility(F.col("seen"), F.col("outcome"), F.col("events"), F.col("bucket"), F.col("red"))).first()[0]
    assert abs(s - (0.2 + 0.3 + 0.2 + 0.1 - 0.05)) < 1e-12


TURTLE = """@prefix ex: <http://example.org/#> .
# a comment
ex:knows a owl:ObjectProperty, owl:SymmetricProperty ; rdfs:domain ex:Person ; rdfs:range ex:Person .
ex:friendOf a owl:ObjectProperty ; rdfs:subPropertyOf ex:knows .
ex:bornIn a owl:ObjectProperty, owl:FunctionalProperty ; owl:maxCardinality 1 ; rdfs:range ex:Place ; ex:appendOnly true .
ex:Person a owl:Class . ex:City a owl:Class ; rdfs:subClassOf ex:Place . ex:Place a owl:Class .
"""


def test_ontology(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(TURTLE)
    properties, classes = importers.read_ontology(spark, str(tmp_path / "o.ttl"))
    assert rows(ontology.expand_property(properties, "knows")) == [("friendOf",), ("knows",)]
    assert ontology.is_a(classes, "City", "Place").first().holds and not ontology.is_a(classes, "Place", "City").first().holds
    facts = spark.createDataFrame(
        [("a", "bornIn", "x", "Person", "City"), ("a", "bornIn", "y", "Person", "City"), ("b", "knows", "x", "Person", "City"), ("c", "knows", "a", "Person", "Person")],
        "subject string, predicate string, object string, subject_class string, object_class string",
    )
    assert sorted((r.subject, r.problem) for r in ontology.violations(facts, properties, classes).collect()) == [("a", "cardinality"), ("a", "cardinality"), ("b", "range")]
    done = ontology.complete(spark.createDataFrame([("a", "friendOf", "b")], "subject string, predicate string, object string"), properties)
    assert rows(done) == [("a", "friendOf", "b"), ("a", "knows", "b"), ("b", "knows", "a")]


def test_episodes_and_causes(spark):
    e = spark.createDataFrame(
        [(1, "x", 0, "Action", None), (2, "x", 10, "Action", "Success"), (3, "x", 20, "Action", None), (4, "x", 20 + 2 * inference.HOUR, "Action", None), (5, "x", 21 + 2 * inference.HOUR, "Planning", None)],
        "event_id long, agent_id string, ts long, event_type string, outcome string",
    ).withColumn("goals", F.array().cast("array<string>")).withColumn("env", F.array().cast("array<string>")).withColumn("chain", F.array().cast("array<long>"))
    assert [(r.episode, r.events, r.outcome) for r in inference.episodes(e).orderBy("episode").collect()] == [(1, 2, "Success"), (2, 1, None), (3, 1, None), (4, 1, None)]
    pairs = inference.causal_edges(e, 15, 0.6)
    assert rows(pairs.select("cause", "effect", F.round("strength", 3))) == [(2, 3, 0.7)]
    causes = spark.createDataFrame([(2, 1), (3, 2), (4, 5), (5, 4)], "event_id long, parent long")
    assert rows(inference.ancestors_of(causes, 3)) == [(1, 2), (2, 1)]
    assert rows(inference.cycles(causes)) == [(4,), (5,)]


def test_claims(spark):
    c = spark.createDataFrame([(1, "s", "p", "o", 1, "It is raining"), (2, "s", "p", "o", 2, "It is not raining"), (3, "s", "p", "q", 3, "It is dry")], "claim_id long, subject string, predicate string, object string, created_at long, text string")
    assert rows(inference.duplicate_claims(c)) == [(2, 1)] and rows(inference.contradicting_claims(c)) == [(1, 2)]


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Id,Name,Ok\n1,"x, y",true\nbad,z,false\n3,null,\n')
    columns = {"id": "Int64", "name": "String", "ok": "Bool"}
    mapping = {"id": "Id", "name": "Name", "ok": "Ok"}
    assert rows(importers.read_csv(spark, str(tmp_path / "a.csv"), columns, mapping).select("id", "name", "ok")) == [(1, "x, y", True), (3, None, None)]
    with pytest.raises(Exception, match="does not parse"):
        importers.read_csv(spark, str(tmp_path / "a.csv"), columns, mapping, skip_errors=False).collect()
    (tmp_path / "a.ndjson").write_text('{"id": 1, "v": 2.5}\n\n{"id": "x", "v": 1}\n')
    assert rows(importers.read_ndjson(spark, str(tmp_path / "a.ndjson"), {"id": "int", "v": "float"})) == [(1, 2.5)]
    (tmp_path / "a.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert rows(importers.read_json_array(spark, str(tmp_path / "a.json"), {"id": "int"})) == [(1,), (2,)]


def test_graph_import_and_export(spark, tmp_path):
    n = spark.createDataFrame([("Alice", "Person", {"age": "3"}), ("alice ", None, None)], "name string, type string, props map<string,string>")
    e = spark.createDataFrame([("Alice", "London", "Association", "location:lives_in", 1.0, 1.0, 5, None, None)], "source string, target string, kind string, assoc_type string, weight double, confidence double, valid_from long, valid_until long, props map<string,string>")
    g = importers.import_graph(n, e, 7)
    assert rows(g.nodes.select("label", "concept_type")) == [("Alice", "Person"), ("London", "Concept")]
    importers.export_graph(g, str(tmp_path / "g"))
    back = importers.load_graph(spark, str(tmp_path / "g"))
    assert rows(back.edges.select("source", "target", "assoc_type")) == rows(g.edges.select("source", "target", "assoc_type"))


def test_vector_store(spark, tmp_path):
    s = importers.VectorStore(spark, str(tmp_path / "v"))
    ddl = "vec_id long, embedding array<float>"
    s.upsert(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], ddl))
    s.upsert(spark.createDataFrame([(2, [1.0, 0.1]), (3, [0.5, 0.5])], ddl))
    assert s.count() == 3 and [r.vec_id for r in s.search([1.0, 0.0], 2).collect()] == [1, 2]
    s.delete(spark.createDataFrame([(1,)], "vec_id long"))
    assert s.fetch([1, 2]).count() == 1


def test_sequence_status(spark):
    e = spark.createDataFrame([("ledger:a", 1, 1), ("ledger:a", 2, 2), ("ledger:a", 2, 3), ("ledger:a", 5, 4), ("chat:b", 9, 1)], "domain string, seq long, arrival long")
    assert [(r.domain, r.status, r.strict) for r in streams.sequence_status(e).orderBy("domain", "arrival").collect()] == [
        ("chat:b", "Ready", False), ("ledger:a", "Ready", True), ("ledger:a", "Ready", True), ("ledger:a", "Duplicate", True), ("ledger:a", "Gap", True)
    ]
