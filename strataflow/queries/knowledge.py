"""Filters, intents, parsers, ontologies, facts, claims, scopes and whole-graph measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import scoring
from strataflow.functions import text as T
from strataflow.model import nanos, node_id, table
from strataflow.operators import analytics, components, inference, memory, ontology, parsing, paths, search
from strataflow.plans import intents
from strataflow.queries.graphs import CHAIN, chain, commerce
from strataflow.queries.registry import NOW, SPAN, graph, query, rounded, tql

# ---- filters by specification


@query(f"select {SPAN} + c_custkey as id from customer union all select {4 * SPAN} + s_suppkey from supplier")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commerce(spark, sf_dir)[0].where(analytics.by_type("customer", "SUPPLIER")).select("id")


@query(f"select {2 * SPAN} + o_orderkey as id from orders where o_orderdate > timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'")
def nodes_created_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = 852076800 * 10**9, 883612800 * 10**9
    return commerce(spark, sf_dir)[0].where(analytics.created(low, high)).select("id")


@query(f"select {SPAN} + o_custkey as id from orders group by o_custkey having count(*) >= 12")
def nodes_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = commerce(spark, sf_dir)
    return analytics.with_degree(nodes, analytics.edges_of(edges, "commerce:placed"), 12, "out").select("id")


@query(f"select {2 * SPAN} + l_orderkey source, {3 * SPAN} + l_partkey target from lineitem where l_discount >= 0.1")
def edges_by_type_and_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.edges_of(commerce(spark, sf_dir)[1], "commerce:contains", min_weight=0.1).select("source", "target")


@query(f"select {3 * SPAN} + p_partkey as id from part where p_size between 5 and 40 and p_brand = 'Brand#1'")
def nodes_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = commerce(spark, sf_dir)[0]
    return analytics.by_property(analytics.by_property(nodes, "size", low=5, high=40), "brand", equal="Brand#1").select("id")


@query("select o_orderpriority priority, count(*) n from orders where list_contains(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9]+'), 'urgent') group by 1")
def property_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.by_property(commerce(spark, sf_dir)[0], "priority", contains=["Urgent"])
    return found.groupBy(F.col("props")["priority"].alias("priority")).agg(F.count("*").alias("n"))


# ---- intents


def _answer(spark: SparkSession, sf_dir: str, **intent) -> DataFrame:
    return intents.answer(graph(spark, sf_dir).graph, intent)


@query("select 'Customer' as type, count(*) n from customer union all select 'Order', count(*) from orders union all select 'Part', count(*) from part union all select 'Supplier', count(*) from supplier union all select 'Nation', count(*) from nation union all select 'Region', count(*) from region")
def intent_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="count_by_type")


@query("select count(*) as value from orders")
def intent_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="node_count", node_type="order")


@query("select (select count(*) from customer) + (select count(*) from supplier) as value")
def intent_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="edge_count", edge_type="location:in_nation")


_SIZES = (
    "n as (select (select count(*) from customer) + (select count(*) from orders) + (select count(*) from part) + (select count(*) from supplier) + (select count(*) from nation) + (select count(*) from region) k), "
    "e as (select (select count(*) from orders) + 2 * (select count(*) from lineitem) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from nation) k)"
)


@query(f"with {_SIZES} select round(2.0 * e.k / n.k, 9) as value from n, e")
def intent_average_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_answer(spark, sf_dir, kind="average_degree"), 9, "value")


@query("select round(sum(c_acctbal), 2) as value from customer")
def intent_sum_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_answer(spark, sf_dir, kind="sum_property", property="acctbal", node_type="Customer"), 2, "value")


@query("select min(s_acctbal) as value from supplier")
def intent_min_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="min_max_property", property="acctbal", find_min=True, node_type="Supplier")


@query("select c_mktsegment as value, count(*) n from customer group by 1")
def intent_group_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="group_by_count", property="segment")


@query(f"select {5 * SPAN} + n_nationkey node, 1 as depth from nation where n_regionkey = 2")
def intent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, kind="neighbours", start=6 * SPAN + 2, hops=1)


@query(f"select {SPAN} + o_custkey node, count(*) + 1 degree from orders group by 1 order by 2 desc, 1 limit 5")
def intent_ranking_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customers with most edges out; orders and parts are left out by narrowing the graph."""
    from strataflow.model import Graph

    nodes, edges = commerce(spark, sf_dir)
    mine = Graph(nodes.where("concept_type = 'Customer'"), edges.where("assoc_type in ('commerce:placed', 'location:in_nation') and source < 2000000000000"))
    top = intents.answer(mine, {"kind": "ranking", "metric": "degree", "limit": 5})
    out = mine.edges.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("degree"))
    return top.join(out, F.col("node") == F.col("_s")).select("node", "degree")


@query("with o as (select user_id, event_type, epoch_us(ts) t from events) select user_id::varchar entity, arg_max(event_type, [t::varchar, event_type]) state from (select user_id, event_type, lpad(t::varchar, 20, '0') t from o) group by 1")
def intent_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    states = e.select(F.col("user_id").cast("string").alias("entity"), F.lit("activity").alias("category"), F.col("event_type").alias("target"), nanos(F.col("ts")).alias("valid_from"))
    return intents.answer(graph(spark, sf_dir).graph, {"kind": "current_state"}, {"states": states}).select("entity", "state")


# ---- measures of whole graphs


@query(
    CHAIN + ", u as (select distinct s id from c union select t from c), k as (select id from u order by id limit 100), d as (select id from u order by id limit 50), r as (select id, 0 depth, id node from k), "
    "x as (select distinct s, t from c where s <> t), " + "r1 as (select k.id, x.t node, 1 depth from k join x on x.s = k.id), "
    + ", ".join(f"r{i} as (select id, node, min(depth) depth from (select * from r{i - 1} union all select r{i - 1}.id, x.t, {i} from r{i - 1} join x on x.s = node where depth = {i - 1}) group by 1, 2)" for i in range(2, 7))
    + ", p as (select * from r6 where node > id and node in (select id from k)) select (select count(*) from u) nodes, (select count(*) from c) edges, round((select avg(depth) from p), 9) average_path_length, "
    "(select max(depth) from p where id in (select id from d) and node in (select id from d)) diameter"
)
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the users' graph; the SQL unrolls six hops, beyond which no sampled pair lies."""
    e = chain(spark, sf_dir)
    nodes = paths.directed(e, "both").select(F.col("source").alias("id")).distinct()
    return rounded(analytics.graph_metrics(nodes, e), 9, "average_path_length").select("nodes", "edges", "average_path_length", "diameter")


@query("select count(*) components, max(n) largest from (select 1 + count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by c_custkey)")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = commerce(spark, sf_dir)
    found = components.connected_components(nodes.where("concept_type in ('Customer', 'Order')"), edges.where("assoc_type = 'commerce:placed'"))
    return found.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


# ---- parsers

_SAYINGS = (
    (1, "Alice paid Bob $12.50 for lunch. Bob lent Carol twenty-five dollars."), (2, "Ann: Paid €30 for dinner - split with Bob and Cy."), (3, "I recently moved to New York and I work at Acme."),
    (4, "Dana works with Erik. Erik is married to Fay. Gus and Hal are friends."), (5, "I really love jazz. Dana hates cold coffee, Erik likes hiking."), (6, "Nothing of the sort here."),
)


def _sayings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SAYINGS, "id int, text string")


@query("select * from (values (1, 'Alice', 'Bob', 12.5::double, 'lunch'), (1, 'Bob', 'Carol', 25.0, null)) t(id, payer, payee, amount, note)")
def parse_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_ledger(_sayings(spark)).select("id", "payer", "payee", "amount", "note")


@query("select * from (values (2, 'Ann', 'Bob', 10.0::double, 'dinner'), (2, 'Ann', 'Cy', 10.0, 'dinner')) t(id, payer, payee, amount, note)")
def parse_split_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_splits(_sayings(spark)).select("id", "payer", "payee", "amount", "note")


@query("select * from (values (3, 'user', 'location', 'lives_in', 'New York'), (3, 'user', 'work', 'works_at', 'Acme')) t(id, entity, category, predicate, target)")
def parse_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_states(_sayings(spark)).select("id", "entity", "category", "predicate", "target")


@query("select * from (values (4, 'Dana', 'works_with', 'Erik'), (4, 'Erik', 'spouse', 'Fay'), (4, 'Gus', 'friend', 'Hal')) t(id, subject, predicate, object)")
def parse_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_relationships(_sayings(spark)).select("id", "subject", "predicate", "object")


@query("select * from (values (5, 'user', 'jazz', 1.0::double, 'music'), (5, 'Dana', 'cold coffee', -1.0, 'food'), (5, 'Erik', 'hiking', 0.7, 'sport')) t(id, entity, item, sentiment, category)")
def parse_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_preferences(_sayings(spark)).select("id", "entity", "item", "sentiment", "category")


_NUMBERS = (("twenty-five", 25.0), ("1.5k", 1500.0), ("$1,200", 1200.0), ("two hundred and six", 206.0), ("one thousand", 1000.0), ("three million two", 3000002.0), ("fish", None), ("and", None))


@query("select * from (values " + ", ".join(f"('{t}', {'null' if v is None else v}::double)" for t, v in _NUMBERS) + ") t(said, v)")
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t, _ in _NUMBERS], "said string").select("said", T.number_of(F.col("said")).alias("v"))


@query(
    "with w as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) r from documents), b as (select doc_id, regexp_replace(regexp_replace(r, '^[^\\pL\\pN\\pM_]+|[^\\pL\\pN\\pM_]+$', '', 'g'), '(''s|’s)$', '') w from w), "
    "f as (select doc_id, unnest(case when contains(w, '-') then list_prepend(replace(w, '-', ''), string_split(w, '-')) else [w] end) w from b) select doc_id, count(*) n from f where length(w) > 1 and regexp_full_match(w, '[a-z0-9]+') group by 1"
)
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of plain ASCII in each document, before stemming."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(T.search_terms(F.col("text"), False)).alias("w")).where(F.col("w").rlike("^[a-z0-9]+$")).groupBy("doc_id").agg(F.count("*").alias("n"))


# ---- ontologies

_PROPERTIES = [("near", None, None, True, False), ("part_of", None, "has_part", False, True), ("in_region", "part_of", None, False, False), ("has_part", None, None, False, False)]


def _ontology(spark: SparkSession) -> DataFrame:
    rows = [(p, above, inverse, sym, trans, False, None, None, False, False, None) for p, above, inverse, sym, trans in _PROPERTIES]
    return spark.createDataFrame(rows, ontology.PROPERTIES)


@query("select * from (values ('in_region'), ('part_of')) t(property)")
def property_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.expand_property(_ontology(spark), "part_of")


@query(
    "with f as (select 'c' || c_custkey s, 'n' || c_nationkey o from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation), "
    "p as (select s, o from f union all select 'c' || c_custkey, 'r' || n_regionkey from customer join nation on c_nationkey = n_nationkey) "
    "select s subject, 'part_of' predicate, o as object from p union all select o, 'has_part', s from p union all select 'n' || n_nationkey, 'in_region', 'r' || n_regionkey from nation"
)
def ontology_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sub-property, transitive and inverse properties imply of customers, nations and regions."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    facts = c.select(name("c", "c_custkey").alias("subject"), F.lit("part_of").alias("predicate"), name("n", "c_nationkey").alias("object"))
    facts = facts.unionByName(n.select(name("n", "n_nationkey").alias("subject"), F.lit("in_region").alias("predicate"), name("r", "n_regionkey").alias("object")))
    return ontology.complete(facts, _ontology(spark))


_CLASSES = [("City", "Place"), ("Place", "Thing"), ("Person", "Thing"), ("Thing", None)]


@query("select * from (values ('City', 'City', 0), ('City', 'Place', 1), ('City', 'Thing', 2), ('Place', 'Place', 0), ('Place', 'Thing', 1), ('Person', 'Person', 0), ('Person', 'Thing', 1), ('Thing', 'Thing', 0)) t(child, ancestor, depth)")
def class_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.ancestors(spark.createDataFrame(_CLASSES, ontology.CLASSES), "class")


@query("select 'c' || c_custkey subject, case when c_nationkey % 2 = 0 then 'range' else 'domain' end problem from customer where c_nationkey % 2 = 0 or c_mktsegment = 'BUILDING'")
def ontology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons live in places: odd nations are cities, even ones persons, and builders cities where the nation is odd."""
    p = spark.createDataFrame([("lives_in", None, None, False, False, False, "Person", "Place", False, False, None)], ontology.PROPERTIES)
    even = F.col("c_nationkey") % 2 == 0
    facts = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("lives_in").alias("predicate"), F.col("c_nationkey").cast("string").alias("object"),
        F.when(~even & (F.col("c_mktsegment") == "BUILDING"), "City").otherwise("Person").alias("subject_class"), F.when(even, "Person").otherwise("City").alias("object_class"),
    )
    return ontology.violations(facts, p, spark.createDataFrame(_CLASSES, ontology.CLASSES)).select("subject", "problem")


# ---- facts, trees, upkeep


@query("select c_custkey::varchar entity, o_orderkey::varchar target, epoch_us(o_orderdate) * 1000 valid_from, lead(epoch_us(o_orderdate) * 1000) over (partition by c_custkey order by o_orderdate, o_orderkey::varchar) valid_until from customer join orders on o_custkey = c_custkey")
def fact_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a customer's latest deal, a single-valued fact that closes the one before; earlier years are there already."""
    o = table(spark, sf_dir, "orders")
    at = nanos(F.col("o_orderdate"))
    none = F.lit(None)
    facts = o.select(F.col("o_custkey").cast("string").alias("entity"), F.lit("deal:latest").alias("assoc_type"), F.col("o_orderkey").cast("string").alias("target"), at.alias("valid_from"), none.cast("long").alias("valid_until"), none.cast("string").alias("depends_on"))
    single = spark.createDataFrame([("deal:latest",)], "assoc_type string")
    return memory.write_facts(facts.where("valid_from < 800000000000000000"), facts.where("valid_from >= 800000000000000000"), single).select("entity", "target", "valid_from", "valid_until")


@query("select 'c' || c_custkey node, 2 as depth from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 union all select 'n' || n_nationkey, 1 from nation where n_regionkey = 1")
def tree_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    tree = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    tree = tree.unionByName(c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    return memory.descendants(tree, "r1")


@query(f"select {5 * SPAN} + c_nationkey node, 1 as depth from customer where c_custkey = 5")
def related_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.related(commerce(spark, sf_dir)[1], SPAN + 5, "in_nation")


@query(f"select event_id, round(value / 500 * exp(-0.01 * ({NOW} - epoch_us(ts) * 1000) / 3600e9), 9) strength from events where value / 500 * exp(-0.01 * ({NOW} - epoch_us(ts) * 1000) / 3600e9) >= 0.1 or event_type = 'purchase'")
def memory_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = e.select("event_id", (F.col("value") / 500).alias("strength"), nanos(F.col("ts")).alias("accessed_at"), F.when(F.col("event_type") == "purchase", "Schema").otherwise("Episodic").alias("tier"))
    return rounded(memory.forget(memory.decay_strength(m, NOW)).select("event_id", "strength"), 9, "strength")


@query(f"select {2 * SPAN} + o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 40")
def eviction_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.evict(commerce(spark, sf_dir)[0], 40).select("id")


@query("with m as (select c_custkey k, case when c_nationkey in (7, 8) then 7 else c_nationkey end n from customer) select n nation, count(*) customers from m group by 1")
def graph_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = commerce(spark, sf_dir)
    merged = memory.merge_nodes(nodes, edges, spark.createDataFrame([(5 * SPAN + 8, 5 * SPAN + 7)], "absorbed long, survivor long"))[1]
    inside = merged.where(f"assoc_type = 'location:in_nation' and source < {2 * SPAN}")
    return inside.groupBy((F.col("target") - 5 * SPAN).cast("int").alias("nation")).agg(F.count("*").alias("customers"))


# ---- claims, associations, scopes


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim per event: a user (subject) did (predicate) a type of thing; odd events deny it."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("it is a "), "event_type")).otherwise(F.concat(F.lit("it is not a "), "event_type"))
    return e.select(F.col("event_id").alias("claim_id"), F.col("user_id").cast("string").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"), F.col("event_id").alias("created_at"), said.alias("text"))


@query("select event_id claim_id, min(event_id) over (partition by user_id, event_type) duplicate_of from events qualify claim_id <> duplicate_of")
def claim_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.duplicate_claims(_claims(spark, sf_dir))


@query("select x.user_id::varchar subject, count(*) pairs from events x join events y on x.user_id = y.user_id and x.event_type = y.event_type and x.event_id % 2 = 0 and y.event_id % 2 = 1 group by 1")
def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of claims that contradict each other, by subject."""
    c = _claims(spark, sf_dir)
    return inference.contradicting_claims(c).join(c.select(F.col("claim_id").alias("a"), "subject"), "a").groupBy("subject").agg(F.count("*").alias("pairs"))


@query("with b as (select event_type fingerprint, epoch_us(ts) * 1000 // 86400000000000 bucket, count(*) n from events group by 1, 2) select fingerprint, bucket, n, round(n / sum(n) over (partition by bucket), 9) strength from b qualify n >= 2")
def contextual_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", nanos(F.col("ts")))
    return rounded(inference.contextual_associations(e, "event_type", "at", 24 * inference.HOUR), 9, "strength")


@query("select count(*) n from lineitem where l_shipdate is not null and not (l_linenumber = 1 and epoch_us(l_shipdate) * 1000 < 820454400000000000)")
def purged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as edges; first lines end when shipped, and those that ended long before 1996 go."""
    e = table(spark, sf_dir, "lineitem").select(F.lit(True).alias("is_valid"), nanos(F.col("l_shipdate")).alias("updated_at"), F.when(F.col("l_linenumber") == 1, nanos(F.col("l_shipdate"))).alias("valid_until"))
    return inference.purge_edges(e, 820454400 * 10**9, 0).agg(F.count("*").alias("n"))


@query("select event_id % 2 tenant, user_id % 3 usr, count(*) n from events where event_id % 2 = 0 and (user_id % 3 = 0 or user_id % 3 = 1) group by 1, 2")
def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What user 1 of tenant 0 may see: own rows, and those without a user."""
    e = table(spark, sf_dir, "events")
    who = F.when(F.col("user_id") % 3 > 0, F.create_map(F.lit("user_id"), (F.col("user_id") % 3).cast("string")))
    rows = e.select((F.col("event_id") % 2).alias("tenant"), (F.col("event_id") % 2).cast("string").alias("group_id"), (F.col("user_id") % 3).alias("usr"), who.alias("props"))
    return inference.scoped(rows, "0", user="1").groupBy("tenant", "usr").agg(F.count("*").alias("n"))


def _agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent_id"), nanos(F.col("ts")).alias("ts"), "event_type", F.when(F.col("event_type") == "purchase", "Success").alias("outcome"),
        F.array("event_type").alias("goals"), none.alias("env"), F.when(F.col("event_type") == "click", "mouse").alias("tool"), F.when(F.col("event_type") == "purchase", "sold").alias("result"), F.array().cast("array<long>").alias("chain"),
    )


@query("select 'Agent' kind, count(distinct user_id) n from events union all select 'Event', count(distinct event_id) from events union all select 'Context', count(distinct event_type) from events union all select 'Goal', count(distinct event_type) from events "
       "union all select 'Tool', 1 from (select 1 from events where event_type = 'click' limit 1) union all select 'Result', 1 from (select 1 from events where event_type = 'purchase' limit 1)")  # fmt: skip
def event_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inference.event_graph(_agent_events(spark, sf_dir), window=10**9)
    return g.nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))


@query("with e as (select *, epoch_us(ts) t from events) select 'event:performed' kind, count(*) n from e union all select 'event:in_context', count(*) from e union all select 'event:pursues', count(*) from e union all select 'event:uses', count(*) from e where event_type = 'click' "
       "union all select 'event:results_in', count(*) from e where event_type = 'purchase' union all select * from (select 'event:causes', count(*) c from e a join e b on b.t < a.t and a.t - b.t <= 1000000 and 0.4 * (a.user_id = b.user_id)::int + 0.3 * 0.7 * (a.event_type = b.event_type)::int + 0.3 * (b.event_type = 'purchase')::int >= 0.3) where c > 0")  # fmt: skip
def event_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the events' graph by type; contexts of one goal are never similar to another."""
    g = inference.event_graph(_agent_events(spark, sf_dir), window=10**9)
    return g.edges.groupBy(F.col("assoc_type").alias("kind")).agg(F.count("*").alias("n"))


@query("with recursive m as (select max(event_id) m from events), r as (select m as event, 0 as depth from m union all select event // 2, depth + 1 from r where event > 0) select event, depth from r where depth > 0")
def causal_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is caused by the one of half its number; all that lies behind the last one."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0]
    return inference.ancestors_of(e.where("event_id > 0").select("event_id", F.floor(F.col("event_id") / 2).alias("parent")), last)


@query("select event_id from events where event_id between 10 and 15 or event_id between 16 and 30")
def causal_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events 10 to 15 cause each other in a ring, 16 to 30 follow from it; the rest is a chain without cycles."""
    e = table(spark, sf_dir, "events").where("event_id between 1 and 60").select("event_id")
    parent = F.when(F.col("event_id") == 10, 15).when(F.col("event_id") == 31, None).otherwise(F.col("event_id") - 1)
    causes = e.withColumn("parent", F.when(F.col("event_id") != 1, parent).cast("long"))
    return inference.cycles(causes)


# ---- results


def _status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as states that close one another: source, target, label, assoc_type, valid_from, valid_until, props."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("at", nanos(F.col("o_orderdate")))
    after = F.lead("at").over(Window.partitionBy("o_custkey").orderBy("at", "o_orderkey"))
    return o.select(
        node_id("customer", F.col("o_custkey")).alias("source"), node_id("order", F.col("o_orderkey")).alias("target"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"),
        F.lit("deal:latest").alias("assoc_type"), F.col("at").alias("valid_from"), after.alias("valid_until"), F.lit(None).cast("map<string,string>").alias("props"),
    )


_LATEST = "with l as (select o_orderkey, o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r, max(o_orderdate) over (partition by o_custkey) m, o_orderdate from orders) "


@query(_LATEST + f"select {2 * SPAN} + o_orderkey node, o_totalprice score from l where r = 1")
def results_still_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(node_id("order", F.col("o_orderkey")).alias("node"), F.col("o_totalprice").alias("score"))
    return search.valid_results(scores, _status_edges(spark, sf_dir))


@query(_LATEST + f"select {2 * SPAN} + o_orderkey node, round(o_totalprice * case when o_custkey <> 7 then 1.0 when r = 1 then 1.5 else 0.5 end, 4) score from l")
def results_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(node_id("order", F.col("o_orderkey")).alias("node"), F.col("o_totalprice").alias("score"))
    return rounded(search.anchored_results(scores, _status_edges(spark, sf_dir), SPAN + 7), 4, "score")


@query(f"select {2 * SPAN} + o_orderkey node from orders where o_orderdate >= (select max(o_orderdate) from orders where o_custkey = 7)")
def results_of_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(node_id("order", F.col("o_orderkey")).alias("node"), nanos(F.col("o_orderdate")).alias("at"))
    return search.epoch_results(scores, _status_edges(spark, sf_dir), SPAN + 7, "deal").select("node")


@query("select p_name as name from part where contains(lower(p_name), 'ring') and p_size < 30 and lower(p_brand) = 'brand#2'")
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as code entities: name, kind (brand), language, and a file named after the size."""
    p = table(spark, sf_dir, "part")
    entities = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.lit("Rust").alias("language"), F.concat(F.when(F.col("p_size") < 30, "src/").otherwise("tests/"), F.col("p_size").cast("string")).alias("file"))
    return search.code_search(entities, "RING", "Brand#2", "rust", "src/%").select("name")


@query("select event_id, round(least(greatest(0.2 / (1 + event_id % 5) + 0.3 * (event_type = 'purchase')::int + 0.2 * least((event_id % 20) / 10.0, 1) + 0.2 * least((event_id % 13) / 10.0, 1) - 0.1 * ((event_id % 7) / 7.0), 0), 1), 9) score from events")
def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    score = scoring.strategy_eligibility(k % 5, F.when(F.col("event_type") == "purchase", "Success").otherwise("None"), k % 20, k % 13, (k % 7) / 7.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 9).alias("score"))


@query("with x as (select doc_id, n_chars from documents), a as (select doc_id, row_number() over (order by n_chars desc, doc_id) r from x), b as (select doc_id, row_number() over (order by doc_id desc) r from x) "
       "select doc_id, round(sum(1.0 / (60 + r)), 9) score from (select * from a where r <= 50 union all select * from b where r <= 50) group by 1 order by sum(1.0 / (60 + r)) desc, doc_id limit 10")  # fmt: skip
def fused_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = search.ranked(d.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", 50)
    b = search.ranked(d.select("doc_id", F.col("doc_id").cast("double").alias("score")), "doc_id", 50)
    return rounded(search.top(search.rrf([a, b], "doc_id"), 10, "doc_id"), 9, "score")


# ---- the language: functions, system columns, bare names

tql("fn_identity", graph, "MATCH (n:Nation)-[r:location]->(x:Region) RETURN id(n) AS i, type(r) AS t, x AS bare, created_at(n) AS c, labels(n) AS l",
    f"select {5 * SPAN} + n_nationkey i, 'location:in_region' t, r_name bare, 0::bigint c, 'Concept' l from nation join region on n_regionkey = r_regionkey")
tql("fn_properties", graph, "MATCH (p:Part) RETURN p.id AS id, properties(p) AS props", f"select {3 * SPAN} + p_partkey id, p_brand || '|' || p_size props from part",
    lambda df: df.select("id", F.concat_ws("|", F.col("props")["brand"], F.col("props")["size"]).alias("props")))
tql("fn_validity", graph, "MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN ALL RETURN o.id AS id, valid_from(r) AS since, valid_until(r) AS until",
    f"select {2 * SPAN} + o_orderkey id, epoch_us(o_orderdate) * 1000 since, lead(epoch_us(o_orderdate) * 1000) over (partition by o_custkey order by o_orderdate, o_orderkey) until from orders")


@query("with e as (select *, epoch_us(ts) * 1000 since from events) select user_id row_id, event_id version_id, since valid_from, lead(since) over (partition by user_id order by since, event_id) valid_until from e")
def system_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.queries.registry import versioned

    return versioned(spark, sf_dir).query("FROM user_state WHEN ALL RETURN row_id, version_id, valid_from, valid_until")
