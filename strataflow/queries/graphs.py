"""Pattern matching, paths and graph algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.model import nanos, table
from strataflow.operators import centrality, community, components, inference, paths
from strataflow.queries.registry import SPAN, graph, query, rounded, tql

tql("match_one_hop", graph, "MATCH (c:Customer)-[r:location]->(n:Nation) RETURN n.name AS nation, count(*) AS n", "select n_name nation, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1")
tql("match_incoming", graph, "MATCH (n:Nation)<-[:location]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "select n_name nation, s_name supplier from supplier join nation on s_nationkey = n_nationkey")
tql("match_multi_hop", graph, "MATCH (c:Customer)-[:location]->(n:Nation)-[:location]->(r:Region) RETURN r.name AS region, count(*) AS customers",
    "select r_name region, count(*) customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
tql("match_shared_var", graph, "MATCH (c:Customer)-[:location]->(n:Nation), (s:Supplier)-[:location]->(n), (n)-[:location]->(r:Region) WHERE s.acctbal > 0 RETURN r.name AS region, count(*) AS pairs",
    "select r_name region, count(*) pairs from customer join supplier on c_nationkey = s_nationkey join nation on n_nationkey = c_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 0 group by 1")
tql("match_varlen", graph, "MATCH (c:Customer)-[:location*1..2]->(r:Region) RETURN r.name AS region, count(*) AS n",
    "select r_name region, count(*) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
tql("match_varlen_min", graph, "MATCH (c:Customer)-[:location*2..3]->(x) RETURN c.name AS customer, x.name AS place",
    "select c_name customer, r_name place from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
tql("match_props", graph, 'MATCH (c:Customer {segment: "BUILDING"})-[:`commerce:placed`]->(o:Order {status: "F"}) WHEN ALL RETURN c.name AS customer, count(*) AS n',
    "select c_name customer, count(*) n from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderstatus = 'F' group by 1")
tql("match_name_prop", graph, 'MATCH (n:Nation {name: "NATION_7"})<-[:location]-(x) RETURN x.name AS who, x.type AS kind',
    "select c_name who, 'Concept' kind from customer where c_nationkey = 7 union all select s_name, 'Concept' from supplier where s_nationkey = 7")
tql("match_agg", graph, "MATCH (o:Order)-[r:`commerce:contains`]->(p:Part) RETURN p.brand AS brand, count(*) AS n, avg(r.weight) AS weight, max(r.weight) AS high",
    "select p_brand brand, count(*) n, round(avg(l_discount), 4) weight, max(l_discount) high from lineitem join part on l_partkey = p_partkey group by 1", lambda df: rounded(df, 4, "weight"))
tql("match_edge_weight", graph, "MATCH (o:Order)-[r:`commerce:contains`]->(p:Part) WHERE r.weight >= 0.09 AND p.size = 7 RETURN o.name AS ord, p.name AS part",
    "select l_orderkey::varchar ord, p_name part from lineitem join part on l_partkey = p_partkey where l_discount >= 0.09 and p_size = 7")
tql("match_two_labels", graph, "MATCH (x:Customer:Supplier)-[:location]->(n) RETURN n.name AS nation, count(*) AS n",
    "select n_name nation, count(*) n from (select c_nationkey k from customer union all select s_nationkey from supplier) join nation on k = n_nationkey group by 1")
tql("match_degree", graph, "MATCH (n:Nation) WHERE n.degree > 0 RETURN n.name AS nation, n.degree AS degree",
    "select n_name nation, 1 + (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) degree from nation")
tql("match_distinct", graph, "MATCH (c:Customer)-[:`commerce:placed`]->(o:Order) WHEN ALL RETURN DISTINCT c.segment AS segment, o.priority AS priority",
    "select distinct c_mktsegment segment, o_orderpriority priority from customer join orders on c_custkey = o_custkey")
tql("match_disjoint", graph, "MATCH (a:Region), (b:Region) WHERE a.id < b.id RETURN a.name AS a, b.name AS b", "select x.r_name a, y.r_name b from region x, region y where x.r_regionkey < y.r_regionkey")
tql("mixed_match_join", graph, "MATCH (c:Customer)-[:location]->(n:Nation) JOIN accounts ON accounts.node = c WHERE accounts.balance > 0.0 RETURN n.name AS nation, count(*) AS n, sum(accounts.balance) AS total",
    "select n_name nation, count(*) n, round(sum(c_acctbal), 2) total from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by 1", lambda df: rounded(df, 2, "total"))
tql("mixed_left_join", graph, 'MATCH (s:Supplier)-[:location]->(n:Nation {name: "NATION_3"}) LEFT JOIN accounts ON accounts.node = s.id RETURN s.name AS supplier, accounts.balance AS balance',
    "select s_name supplier, null::double balance from supplier where s_nationkey = 3")
tql("shortest_path_hops", graph, 'MATCH (s:Supplier), (r:Region {name: "AFRICA"}) RETURN s.name AS supplier, hops(path(s, r)) AS hops',
    "select s_name supplier, case when n_regionkey = r_regionkey then 2 end::int hops from supplier join nation on s_nationkey = n_nationkey, region where r_name = 'AFRICA'", lambda df: df.withColumn("hops", F.when(F.col("hops") > 0, F.col("hops"))))


def commerce(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges."""
    g = graph(spark, sf_dir).graph
    return g.nodes, g.edges


#: Scores of large graphs are far below the operators' tolerance, which would end at once.
SETTLED = 1e-9

COMMERCE = (
    f"with recursive n as (select {SPAN} + c_custkey id from customer union all select {2 * SPAN} + o_orderkey from orders union all select {3 * SPAN} + p_partkey from part union all select {4 * SPAN} + s_suppkey from supplier "
    f"union all select {5 * SPAN} + n_nationkey from nation union all select {6 * SPAN} + r_regionkey from region), "
    f"e as (select {SPAN} + o_custkey s, {2 * SPAN} + o_orderkey t, 1.0::double w from orders union all select {2 * SPAN} + l_orderkey, {3 * SPAN} + l_partkey, l_discount from lineitem union all select {3 * SPAN} + l_partkey, {4 * SPAN} + l_suppkey, l_discount from lineitem "
    f"union all select {SPAN} + c_custkey, {5 * SPAN} + c_nationkey, 1.0 from customer union all select {4 * SPAN} + s_suppkey, {5 * SPAN} + s_nationkey, 1.0 from supplier union all select {5 * SPAN} + n_nationkey, {6 * SPAN} + n_regionkey, 1.0 from nation) "
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the users of consecutive events, recorded at the later event."""
    e = table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("_a"), F.col("user_id").alias("source"))
    b = e.select((F.col("event_id") - 1).alias("_a"), F.col("user_id").alias("target"), nanos(F.col("ts")).alias("created_at"), F.col("value").alias("weight"))
    return a.join(b, "_a").select(F.col("_a").alias("id"), "source", "target", "created_at", "weight", (F.col("weight") / 200).alias("cost_signal"))


CHAIN = "with c as (select a.user_id s, b.user_id t, epoch_us(b.ts) * 1000 mo, b.value w from events a join events b on b.event_id = a.event_id + 1) "


@query(COMMERCE + "select n.id node, coalesce(d, 0) degree, round(coalesce(d, 0) / (select count(*) - 1 from n), 9) score from n left join (select s, count(*) d from e group by 1) on s = n.id")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.degree_centrality(*commerce(spark, sf_dir)), 9, "score")


def pagerank_sql(rounds: int) -> str:
    sql = COMMERCE + ", k as (select count(*)::double k from n), d as (select s, count(*) g from e group by 1), r0 as (select id, 1 / k x from n, k)"
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        sql += (
            f", r{i} as (select n.id, 0.15 / k + 0.85 * (coalesce(z.x, 0) + (select coalesce(sum(x), 0) from {p} where id not in (select s from d)) / k) x from n cross join k "
            f"left join (select t, sum({p}.x / g) x from e join {p} on {p}.id = e.s join d on d.s = e.s group by 1) z on z.t = n.id)"
        )
    return sql + f" select id node, round(x, 9) score from r{rounds}"


@query(pagerank_sql(4))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.pagerank(*commerce(spark, sf_dir), rounds=4, tolerance=None), 9, "score")


@query(pagerank_sql(4).replace("select id, 1 / k x from n, k", f"select id, case when id = {5 * SPAN} then 1.0 else 0.0 end x from n, k").replace("0.15 / k + 0.85", f"(case when n.id = {5 * SPAN} then 0.15 else 0.0 end) + 0.85").replace("in (select s from d)) / k)", f"in (select s from d)) * (case when n.id = {5 * SPAN} then 1.0 else 0.0 end))"))
def personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit(5 * SPAN).cast("long").alias("id"))
    return rounded(centrality.personalized_pagerank(*commerce(spark, sf_dir), start, rounds=4, tolerance=None), 9, "score")


@query()
def pagerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the whole graph, until it settles."""
    return centrality.pagerank(*commerce(spark, sf_dir), tolerance=SETTLED)


@query()
def personalized_pagerank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As seen from one customer. Walks return in three or six steps, so changes shrink by 0.85 a round: 150 rounds reach the tolerance."""
    start = spark.range(1).select(F.lit(SPAN + 1).cast("long").alias("id"))
    return centrality.personalized_pagerank(*commerce(spark, sf_dir), start, rounds=150, tolerance=SETTLED)


@query(f"select {SPAN} + c_custkey as node, {SPAN} + c_custkey component from customer union all select {2 * SPAN} + o_orderkey, {SPAN} + o_custkey from orders")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).graph
    return components.connected_components(g.nodes.where("concept_type in ('Customer', 'Order')"), g.edges.where("assoc_type = 'commerce:placed'"))


@query(
    "with recursive c as (select distinct a.user_id s, b.user_id t from events a join events b on b.event_id = a.event_id + 1 where a.user_id % 7 <= b.user_id % 7), u as (select distinct user_id id from events), "
    "r as (select id a, id b from u union select r.a, c.t from r join c on c.s = r.b) select x.a node, max(x.b) component from r x join r y on x.a = y.b and x.b = y.a group by 1"
)
def strongly_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all users, over steps between consecutive events that do not lead to a smaller remainder by 7: a component lies within one remainder."""
    e = chain(spark, sf_dir).where("source % 7 <= target % 7")
    return components.strongly_connected_components(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), e)


@query(
    CHAIN + ", x as (select distinct least(s, t) a, greatest(s, t) b from c where s <> t), v as (select a u, b v from x union all select b, a from x), d as (select u, count(*) k from v group by 1), "
    "tri as (select p.u, count(*) n from v p join v q on p.u = q.u and p.v < q.v join x on x.a = p.v and x.b = q.v group by 1) "
    "select d.u node, coalesce(n, 0) triangles, k as degree, round(case when k > 1 then 2.0 * coalesce(n, 0) / (k * (k - 1)) else 0 end, 9) coefficient from d left join tri using (u)"
)
def clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.clustering(chain(spark, sf_dir)), 9, "coefficient")


@query(
    CHAIN + ", x as (select distinct least(s, t) a, greatest(s, t) b from c where s <> t), v as (select a u, b v from x union all select b, a from x), d as (select u, count(*) k from v group by 1), "
    "tri as (select p.u, count(*) n from v p join v q on p.u = q.u and p.v < q.v join x on x.a = p.v and x.b = q.v group by 1) "
    "select round(2.0 * sum(coalesce(n, 0)) / sum(k * (k - 1)), 9) global_clustering, round(avg(case when k > 1 then 2.0 * coalesce(n, 0) / (k * (k - 1)) else 0 end), 9) average_clustering from d left join tri using (u)"
)
def global_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.global_clustering(centrality.clustering(chain(spark, sf_dir))), 9, "global_clustering", "average_clustering")


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.label_propagation(*commerce(spark, sf_dir))


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.louvain(*commerce(spark, sf_dir))


@query(
    COMMERCE + f", a as (select c_custkey, {6 * SPAN} + n_regionkey r from customer join nation on c_nationkey = n_nationkey), m as (select {SPAN} + c_custkey id, r c from a union all select {2 * SPAN} + o_orderkey, r from orders join a on o_custkey = c_custkey "
    f"union all select {3 * SPAN} + p_partkey, {3 * SPAN} + p_partkey from part union all select {4 * SPAN} + s_suppkey, {6 * SPAN} + n_regionkey from supplier join nation on s_nationkey = n_nationkey union all select {5 * SPAN} + n_nationkey, {6 * SPAN} + n_regionkey from nation "
    f"union all select {6 * SPAN} + r_regionkey, {6 * SPAN} + r_regionkey from region), p as (select s a, t b, w from e union all select t, s, w from e), "
    "q as (select x.c, sum(w) k, sum(case when x.c = y.c then w else 0 end) i from p join m x on x.id = a join m y on y.id = b group by 1) "
    "select round(sum(i / (select sum(k) from q) - (k / (select sum(k) from q)) ** 2), 6) modularity from q"
)
def modularity_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity, on the whole graph with weights, of the partition of customers with their orders, suppliers and nations by region; parts stand alone."""
    nodes, edges = commerce(spark, sf_dir)
    local = edges.where("assoc_type in ('location:in_nation', 'location:in_region')")
    up = paths.reach(local, nodes.select(F.col("id").alias("start")), 1, 2).where(F.col("node") >= 6 * SPAN)
    placed = edges.where("assoc_type = 'commerce:placed'").select(F.col("source").alias("start"), F.col("target").alias("_order"))
    up = up.select("start", "node")
    up = up.unionByName(placed.join(up, "start").select(F.col("_order").alias("start"), "node"))
    c = nodes.join(up, F.col("id") == F.col("start"), "left").select(F.col("id").alias("node"), F.coalesce(up["node"], "id").alias("community"))
    return rounded(community.modularity(edges, c), 6, "modularity")


@query(
    COMMERCE + ", x as (select distinct s, t from e), r as (select s a, t b, 1 d from x union select r.a, x.t, d + 1 from r join x on x.s = r.b where d < 8), f as (select a, b, min(d) d from r where a <> b group by 1, 2), "
    "g as (select a, count(*) k, sum(d) d from f group by 1) select id node, round(coalesce((k / d) * (k / ((select count(*) from n) - 1)), 0), 9) score from n left join g on a = id"
)
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.closeness_centrality(*commerce(spark, sf_dir)), 9, "score")


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.betweenness_centrality(*commerce(spark, sf_dir)), 9, "score")


@query(COMMERCE + "select id node, 0.0::double score from n")
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zero: the edges of this graph form no cycle, so sums over out-neighbours die out."""
    return rounded(centrality.eigenvector_centrality(*commerce(spark, sf_dir), tolerance=SETTLED), 9, "score")


@query()
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = chain(spark, sf_dir)
    return centrality.random_walks(e, spark.range(5).withColumnRenamed("id", "start"), length=10, walks=3)


@query(
    CHAIN.replace("with c", "with recursive c") + ", r(u, mo) using key (u) as (select 0::bigint, 0::bigint union (select t, min(c.mo) from r join c on s = r.u and c.mo >= r.mo left join recurring.r k on k.u = t where k.u is null or c.mo < k.mo group by 1)) "
    "select u node, mo arrival from r where u <> 0"
)
def temporal_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest arrivals from one user over routes of any length."""
    start = spark.range(1).withColumnRenamed("id", "start")
    return paths.earliest_arrivals(chain(spark, sf_dir), start).select("node", "arrival")


@query(
    f"with p as (select distinct l_partkey p from lineitem where l_orderkey = 1), s as (select distinct l_suppkey s from lineitem where l_partkey in (select p from p)) "
    f"select {3 * SPAN} + p as node, 1 as depth from p union all select {4 * SPAN} + s, 2 from s"
)
def k_hop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within two hops of an order: its parts and their suppliers."""
    e = graph(spark, sf_dir).graph.edges.where("assoc_type in ('commerce:contains', 'commerce:supplied_by')")
    return paths.neighbours(e, 2 * SPAN + 1, 2)


@query(
    f"with p as (select distinct l_partkey p from lineitem where l_orderkey = 1) select {2 * SPAN} + l_orderkey as source, {3 * SPAN} + l_partkey as target, count(*) n from lineitem where l_orderkey = 1 and l_partkey in (select p from p) group by 1, 2"
)
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).graph
    _, inner = paths.subgraph(g.nodes, g.edges.where("assoc_type = 'commerce:contains'"), 2 * SPAN + 1, 1, direction="out")
    return inner.groupBy("source", "target").agg(F.count("*").alias("n"))


@query(
    CHAIN.replace("with c", "with recursive c") + ", e as (select s, t, min(greatest(0.001, 1 - w / 200)) k from c group by 1, 2), "
    "r(u, k) using key (u) as (select 0::bigint, 0.0::double union (select e.t, min(round(r.k + e.k, 9)) from r join e on e.s = r.u left join recurring.r o on o.u = e.t where o.u is null or round(r.k + e.k, 9) < o.k group by 1)) "
    "select u node, round(k, 6) as cost from r where u <> 0"
)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest paths of any length from one user: their costs."""
    start = spark.range(1).withColumnRenamed("id", "start")
    out = paths.least_costs(paths.costs(chain(spark, sf_dir)), start)
    return rounded(out.where("node <> 0").select("node", "cost"), 6, "cost")


@query()
def k_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cheapest simple paths of any length between two users."""
    out = paths.k_shortest(paths.costs(chain(spark, sf_dir)), 0, 1, k=3, high=None)
    return rounded(out.select("cost", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path")), 6, "cost")


@query(
    "with o as (select user_id, event_type s, lead(event_type) over (partition by user_id order by ts, event_id) n from events), t as (select s, n, count(*) c from o where n is not null group by 1, 2) "
    "select s state, n next_state, c n, round(c / sum(c) over (partition by s), 9) as share from t"
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.transitions(table(spark, sf_dir, "events"), "user_id", "ts", "event_type"), 9, "share")


@query(
    "with x as (select epoch_us(ts) * 1000 t, event_type k, lead(event_type, 1) over w k1, lead(event_type, 2) over w k2, lead(event_type, 3) over w k3, lead(epoch_us(ts) * 1000, 1) over w t1, "
    "lead(epoch_us(ts) * 1000, 2) over w t2, lead(epoch_us(ts) * 1000, 3) over w t3 from events window w as (partition by user_id order by ts, event_id)), "
    "p as (select k || '->' || k1 p, 2 l, (t1 - t)::double g from x where k1 is not null union all select k || '->' || k1 || '->' || k2, 3, (t2 - t) / 2 from x where k2 is not null "
    "union all select k || '->' || k1 || '->' || k2 || '->' || k3, 4, (t3 - t) / 3 from x where k3 is not null) "
    "select p pattern, l length, count(*) occurrences, round(avg(g) / 1000000000, 3) average_seconds, round(1 - 0.8 * 0.95 ** (count(*) - 1), 6) confidence from p group by 1, 2"
)
def sequence_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", nanos(F.col("ts")))
    out = inference.sequence_patterns(e, "user_id", "at")
    return rounded(out.withColumn("average_seconds", F.round(F.col("average_interval") / 1e9, 3)).drop("average_interval"), 6, "confidence")


