"""Versions, viewports, interval algebra and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import temporal as T
from strataflow.model import event_versions, nanos, table
from strataflow.operators import temporal as O
from strataflow.queries.registry import NOW, graph, query, tql, versioned

DAY = 86400 * 10**9
#: Versions of the user_state table, and intervals of orders, in SQL.
VERSIONS = (
    "with v as (select user_id, event_id, event_type, value, epoch_us(ts) * 1000 f, lead(epoch_us(ts) * 1000) over (partition by user_id order by ts, event_id) u from events) "
)
PLACED = (
    "with o as (select o_custkey c, o_orderkey k, epoch_us(o_orderdate) * 1000 f, lead(epoch_us(o_orderdate) * 1000) over (partition by o_custkey order by o_orderdate, o_orderkey) u from orders) "
)
JAN10, JAN20 = 1704844800 * 10**9, 1705708800 * 10**9
Y1998, Y1999 = 883612800 * 10**9, 915148800 * 10**9


@query(VERSIONS + "select event_id, user_id, f valid_from, u valid_until from v")
def scd2_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", nanos(F.col("ts")).alias("valid_from"))
    return O.close_versions(e, ["user_id"], "valid_from", "event_id")


tql("when_active", versioned, "FROM user_state RETURN user_id AS u, event_type AS state", VERSIONS + "select user_id u, event_type state from v where u is null")
tql("when_point", versioned, 'FROM user_state WHEN "2024-01-10" RETURN user_id AS u, event_type AS state, value AS amount',
    VERSIONS + f"select user_id u, event_type state, value amount from v where f <= {JAN10} and (u is null or u > {JAN10})")
tql("when_range", versioned, 'FROM user_state WHEN "2024-01-10" TO "2024-01-20" RETURN user_id AS u, count(*) AS n',
    VERSIONS + f"select user_id u, count(*) n from v where f <= {JAN20} and (u is null or u >= {JAN10}) group by 1")
tql("when_last", versioned, 'FROM user_state WHEN LAST "7d" RETURN event_type AS state, count(*) AS n',
    VERSIONS + f"select event_type state, count(*) n from v where f <= {NOW} and (u is null or u >= {NOW - 7 * DAY}) group by 1")
tql("when_all", versioned, "FROM user_state WHEN ALL RETURN event_type AS state, count(*) AS n", "select event_type state, count(*) n from events group by 1")
tql("as_of_txn", versioned, 'FROM user_state WHEN ALL AS OF "2024-01-10" RETURN event_type AS state, count(*) AS n',
    VERSIONS + f"select event_type state, count(*) n from v where f <= {JAN10} group by 1")
tql("bitemporal", versioned, 'FROM user_state WHEN "2024-01-10" AS OF "2024-01-20" RETURN event_type AS state, count(*) AS n',
    VERSIONS + f"select event_type state, count(*) n from v where f <= {JAN10} and (u is null or u > {JAN10}) and f <= {JAN20} group by 1")
tql("edges_when_point", graph, 'MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN "1998-01-01" RETURN c.name AS customer, o.name AS ord',
    PLACED + f"select c_name customer, k::varchar ord from o join customer on c_custkey = c where f <= {Y1998} and (u is null or u > {Y1998})")
tql("edges_when_range", graph, 'MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN "1998-01-01" TO "1999-01-01" RETURN count(*) AS n',
    PLACED + f"select count(*) n from o where f < {Y1999} and (u is null or u > {Y1998})")
tql("edges_as_of", graph, 'MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN ALL AS OF "1998-01-01" RETURN o.status AS status, count(*) AS n',
    f"select o_orderstatus status, count(*) n from orders where epoch_us(o_orderdate) * 1000 <= {Y1998} group by 1")
tql("duration_open_ended", graph, "MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN ALL RETURN open_ended(r) AS still_open, count(*) AS n, max(duration(r)) AS longest",
    PLACED + "select u is null still_open, count(*) n, max(case when u > f then u - f end) longest from o group by 1")
tql("change_type_counts", graph, 'MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN ALL RETURN change_type(r, "1998-01-01", "1999-01-01") AS change, count(*) AS n',
    PLACED + f"select case when f between {Y1998} and {Y1999} and u between {Y1998} and {Y1999} then 'started_and_ended' when f between {Y1998} and {Y1999} then 'started' when u between {Y1998} and {Y1999} then 'ended' else 'stable' end change, count(*) n from o group by 1")
tql("changed_edges", graph, 'MATCH (c:Customer)-[r:`commerce:placed`]->(o:Order) WHEN ALL WHERE CHANGED(r, "1998-01-01", "1999-01-01") RETURN count(*) AS n',
    PLACED + f"select count(*) n from o where f between {Y1998} and {Y1999} or coalesce(u between {Y1998} and {Y1999}, false)")
tql("successive_orders", graph,
    "MATCH (c:Customer)-[r:`commerce:placed`]->(a:Order), (c)-[s:`commerce:placed`]->(b:Order) WHEN ALL WHERE successive(r, s) AND a.id != b.id RETURN c.name AS customer, count(*) AS n",
    PLACED + "select c_name customer, count(*) n from o r join o s on r.c = s.c and r.k <> s.k join customer on c_custkey = r.c where abs(r.u - s.f) <= 1000000000 group by 1")

_ALLEN = {
    "precedes": "coalesce(a.u, 9223372036854775807) <= b.f", "meets": "coalesce(a.u, 9223372036854775807) = b.f",
    "covers": "a.f <= b.f and coalesce(a.u, 9223372036854775807) >= coalesce(b.u, 9223372036854775807)",
    "starts": "a.f = b.f and coalesce(a.u, 9223372036854775807) <= coalesce(b.u, 9223372036854775807)",
    "finishes": "coalesce(a.u, 9223372036854775807) = coalesce(b.u, 9223372036854775807) and a.f >= b.f",
    "equals": "a.f = b.f and coalesce(a.u, 9223372036854775807) = coalesce(b.u, 9223372036854775807)",
    "overlap": "a.f < coalesce(b.u, 9223372036854775807) and b.f < coalesce(a.u, 9223372036854775807)",
}
for relation, condition in _ALLEN.items():
    tql(f"allen_{relation}", graph,
        f"MATCH (c:Customer)-[r:`commerce:placed`]->(a:Order), (c)-[s:`commerce:placed`]->(b:Order) WHEN ALL WHERE a.id != b.id AND {relation}(r, s) RETURN a.status AS first, b.status AS second, count(*) AS n",
        PLACED + f"select x.o_orderstatus as first, y.o_orderstatus as second, count(*) n from o a join o b on a.c = b.c and a.k <> b.k join orders x on x.o_orderkey = a.k join orders y on y.o_orderkey = b.k where {condition} group by 1, 2")


@query(
    "with h as (select user_id, epoch_us(ts) * 1000 t, value v from events), last as (select user_id, max_by(v, t) v, count(*) n from h where t <= 1705276800000000000 group by 1) "
    "select user_id, v value_then, n samples from last"
)
def history_value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last value at a time, from its history as one array."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct(nanos(F.col("ts")).alias("t"), F.col("value").alias("v")).alias("x"))
    h = e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("history"))
    at = F.lit(1705276800 * 10**9)
    out = h.select("user_id", T.value_at(F.col("history"), at).alias("value_then"), F.size(T.history_window(F.col("history"), F.lit(0), at)).cast("long").alias("samples"))
    return out.where("samples > 0")


@query(
    "with p as (select user_id, event_id, epoch_us(ts) * 1000 t from events where event_type = 'purchase'), c as (select user_id, event_id click, epoch_us(ts) * 1000 t from events where event_type = 'click') "
    "select p.event_id, p.user_id, c.click last_click from p asof left join c on p.user_id = c.user_id and p.t >= c.t"
)
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase with the same user's last click before it."""
    e = table(spark, sf_dir, "events").withColumn("t", nanos(F.col("ts")))
    purchases = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("t").alias("click_t"), F.col("event_id").alias("last_click"))
    return O.asof_join(purchases, clicks, ["user_id"], "t", "click_t", ["last_click"]).select("event_id", "user_id", "last_click")


ERRORS = (
    VERSIONS + ", x as (select *, coalesce(u, 1706745600000000000) e from v) "
    "select a.event_id a, b.event_id b from x a join x b on a.f < b.e and b.f < a.e and a.user_id < b.user_id where a.event_type = 'error' and b.event_type = 'error'"
)


@query(ERRORS)
def interval_join_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of users' error states that overlap in time."""
    v = event_versions(spark, sf_dir).where("event_type = 'error'")
    side = lambda n: v.select(F.col("event_id").alias(n), F.col("user_id").alias(f"u{n}"), F.col("_valid_from").alias(f"f{n}"), F.coalesce("_valid_until", F.lit(NOW)).alias(f"t{n}"))
    pairs = O.interval_join(side("a"), side("b"), ("fa", "ta"), ("fb", "tb"), DAY)
    return pairs.where("ua < ub").select("a", "b")


@query(VERSIONS + "select user_id entity, event_type state, f since, row_number() over (partition by user_id order by f, event_id) as position, u is null is_current from v")
def state_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = event_versions(spark, sf_dir).select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("state"), F.col("_valid_from").alias("since"), F.col("_valid_until").alias("valid_until"))
    out = O.timeline(v, ["entity"], "since", "event_id")
    return out.select("entity", "state", "since", F.col("position").cast("long").alias("position"), "is_current")


@query(VERSIONS + ", r as (select *, row_number() over (partition by user_id order by f desc, event_id desc) rn from v) select event_id, user_id from r where rn = 1 or u is null or u >= 1706745600000000000 - 20 * 86400000000000")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.compact(event_versions(spark, sf_dir), NOW, 20 * DAY).select("event_id", "user_id")


@query("select count(*) as nodes_then, (select count(*) from orders where epoch_us(o_orderdate) * 1000 <= 883612800000000000) edges_then from orders where epoch_us(o_orderdate) * 1000 <= 883612800000000000")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and placed edges recorded by a time."""
    g = O.graph_as_of(graph(spark, sf_dir).graph, Y1998)
    n = g.nodes.where("concept_type = 'Order'").agg(F.count("*").alias("nodes_then"))
    e = g.edges.where("assoc_type = 'commerce:placed'").agg(F.count("*").alias("edges_then"))
    return n.join(e)


@query("select o_orderstatus as status, count(*) n from orders where epoch_us(o_orderdate) * 1000 between 883612800000000000 and 915148800000000000 group by 1")
def graph_rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = O.graph_window(graph(spark, sf_dir).graph, Y1998, Y1999)
    return g.nodes.where("concept_type = 'Order'").groupBy(F.try_element_at("props", F.lit("status")).alias("status")).agg(F.count("*").alias("n"))


