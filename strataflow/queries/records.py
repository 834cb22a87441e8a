"""Stored tables, imports, vectors, ingest and streams: each query runs statements or loads, then returns what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.model import Graph, nanos, node_id, table
from strataflow.queries.registry import NOW, SPAN, graph, query, rounded
from strataflow.session import Engine
from strataflow.sources import importers
from strataflow.sources.tables import ConstraintError, TableStore
from strataflow.streaming import events as streams
from strataflow.streaming import ingest, subscriptions


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared.folder(spark)}/strataflow/{name}-{uuid.uuid4().hex}"


CUSTOMERS = "CREATE TABLE clients (id Int64 PRIMARY KEY, name String NOT NULL, segment String, balance Float64, home NodeRef REFERENCES GRAPH, visits Int64 DEFAULT 0)"


def _clients(spark: SparkSession, sf_dir: str, now: int = 100) -> Engine:
    """A store with all customers loaded as a versioned table."""
    e = Engine(spark, store=TableStore(spark, _folder(spark, "store")), now=now)
    e.execute(CUSTOMERS)
    c = table(spark, sf_dir, "customer")
    e.store.load("clients", c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), node_id("nation", F.col("c_nationkey")).alias("home")), now)
    return e


def _changed(spark: SparkSession, sf_dir: str) -> Engine:
    """The clients after an update at 200 and a deletion at 300."""
    e = _clients(spark, sf_dir)
    e.now = 200
    e.execute('UPDATE clients SET segment = "DEBT", visits = 1 WHERE balance < 0.0')
    e.now = 300
    e.execute('DELETE FROM clients WHERE segment = "MACHINERY"')
    return e


@query("select * from (values (1::bigint, 'a', 1.5, true), (2, 'b', null, false), (3, null, -2.0, null)) t(id, name, v, ok)")
def ddl_create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, store=TableStore(spark, _folder(spark, "store")), now=1)
    e.execute("CREATE TABLE t (id Int64 PRIMARY KEY, name String, v Float64, ok Bool)")
    e.execute('INSERT INTO t (id, name, v, ok) VALUES (1, "a", 1.5, true), (2, "b", NULL, false)')
    e.execute("INSERT INTO t (id, v) VALUES (3, -2.0)")
    return e.query("FROM t RETURN id, name, v, ok")


@query("select c_custkey id, case when c_acctbal < 0 then 'DEBT' else c_mktsegment end segment, (c_acctbal < 0)::bigint visits from customer where c_acctbal < 0 or c_mktsegment <> 'MACHINERY'")
def dml_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).query("FROM clients RETURN id, segment, visits")


@query(
    "select c_custkey id, 100::bigint since, case when c_acctbal < 0 then 200 when c_mktsegment = 'MACHINERY' then 300 end::bigint until from customer union all select c_custkey, 200, null from customer where c_acctbal < 0"
)
def dml_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).query("FROM clients WHEN ALL RETURN id, valid_from AS since, valid_until AS until")


@query("select c_mktsegment segment, count(*) n from customer group by 1")
def dml_point_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was before the changes."""
    return _changed(spark, sf_dir).query("FROM clients WHEN 150 RETURN segment, count(*) AS n")


@query("select count(*) active, (select count(*) from customer) + (select count(*) from customer where c_acctbal < 0) versions from customer where c_acctbal < 0 or c_mktsegment <> 'MACHINERY'")
def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir).store.stats("clients").select(F.col("active").cast("long").alias("active"), "versions")


@query("select case when c_acctbal < 0 then 'DEBT' else c_mktsegment end segment, count(*) n from customer group by 1")
def table_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After compaction long ago closed versions are gone; the newest version of a deleted row stays."""
    e = _changed(spark, sf_dir)
    e.store.compact("clients", 10**18)
    return e.store.read("clients").groupBy("segment").agg(F.count("*").alias("n"))


@query("select c_custkey id, 'basic' tier from customer where c_nationkey = 3 union all select 999999999, 'gold'")
def ddl_alter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _clients(spark, sf_dir)
    e.execute('ALTER TABLE clients ADD COLUMN tier String DEFAULT "basic"')
    e.execute(f'INSERT INTO clients (id, name, tier, home) VALUES (999999999, "new", "gold", NODE({5 * SPAN + 3}))')
    return e.query(f"FROM clients WHERE home = {5 * SPAN + 3} RETURN id, tier")


_FORBIDDEN = {
    "duplicate key": 'INSERT INTO clients (id, name) VALUES (1, "x")', "null name": "INSERT INTO clients (id) VALUES (999999999)", "wrong type": 'INSERT INTO clients (id, name) VALUES ("a", "b")',
    "duplicate by update": 'UPDATE clients SET id = 2 WHERE id = 1', "index over repeats": "CREATE UNIQUE INDEX s ON clients (segment)", "not null without default": "ALTER TABLE clients ADD COLUMN z Int64 NOT NULL",
}


@query("select c, true refused, (select count(*) from customer) n from (values " + ", ".join(f"('{k}')" for k in _FORBIDDEN) + ") t(c)")
def constraints_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the definition forbids are refused, and the table stays as it is."""
    e = _clients(spark, sf_dir)
    out = []
    for name, text in _FORBIDDEN.items():
        try:
            e.execute(text)
            out.append((name, False))
        except ConstraintError:
            out.append((name, True))
    n = e.query("FROM clients RETURN count(*) AS n")
    return spark.createDataFrame(out, "c string, refused boolean").join(F.broadcast(n))  # one row


@query("select 0::bigint tables_left")
def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _clients(spark, sf_dir)
    e.execute("DROP TABLE clients")
    return spark.createDataFrame([(len(e.store.names()),)], "tables_left long")


@query("select c_custkey id, c_name as name from customer where c_nationkey = 7")
def rows_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clients(spark, sf_dir).store.by_node("clients", "home", 5 * SPAN + 7).select("id", "name")


@query("select count(*) n, case when c_nationkey in (7, 8) then 7 else c_nationkey end::bigint nation from customer group by 2")
def node_merge_in_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _clients(spark, sf_dir)
    e.store.merge_nodes("clients", spark.createDataFrame([(5 * SPAN + 8, 5 * SPAN + 7)], "absorbed long, survivor long"))
    return e.query("FROM clients RETURN home, count(*) AS n").select((F.col("home") - 5 * SPAN).alias("nation"), "n")


@query("select 20::bigint n, 20::bigint distinct_rows")
def table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clients(spark, sf_dir).store.scan("clients", offset=40, limit=20).agg(F.count("*").alias("n"), F.count_distinct("_row_id").alias("distinct_rows"))


@query("select c_name as name from customer where c_custkey = 11")
def active_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clients(spark, sf_dir).query("FROM clients WHERE id = 11 RETURN name")


# ---- imports


@query("select o_orderkey k, o_totalprice price, o_orderstatus status from orders")
def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit(' "'), "o_orderstatus", F.lit('", x')).alias("odd"), "o_orderstatus").write.option("header", True).option("escape", '"').csv(path)
    return importers.read_csv(spark, path, {"k": "Int64", "price": "Float64", "status": "String"}, {"k": "o_orderkey", "price": "o_totalprice", "status": "o_orderstatus"})


@query("select event_id, value, event_type = 'purchase' as bought from events")
def ndjson_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "ndjson")
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "value", F.when(F.col("event_type") == "purchase", "yes").otherwise("no").alias("bought"))).alias("value"))
    lines.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return importers.read_ndjson(spark, path, {"event_id": "int", "value": "float", "bought": "bool"})


@query("select n_nationkey::bigint id, n_name as name from nation")
def json_array_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    n = table(spark, sf_dir, "nation")  # 25 rows
    n.agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("value")).write.text(path)
    return importers.read_json_array(spark, path, {"id": "int", "name": "string"})


_CELLS = (("12", "Int64", "12"), (" 7 ", "Int64", "7"), ("x", "Int64", None), ("", "Int64", None), ("null", "String", None), ("a b", "String", "a b"), ("yes", "Bool", "true"), ("0", "Bool", "false"), ("maybe", "Bool", None), ("1e3", "Float64", "1000.0"), ("NULL", "Float64", None))


@query("select * from (values " + ", ".join(f"({i}, {'null' if r is None else chr(39) + r + chr(39)}::varchar)" for i, (_, _, r) in enumerate(_CELLS)) + ") t(i, parsed)")
def cell_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(_CELLS)], "i int, cell string")
    parsed = F.lit(None).cast("string")
    for i, (_, kind, _) in enumerate(_CELLS):
        parsed = F.when(F.col("i") == i, importers.parse_cell(F.col("cell"), kind).cast("string")).otherwise(parsed)
    return cells.select("i", parsed.alias("parsed"))


def _imported(spark: SparkSession, sf_dir: str) -> Graph:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None)
    nodes = n.select(F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")).alias("props"))
    named = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    edges = named.select(
        F.lower("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("Association").alias("kind"), F.lit("location:in_region").alias("assoc_type"), none.cast("double").alias("weight"), F.lit(0.5).alias("confidence"),
        F.lit(5).cast("long").alias("valid_from"), none.cast("long").alias("valid_until"), none.cast("map<string,string>").alias("props"),
    )
    return importers.import_graph(nodes, edges, 7)


@query("select n_name source, r_name target, 0.5 confidence, 1.0 weight from nation join region on n_regionkey = r_regionkey")
def graph_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _imported(spark, sf_dir)
    a, b = (g.nodes.select(F.col("id").alias(f"_{x}"), F.col("label").alias(x)) for x in ("source", "target"))
    e = g.edges.select("source", "target", "confidence", "weight").toDF("s", "t", "confidence", "weight")
    return e.join(a, F.col("s") == F.col("_source")).join(b, F.col("t") == F.col("_target")).select("source", "target", "confidence", "weight")


@query("select 'Nation' kind, count(*) n from nation union all select 'Concept', count(*) from region where r_regionkey in (select n_regionkey from nation)")
def graph_export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "graph")
    importers.export_graph(_imported(spark, sf_dir), path)
    return importers.load_graph(spark, path).nodes.groupBy(F.col("concept_type").alias("kind")).agg(F.count("*").alias("n"))


@query("select vec_id, case when vec_id % 2 = 0 then -1 else label end::int as label from embeddings where vec_id % 5 <> 0")
def vector_store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    s = importers.VectorStore(spark, _folder(spark, "vectors"))
    s.upsert(v)
    s.upsert(v.where("vec_id % 2 = 0").withColumn("label", F.lit(-1)))
    s.delete(v.where("vec_id % 5 = 0"))
    return s.read().select("vec_id", "label")


# ---- ingest


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON request: purchases are transactions, clicks state changes, views simple, others full; each 10th lacks its agent."""
    e = table(spark, sf_dir, "events")
    agent = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    kind = F.when(F.col("event_type") == "purchase", "transaction").when(F.col("event_type") == "click", "state_change").when(F.col("event_type") == "view", "simple").otherwise("full")
    body = F.struct(
        kind.alias("kind"), "event_id", agent.alias("agent_id"), nanos(F.col("ts")).alias("ts"), "event_type", F.col("event_type").alias("action"), agent.alias("entity"), F.col("event_type").alias("new_state"),
        agent.alias("payer"), F.lit("shop").alias("payee"), F.col("value").alias("amount"),
    )
    return e.select(F.to_json(body).alias("body"))


_KIND = "case event_type when 'purchase' then 'transaction' when 'click' then 'state_change' when 'view' then 'simple' else 'full' end"


@query(
    f"with k as (select {_KIND} kind, event_id % 10 <> 0 as known, value from events) select kind, (known and (kind <> 'transaction' or value > 0)) accepted, count(*) n from k group by 1, 2"
)
def event_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ingest.requests(_requests(spark, sf_dir))
    return r.groupBy("kind", F.col("reason").isNull().alias("accepted")).agg(F.count("*").alias("n"))


@query(
    "select case event_type when 'purchase' then 'Transaction' when 'click' then 'StateChange' when 'view' then 'view' else event_type end event_type, count(*) n, count(distinct user_id) agents from events where event_id % 10 <> 0 and (event_type <> 'purchase' or value > 0) group by 1"
)
def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest.events(ingest.requests(_requests(spark, sf_dir)))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("agent_id").alias("agents"))


@query("select 'shop:u' || user_id as key, round(sum(-value), 2) balance from events where event_type = 'purchase' and event_id % 10 <> 0 and value > 0 group by 1")
def ingested_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.operators import memory

    return rounded(memory.ledger_balance(ingest.ledger_entries(ingest.requests(_requests(spark, sf_dir)))).select("key", "balance"), 2, "balance")


@query("select 'u' || user_id entity, 'click' state, max(epoch_us(ts) * 1000) since from events where event_type = 'click' and event_id % 10 <> 0 group by 1")
def ingested_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataflow.operators import memory

    return memory.current_state(ingest.state_changes(ingest.requests(_requests(spark, sf_dir)))).select("entity", "state", "since")


# ---- subscriptions


def _places(spark: SparkSession, sf_dir: str, text: str) -> tuple[Engine, object]:
    g = graph(spark, sf_dir).graph
    nodes = g.nodes.where("concept_type in ('Supplier', 'Nation', 'Region')")
    edges = g.edges.where(f"assoc_type in ('location:in_nation', 'location:in_region') and source >= {4 * SPAN}")
    e = Engine(spark, Graph.of(nodes, edges), now=NOW)
    return e, e.execute(f"SUBSCRIBE {text}")


def _moves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two batches: every supplier of nation 3 moves to nation 4; then suppliers of nation 5 go."""
    s = table(spark, sf_dir, "supplier")
    row = lambda op, obj, oid, src, tgt, until: [F.lit(op).alias("op"), F.lit(obj).alias("object"), oid.cast("long").alias("object_id"), src.cast("long").alias("source"), tgt.cast("long").alias("target"), F.lit("location:in_nation").alias("type_tag"), F.lit(None).cast("long").alias("old_valid_until"), F.lit(until).cast("long").alias("new_valid_until")]
    key, number = node_id("supplier", F.col("s_suppkey")), 5 * SPAN + F.col("s_suppkey")
    moving = s.where("s_nationkey = 3")
    one = moving.select(F.lit(1).cast("long").alias("generation"), *row("superseded", "edge", number, key, node_id("nation", F.lit(3)), 1000)).unionByName(
        moving.select(F.lit(2).cast("long").alias("generation"), *row("added", "edge", 9 * SPAN + F.col("s_suppkey"), key, node_id("nation", F.lit(4)), None)))
    two = s.where("s_nationkey = 5").select(F.lit(3).cast("long").alias("generation"), *row("removed", "node", key, F.lit(None), F.lit(None), None))
    return [one, two]


_MOVED = "with m as (select case when s_nationkey = 3 then 4 else s_nationkey end k, s_suppkey, s_acctbal from supplier where s_nationkey <> 5) "


@query(_MOVED + "select n_name nation, count(*) n, min(s_suppkey) + 4000000000000 low, max(s_suppkey) + 4000000000000 high from m join nation on k = n_nationkey group by 1")
def subscription_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and extremes kept current under supersession, addition and removal."""
    e, sub = _places(spark, sf_dir, "MATCH (s:Supplier)-[r:location]->(n:Nation) RETURN n.name AS nation, count(*) AS n, min(s.id) AS low, max(s.id) AS high")
    for batch in _moves(spark, sf_dir):
        subscriptions.push(e, batch)
    return sub.result


@query(_MOVED + "select s_suppkey + 4000000000000 supplier, n_name nation from m join nation on k = n_nationkey")
def subscription_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, sub = _places(spark, sf_dir, "MATCH (s:Supplier)-[r:location]->(n:Nation) RETURN s.id AS supplier, n.name AS nation")
    for batch in _moves(spark, sf_dir):
        subscriptions.push(e, batch)
    return sub.result


@query(_MOVED + "select r_name region, count(*) n from m join nation on k = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def subscription_varlength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable-length pattern is run again for each batch that concerns it."""
    e, sub = _places(spark, sf_dir, "MATCH (s:Supplier)-[:location*1..2]->(r:Region) RETURN r.name AS region, count(*) AS n")
    for batch in _moves(spark, sf_dir):
        subscriptions.push(e, batch)
    return sub.result


@query("select (select count(*) from supplier where s_nationkey = 3) + 0 inserted, (select count(*) from supplier where s_nationkey = 3) + 0 deleted")
def subscription_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a poll gives after the first batch: rows that came and rows that went."""
    e, sub = _places(spark, sf_dir, "MATCH (s:Supplier)-[r:location]->(n:Nation) RETURN s.id AS supplier, n.name AS nation")
    subscriptions.push(e, _moves(spark, sf_dir)[0])
    ((inserted, deleted),) = sub.poll()
    return inserted.agg(F.count("*").alias("inserted")).join(F.broadcast(deleted.agg(F.count("*").alias("deleted"))))  # one row each


# ---- streams


#: values of ``at`` in a step of _run()
STEP = 1 << 19


def _run(spark: SparkSession, events: DataFrame, build, mode: str = "append", parts: int = 4, at: str | None = None) -> DataFrame:
    """The rows of a stream over ``events``, dealt over ``parts`` files that arrive one after the other.

    With a column ``at`` its values are taken in steps of STEP, each dealt over ``parts`` files, so that no batch grows with the table.
    """
    path, out = _folder(spark, "stream"), _folder(spark, "stream-out")
    if at is None:
        events.repartition(parts).write.parquet(path)
    else:
        low, high = events.agg(F.min(at), F.max(at)).first()
        for first in range(low or 0, (high or 0) + 1, STEP):
            dealt = events.where(F.col(at).between(first, first + STEP - 1)).withColumn("_part", F.pmod(F.xxhash64(at), F.lit(parts)))
            for part in range(parts):
                dealt.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    stream = build(streams.read_events(spark, path, events.schema, 1))
    if mode == "append":
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).format("parquet").start(out)
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def save(df: DataFrame, number: int) -> None:  # complete mode: the last batch has it all
        df.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


@query("select event_id, event_type from events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _timed(spark, sf_dir)
    return _run(spark, e.unionByName(e.where("event_id % 3 = 0")), lambda s: streams.deduplicated(s, lateness="100 days")).select("event_id", "event_type")


@query("select epoch_us(time_bucket(interval '1 day', ts)) * 1000 window_start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, _timed(spark, sf_dir), lambda s: streams.tumbling(s, "1 day", ["event_type"], lateness=None, value="value"), "complete")
    return rounded(out.withColumn("window_start", nanos(F.col("window_start"))), 2, "total")


@query("select user_id::varchar agent_id, event_id from events")
def stream_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of time all events come out, each once, whatever the files' order; events at the end wait for the clock."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("agent_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    last = e.groupBy("agent_id").agg((F.max("ts_ms") + 60_000).alias("ts_ms")).select("agent_id", F.lit(-1).cast("long").alias("event_id"), "ts_ms")
    return _run(spark, e.unionByName(last), streams.reordered, parts=1).where("event_id >= 0").select("agent_id", "event_id")


@query("select event_type as domain, event_id from events")
def stream_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is released once its cause, the event before it of its type, is."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("event_type").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), "event_id", F.array_compact(F.array(before)).alias("parents"))
    return _run(spark, e, streams.causally_ordered, parts=2, at="event_id").select("domain", "event_id")
