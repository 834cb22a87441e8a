"""Search, memory, ontology, streams and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions import scoring
from strataflow.model import nanos, table
from strataflow.operators import inference, memory, ontology, search
from strataflow.queries.registry import NOW, graph, query, rounded
from strataflow.streaming import events as streams

TERMS = ("the", "token", "thing", "license")
_BM25 = (
    "with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w from documents), t as (select doc_id, len(w) l, unnest(w) term from d), "
    "s as (select count(*) n, avg(len(w)) a from d), f as (select doc_id, l, term, count(*) tf from t where term in ({terms}) group by 1, 2, 3), g as (select term, count(*) df from f group by 1), "
    "b as (select doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / a))) score from f join g using (term), s group by 1) "
)


def _bm25_sql(terms) -> str:
    return _BM25.format(terms=", ".join(f"'{t}'" for t in terms))


@query(_bm25_sql(TERMS) + "select doc_id, round(score, 6) score from b order by b.score desc, doc_id limit 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.top(search.bm25(table(spark, sf_dir, "documents"), list(TERMS)), 50), 6, "score")


@query("select doc_id from documents where list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'token'])")
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match_all(table(spark, sf_dir, "documents"), ["the", "token"])


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: that of vec_id 0."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_NEAR = "with q as (select embedding::double[] v from embeddings where vec_id = 0), s as (select vec_id, label, list_cosine_similarity(embedding::double[], v) score from embeddings, q) "


@query(_NEAR + "select vec_id, round(score, 4) score from s order by s.score desc, vec_id limit 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.vector_search(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 20), 4, "score")


@query(_NEAR + "select vec_id, round(score, 4) score from s where label = 1 and score >= 0.05 order by s.score desc, vec_id limit 20")
def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.vector_search(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 20, equal={"label": 1}, least=0.05), 4, "score")


_TWO = (
    _bm25_sql(("the", "thing")) + ", b2 as (select doc_id, n_chars::double score from documents), x as (select doc_id, row_number() over (order by score desc, doc_id) r from (select * from b order by score desc, doc_id limit 50)), "
    "y as (select doc_id, row_number() over (order by score desc, doc_id) r from (select * from b2 order by score desc, doc_id limit 50)) "
)


@query(_TWO + "select doc_id, round(sum(1.0 / (60 + r)), 9) score from (select * from x union all select * from y) group by 1")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = search.ranked(search.bm25(d, ["the", "thing"]), "doc_id", 50)
    b = search.ranked(d.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", 50)
    return rounded(search.rrf([a, b], "doc_id"), 9, "score")


@query(
    _bm25_sql(("the", "thing")) + ", b2 as (select doc_id, n_chars::double score from documents), m as (select doc_id, (score - min(score) over ()) / (max(score) over () - min(score) over ()) z from b), "
    "m2 as (select doc_id, (score - min(score) over ()) / (max(score) over () - min(score) over ()) z from b2) select doc_id, round(0.7 * coalesce(m.z, 0) + 0.3 * coalesce(m2.z, 0), 6) score from m full join m2 using (doc_id)"
)
def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    both = search.weighted_fusion(search.bm25(d, ["the", "thing"]), d.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id", 0.7)
    return rounded(both, 6, "score")


@query(f"select event_id, round(exp(-ln(2) * ({NOW} - epoch_us(ts) * 1000) / 3600e9 / 24), 9) decay from events")
def temporal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = nanos(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.temporal_decay(scoring.age_hours(at, F.lit(NOW)), 24.0), 9).alias("decay"))


@query(
    f"select event_id, round((value / 500) * (0.6 + 0.4 * 2 ** (-(({NOW} - epoch_us(ts) * 1000) / 3600e9) / (24 * case event_type when 'click' then 3.0 when 'view' then 14.0 else 365.0 end))) * (0.6 + 0.8 * 0.5), 9) score from events"
)
def claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "Intention").when(F.col("event_type") == "view", "Belief").otherwise("Fact")
    w = scoring.claim_weight(scoring.age_hours(nanos(F.col("ts")), F.lit(NOW)), kind)
    return e.select("event_id", F.round(scoring.claim_score(F.col("value") / 500, w, F.lit(0.5)), 9).alias("score"))


# ---- memory


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of users: purchases are debits, all else credits."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), nanos(F.col("ts")).alias("ts"), F.col("value").alias("amount"), F.when(F.col("event_type") == "purchase", "Debit").otherwise("Credit").alias("direction"), F.col("event_type").alias("description")
    )


@query("select user_id::varchar as key, round(sum(case when event_type = 'purchase' then -value else value end), 2) balance, count(*) entries from events group by 1")
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.ledger_balance(_entries(spark, sf_dir)), 2, "balance")


@query("select user_id::varchar as key, epoch_us(ts) * 1000 ts, round(sum(case when event_type = 'purchase' then -value else value end) over (partition by user_id order by ts), 2) balance from events")
def ledger_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.running_balance(_entries(spark, sf_dir)).select("key", "ts", "balance"), 2, "balance")


@query("select event_type as description, round(sum(value), 2) total, count(*) entries from events group by 1")
def ledger_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.ledger_sum(_entries(spark, sf_dir), ["description"]), 2, "total")


def _payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("payer"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(40)).alias("payee"), F.col("value").alias("amount"), F.lit("EUR").alias("currency"))


_PAY = "with p as (select user_id a, (user_id * 7 + event_id) % 40 b, value v from events where event_type = 'purchase') "


@query(_PAY + "select x person, 'EUR' currency, round(sum(v), 2) net from (select a x, -v v from p union all select b, v from p) group by 1")
def net_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.net_balances(_payments(spark, sf_dir)), 2, "net")


@query(_PAY + "select least(a, b) a, greatest(a, b) b, 'EUR' currency, round(sum(case when a < b then v else -v end), 2) net from p where a <> b group by 1, 2")
def pair_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(memory.pair_balances(_payments(spark, sf_dir)), 2, "net")


@query(
    _PAY + ", n as (select x, round(sum(v) * 100)::bigint c from (select a x, -v v from p union all select b, v from p) group by 1), o as (select x, sum(-c) over (order by -c desc, x) e, -c c from n where c < 0), "
    "g as (select x, sum(c) over (order by c desc, x) e, c from n where c > 0) select 'EUR' currency, o.x debtor, g.x creditor, (least(o.e, g.e) - greatest(o.e - o.c, g.e - g.c)) / 100.0::double amount from o join g on o.e - o.c < g.e and g.e - g.c < o.e"
)
def simplify_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.simplify_debts(memory.net_balances(_payments(spark, sf_dir)))


@query("select user_id entity, 'activity' category, max_by(event_type, ts) as state, max(epoch_us(ts) * 1000) since from events group by 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.current_state(_states(spark, sf_dir))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.lit("activity").alias("category"), F.col("event_type").alias("target"), nanos(F.col("ts")).alias("valid_from"))


@query("select user_id entity, lag(event_type) over (partition by user_id order by ts) from_state, event_type to_state, epoch_us(ts) * 1000 as at from events")
def state_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.state_history(_states(spark, sf_dir)).drop("category")


@query("select distinct event_type item from events where user_id = 1 and value > 5 intersect select event_type from events where user_id = 2 and value > 5")
def common_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 5").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("item"))
    return memory.common_preferences(e, "1", "2")


@query("select user_id entity, event_type item, row_number() over (partition by user_id order by max(ts) desc, event_type) as position from events group by 1, 2")
def preference_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("item")).agg(F.max(nanos(F.col("ts"))).alias("ts"))
    return memory.rank_preferences(e, "ts").select("entity", "item", F.col("position").cast("long").alias("position"))


@query(
    "with r as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 n, ts from events), c as (select user_id, n // 3 k, string_agg(event_id, ',' order by event_id) m, count(*) c, sum(abs(value)) s from r group by 1, 2), "
    "g as (select *, row_number() over (partition by user_id order by k) q from c where c = 3 and s > 0) select user_id bucket, k chunk, m members from g where q <= 3"
)
def consolidate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("bucket"), F.col("event_id").alias("memory_id"), nanos(F.col("ts")).alias("formed_at"), F.col("value").alias("signal"), F.lit("Episodic").alias("tier"))
    out = memory.consolidate(m)
    return out.select("bucket", "chunk", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


# ---- ontology and inference


@query(
    "with e as (select 'placed' p, o_custkey + 1000000000000 s, o_orderkey + 2000000000000 t, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) is not null c from orders "
    "union all select 'in_nation', c_custkey + 1000000000000, c_nationkey + 5000000000000, false from customer union all select 'in_nation', s_suppkey + 4000000000000, s_nationkey + 5000000000000, false from supplier "
    "union all select 'in_region', n_nationkey + 5000000000000, n_regionkey + 6000000000000, false from nation), d as (select distinct p, s, t from e), k as (select p, s, count(*) k from d group by 1, 2) "
    "select p predicate, count(*) observations, sum(c::int)::bigint superseded, (select count(*) from k where k.p = e.p) subjects, (select count(*) from k where k.p = e.p and k = 1) single_valued, "
    "(select count(distinct t) from d where d.p = e.p) objects, (select count(*) from d where d.p = e.p) pairs, 0::bigint reverse_pairs from e group by 1"
)
def predicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph(spark, sf_dir).graph.edges.where("assoc_type in ('commerce:placed', 'location:in_nation', 'location:in_region')")
    return ontology.predicate_stats(e)


@query(
    "with e as (select 'placed' p, o_custkey s, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) is not null c from orders union all select 'in_nation', c_custkey, false from customer union all select 'in_nation', -1 - s_suppkey, false from supplier "
    "union all select 'in_region', n_nationkey, false from nation), k as (select p, s, count(*) k from e group by 1, 2), f as (select p, avg((k = 1)::int) >= 0.9 and count(*) >= 3 f from k group by 1) "
    "select p predicate, false as \"symmetric\", f functional, sum(c::int) / count(*) >= 0.7 superseding, sum(c::int) = 0 append_only, round(least(count(*) / (count(*) + 10), 0.95), 6) confidence from e join f using (p) group by p, f"
)
def behaviour_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ontology.infer_behaviour(predicate_stats(spark, sf_dir)), 6, "confidence")


@query(
    "with x as (select user_id, ts, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) > 3600000000 then 1 when lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end n from events), "
    "s as (select *, sum(n) over (partition by user_id order by ts, event_id) k from x) select user_id, k::bigint as session, count(*) n, min(epoch_us(ts)) * 1000 started, max(epoch_us(ts)) * 1000 ended from s group by 1, 2"
)
def session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", nanos(F.col("ts")))
    s = inference.sessions(e, "user_id", "at")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended"))


@query("select epoch_us(time_bucket(interval '6 hours', ts)) * 1000 window_start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.tumbling(e, "6 hours", ["event_type"], value="value")
    return rounded(out.withColumn("window_start", nanos(F.col("window_start"))), 2, "total")


@query(
    "select w window_start, event_type, count(*) n from (select event_type, unnest([b - 43200000000000, b]) w, t from (select event_type, epoch_us(ts) * 1000 t, epoch_us(ts) * 1000 - epoch_us(ts) * 1000 % 43200000000000 b from events)) where t >= w and t < w + 86400000000000 group by 1, 2"
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding(e, "24 hours", "12 hours", ["event_type"]).withColumn("window_start", nanos(F.col("window_start")))


@query("select user_id::varchar as domain, status, count(*) n from (select user_id, case when lag(event_id) over (partition by user_id order by ts) is null then 'Ready' when event_id = lag(event_id) over (partition by user_id order by ts) + 1 then 'Ready' else 'Gap' end status from events) group by 1, 2")
def sequence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("seq"), nanos(F.col("ts")).alias("arrival"))
    return streams.sequence_status(e).groupBy("domain", "status").agg(F.count("*").alias("n"))


@query("select event_id, json_extract_string(props, '$.k')::bigint k from events where json_extract_string(props, '$.k')::bigint > 50")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query("select conv_id, count(*) turns, sum((role = 'user')::int)::bigint user_turns, max(turn) last_turn, sum(length(text))::bigint chars from conversations group by 1")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("select c_mktsegment segment, c_custkey k, o_orderkey ord from (select *, row_number() over (partition by c_mktsegment order by o_totalprice desc, o_orderkey) r from customer join orders on c_custkey = o_custkey) where r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return j.withColumn("_r", r).where("_r <= 3").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"), F.col("o_orderkey").alias("ord"))
