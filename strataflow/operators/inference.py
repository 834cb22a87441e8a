"""Inference from events: episodes, patterns, causes, transitions, associations, and claim upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.functions.scoring import posterior
from strataflow.operators.search import context_similarity

HOUR = 3600 * 10**9


def sessions(events: DataFrame, key: str, at: str, gap: int = HOUR, tie: str = "event_id") -> DataFrame:
    """``events`` with ``session`` (from 1 within the key): a longer gap than ``gap`` begins a new one."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def episodes(events: DataFrame, gap: int = HOUR, starters: tuple[str, ...] = ("GoalFormation", "Planning", "LearningUpdate"), least_similarity: float = 0.4) -> DataFrame:
    """(agent_id, episode, started, ended, events, outcome) of events (event_id, agent_id, ts, event_type, outcome, goals, env).

    An episode ends after a Feedback event or an outcome (Success or Failure, as its second event or later), before a gap
    or a change of context (similarity below the least), and before an event type that starts one.
    """
    w = Window.partitionBy("agent_id").orderBy("ts", "event_id")
    before = lambda c: F.lag(c).over(w)
    none = F.array().cast("array<string>")
    like = context_similarity(F.coalesce("goals", none), F.coalesce(before("goals"), none), F.coalesce("env", none), F.coalesce(before("env"), none))
    no_context = (F.size(F.coalesce("goals", none)) + F.size(F.coalesce("env", none)) == 0) | (F.size(F.coalesce(before("goals"), none)) + F.size(F.coalesce(before("env"), none)) == 0)
    closes = (F.col("event_type") == "Feedback") | F.coalesce(F.col("outcome").isin("Success", "Failure"), F.lit(False))
    # an outcome that is the first event of its episode does not close it: the one before must not have closed one
    e = events.withColumn("_closes", closes)
    cut = (
        before("ts").isNull() | (F.col("ts") - before("ts") > gap) | F.col("event_type").isin(list(starters)) | (~no_context & (like < least_similarity))
    )
    e = e.withColumn("_cut", F.coalesce(cut, F.lit(True)))
    e = e.withColumn("_part", F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("agent_id", "_part").orderBy("ts", "event_id")
    e = e.withColumn("_end", F.col("_closes") & ((F.row_number().over(inner) > 1) | (F.col("event_type") == "Feedback")))
    e = e.withColumn("_sub", F.coalesce(F.sum(F.col("_end").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grouped = e.groupBy("agent_id", "_part", "_sub").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"), F.max_by("outcome", F.struct("ts", "event_id")).alias("outcome")
    )
    order = Window.partitionBy("agent_id").orderBy("started", "_part", "_sub")
    return grouped.select("agent_id", F.row_number().over(order).alias("episode"), "started", "ended", "events", "outcome")


def sequence_patterns(events: DataFrame, key: str, at: str, kind: str = "event_type", tie: str = "event_id", longest: int = 4) -> DataFrame:
    """(pattern, length, occurrences, average_interval, confidence) of event-type runs of 2 to ``longest``.

    confidence = 1 - 0.8 * 0.95 ** (occurrences - 1), the closed form of c <- 0.95 c + 0.05 from 0.2.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    e = events
    for i in range(1, longest):
        e = e.withColumn(f"_k{i}", F.lead(kind, i).over(w)).withColumn(f"_t{i}", F.lead(at, i).over(w))
    options = []
    for n in range(2, longest + 1):
        whole = F.col(f"_k{n - 1}").isNotNull()
        name = F.concat_ws("->", F.col(kind), *(F.col(f"_k{i}") for i in range(1, n)))
        options.append(F.when(whole, F.struct(name.alias("pattern"), F.lit(n).alias("length"), ((F.col(f"_t{n - 1}") - F.col(at)) / (n - 1)).alias("gap"))))
    found = e.select(F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("p")).select("p.*")
    out = found.groupBy("pattern", "length").agg(F.count("*").alias("occurrences"), F.avg("gap").alias("average_interval"))
    return out.withColumn("confidence", 1 - 0.8 * F.pow(F.lit(0.95), F.col("occurrences") - 1))


def transitions(events: DataFrame, key: str, at: str, state: str, tie: str = "event_id") -> DataFrame:
    """(state, next_state, n, share): how often each state follows each."""
    w = Window.partitionBy(key).orderBy(at, tie)
    steps = events.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next_state")).where("next_state is not null")
    counts = steps.groupBy("state", "next_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def transition_posteriors(outcomes: DataFrame) -> DataFrame:
    """(bucket, state, action, next_state, n, probability): smoothed success of each transition.

    outcomes: bucket, state, action, next_state, success.
    """
    ok = F.sum(F.when(F.col("success"), 1).otherwise(0))
    out = outcomes.groupBy("bucket", "state", "action", "next_state").agg(F.count("*").alias("n"), ok.alias("_s"))
    return out.select("bucket", "state", "action", "next_state", "n", posterior(F.col("_s"), F.col("n") - F.col("_s")).alias("probability"))


def causal_edges(events: DataFrame, window: int, least: float = 0.5, width: int | None = None) -> DataFrame:
    """(cause, effect, strength, lag_ms) of pairs of events within a time window.

    strength = 1 when the cause is in the effect's chain, else 0.4 same agent + 0.3 context similarity + 0.3 cause
    succeeded. Events: event_id, agent_id, ts, outcome, goals, env, chain. Pairs meet in time buckets: an effect looks in its
    own bucket and the one before.
    """
    width = width or window
    none = F.array().cast("array<string>")
    e = events.select("event_id", "agent_id", "ts", "outcome", F.coalesce("goals", none).alias("goals"), F.coalesce("env", none).alias("env"), F.coalesce("chain", F.array().cast("array<long>")).alias("chain"))
    cause = e.select(*(F.col(c).alias(f"c_{c}") for c in e.columns), F.floor(F.col("ts") / width).alias("_b"))
    effect = e.withColumn("_b", F.explode(F.array(F.floor(F.col("ts") / width), F.floor(F.col("ts") / width) - 1)))
    pairs = effect.join(cause, "_b").where((F.col("c_ts") < F.col("ts")) & (F.col("ts") - F.col("c_ts") <= window))
    near = 0.4 * (F.col("agent_id") == F.col("c_agent_id")).cast("double") + 0.3 * context_similarity(F.col("goals"), F.col("c_goals"), F.col("env"), F.col("c_env"))
    near = near + 0.3 * F.coalesce((F.col("c_outcome") == "Success").cast("double"), F.lit(0.0))
    strength = F.when(F.array_contains("chain", F.col("c_event_id")), F.lit(1.0)).otherwise(near)
    out = pairs.select(F.col("c_event_id").alias("cause"), F.col("event_id").alias("effect"), strength.alias("strength"), ((F.col("ts") - F.col("c_ts")) / 1e6).alias("lag_ms"))
    return out.where(F.col("strength") >= least)


def significance(kind_bonus: Column, chain_length: Column, goals: Column) -> Column:
    """0.5 + bonus of the type + min(0.05 chain, 0.3) + min(0.02 goals, 0.2), 1 at most."""
    return F.least(F.lit(1.0), 0.5 + kind_bonus + F.least(0.05 * chain_length, F.lit(0.3)) + F.least(0.02 * goals, F.lit(0.2)))


def contextual_associations(events: DataFrame, fingerprint: str, at: str, window: int, least: int = 2) -> DataFrame:
    """(fingerprint, bucket, n, strength): contexts seen ``least`` times or more in a window; strength is their share of it."""
    bucket = F.floor(F.col(at) / window)
    n = events.groupBy(F.col(fingerprint).alias("fingerprint"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("strength", F.col("n") / F.sum("n").over(Window.partitionBy("bucket"))).where(F.col("n") >= least)


def ancestors_of(causes: DataFrame, event: int, high: int | None = None) -> DataFrame:
    """(event, depth): causal ancestors, of any depth or up to ``high``. causes: event_id, parent."""
    from strataflow.operators.paths import neighbours

    return neighbours(causes.select(F.col("event_id").alias("source"), F.col("parent").alias("target")), event, high).select(F.col("node").alias("event"), "depth")


@shared.tidy
def cycles(causes: DataFrame, steps: int = 8) -> DataFrame:
    """Events on a causal cycle, or whose causes lead to one: what is left after removing, until nothing goes, those
    without open parents. A round takes ``steps`` such removals in one plan."""
    links = shared.cut(causes.select("event_id", "parent").where("parent is not null").distinct(), "causes")
    rows = links.count()
    while rows:
        for _ in range(steps):
            links = links.join(links.select(F.col("event_id").alias("parent")).distinct(), "parent", "left_semi")
        links = shared.cut(links.select("event_id", "parent"), "causes")
        before, rows = rows, links.count()
        if rows == before:
            break
    return links.select("event_id").distinct()


def event_graph(events: DataFrame, window: int = HOUR, least: float = 0.3, similar: float = 0.5) -> "Graph":
    """The graph of events (event_id, agent_id, ts, event_type, outcome, goals, env, tool, result, chain).

    Nodes: agents, events, contexts (their goals and environment), goals, tools and results. Edges: an agent performs an event, which
    happens in a context, pursues goals, uses a tool and gives a result; causal edges as inferred; contextual edges of weight
    0.7 x similarity between contexts that an agent meets one after the other. Ids are hashes of kind and name.
    """
    from strataflow.model import Graph

    none = F.array().cast("array<string>")
    e = events.select("event_id", "agent_id", "ts", "event_type", "outcome", F.array_sort(F.coalesce("goals", none)).alias("goals"), F.array_sort(F.coalesce("env", none)).alias("env"), "tool", "result", "chain")
    e = e.withColumn("context", F.concat(F.array_join("goals", ","), F.lit("|"), F.array_join("env", ",")))
    ident = lambda kind, c: F.xxhash64(F.lit(kind), c.cast("string"))
    kinds = [("Agent", F.col("agent_id")), ("Event", F.col("event_id")), ("Context", F.col("context")), ("Goal", F.explode("goals")), ("Tool", F.col("tool")), ("Result", F.col("result"))]
    nodes = None
    for kind, name in kinds:
        named = e.select(name.alias("label"), "ts").withColumn("label", F.col("label").cast("string")).where("label is not null and label <> '|'").groupBy("label").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        part = named.select(ident(kind, F.col("label")).alias("id"), F.lit(kind).alias("node_type"), F.lit(kind).alias("concept_type"), "label", "created_at", "updated_at")
        nodes = part if nodes is None else nodes.unionByName(part)

    def edges(df: DataFrame, source: Column, target: Column, kind: str, name: str, weight: Column) -> DataFrame:
        rows = df.select(source.alias("source"), target.alias("target"), weight.cast("double").alias("weight"), F.col("ts").alias("created_at"))
        rows = rows.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"), F.count("*").cast("int").alias("observation_count"))
        return rows.select(
            F.xxhash64("source", "target", F.lit(name)).alias("id"), "source", "target", F.lit(kind).alias("edge_kind"), F.lit(name).alias("assoc_type"), "weight", F.lit(1.0).alias("confidence"),
            "created_at", F.col("created_at").alias("updated_at"), F.col("created_at").alias("valid_from"), F.lit(True).alias("is_valid"), "observation_count",
        )

    me, one = ident("Event", F.col("event_id")), F.lit(1.0)
    links = [
        edges(e, ident("Agent", F.col("agent_id")), me, "Interaction", "event:performed", one),
        edges(e.where("context <> '|'"), me, ident("Context", F.col("context")), "Contextual", "event:in_context", one),
        edges(e.withColumn("goal", F.explode("goals")), me, ident("Goal", F.col("goal")), "GoalRelation", "event:pursues", one),
        edges(e.where("tool is not null"), me, ident("Tool", F.col("tool")), "Association", "event:uses", one),
        edges(e.where("result is not null"), me, ident("Result", F.col("result")), "Association", "event:results_in", one),
    ]
    causal = causal_edges(e, window, least).select(ident("Event", F.col("cause")).alias("_a"), ident("Event", F.col("effect")).alias("_b"), "strength", F.lit(0).cast("long").alias("ts"))
    links.append(edges(causal, F.col("_a"), F.col("_b"), "Causality", "event:causes", F.col("strength")))
    w = Window.partitionBy("agent_id").orderBy("ts", "event_id")
    met = e.select("context", "ts", "goals", "env", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("context", "goals", "env"))).where("p_context <> context")
    met = met.withColumn("like", context_similarity(F.col("goals"), F.col("p_goals"), F.col("env"), F.col("p_env"))).where(F.col("like") >= similar)
    links.append(edges(met, ident("Context", F.col("p_context")), ident("Context", F.col("context")), "Contextual", "context:similar", 0.7 * F.col("like")))
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return Graph.of(nodes, out)


def code_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, kind, change) of code entities (name, kind, file, body): added, removed or modified."""
    a = before.select("name", "kind", "file", F.sha2("body", 256).alias("_a"))
    b = after.select("name", "kind", "file", F.sha2("body", 256).alias("_b"))
    both = a.join(b, ["name", "kind", "file"], "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select("name", "kind", "file", change.alias("change")).where("change is not null")


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """(claim_id, duplicate_of): claims of the same subject, predicate and object, the oldest stays."""
    first = F.first(F.col("claim_id")).over(Window.partitionBy("subject", "predicate", "object").orderBy("created_at", "claim_id"))
    return claims.select("claim_id", first.alias("duplicate_of")).where("claim_id <> duplicate_of")


#: Words that turn a statement into its opposite.
NEGATIONS = ("not", "never", "no", "cannot", "without")


def contradicting_claims(claims: DataFrame) -> DataFrame:
    """(a, b): claims of one subject and predicate whose texts differ in negation only."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z0-9']+"), lambda w: w != "")
    negative = F.arrays_overlap(words, F.array(*[F.lit(n) for n in NEGATIONS])) | F.exists(words, lambda w: F.endswith(w, F.lit("n't")))
    rest = F.concat_ws(" ", F.array_sort(F.filter(words, lambda w: ~w.isin(list(NEGATIONS)) & ~F.endswith(w, F.lit("n't")))))
    c = claims.select("claim_id", "subject", "predicate", negative.alias("_no"), rest.alias("_rest"))
    yes = c.where("not _no").select(F.col("claim_id").alias("a"), "subject", "predicate", "_rest")
    no = c.where("_no").select(F.col("claim_id").alias("b"), "subject", "predicate", "_rest")
    return yes.join(no, ["subject", "predicate", "_rest"]).select("a", "b")


def purge_edges(edges: DataFrame, now: int, keep: int = 30 * 24 * HOUR) -> DataFrame:
    """Without edges marked as not valid, or closed, longer ago than ``keep``."""
    old = (F.coalesce(~F.col("is_valid"), F.lit(False)) & (F.col("updated_at") < now - keep)) | F.coalesce(F.col("valid_until") < now - keep, F.lit(False))
    return edges.where(~old)


def learning_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of events, contexts and concepts, and the share of outcomes that succeeded."""
    kind = lambda t: F.sum(F.when(F.col("node_type") == t, 1).otherwise(0)).alias(f"{t.lower()}s")
    outcome = F.try_element_at("props", F.lit("outcome"))
    share = edges.agg(F.avg(F.when(outcome.isNotNull(), (outcome == "Success").cast("double"))).alias("success_rate"))
    return nodes.agg(kind("Event"), kind("Context"), kind("Concept")).join(F.broadcast(share))


def for_group(df: DataFrame, group_id) -> DataFrame:
    """One tenant's rows."""
    return df.where(F.col("group_id") == F.lit(group_id))


def scoped(df: DataFrame, group_id=None, user: str | None = None, session: str | None = None) -> DataFrame:
    """Rows within a scope: a tenant's (``group_id``), a user's and a session's (props ``user_id``, ``session_id``).

    Rows without a user or session belong to everyone in the tenant.
    """
    out = df if group_id is None else for_group(df, group_id)
    for key, value in (("user_id", user), ("session_id", session)):
        if value is not None:
            have = F.try_element_at("props", F.lit(key))
            out = out.where(have.isNull() | (have == value))
    return out


def by_scope(df: DataFrame) -> DataFrame:
    """(group_id, user_id, n): rows of each scope."""
    return df.groupBy("group_id", F.try_element_at("props", F.lit("user_id")).alias("user_id")).agg(F.count("*").alias("n"))
