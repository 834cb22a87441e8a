"""Subscriptions: the result of a query, kept current by deltas of the graph.

A delta batch is a DataFrame of changes; applying it gives a new graph, of which only the part that changed can alter
results. Queries of one node pattern and at most one edge, with filters, are maintained from the changed rows alone
(``incremental``). Aggregates over such a pattern keep the multiset of the rows below them: changed rows add to it or retract
from it, and only the groups that they touch are aggregated again. Others, and any query after a gap in the batches'
generations, are run again and compared. Either way a poll gives inserted and deleted rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow import shared
from strataflow.model import EDGES, NODES, Graph, conform
from strataflow.plans import ast as A
from strataflow.plans.compiler import AGGREGATES, Compiler, name_of, walk

MOST = 100
DELTAS = (
    "generation BIGINT, op STRING, object STRING, object_id BIGINT, source BIGINT, target BIGINT, type_tag STRING, old_valid_until BIGINT, new_valid_until BIGINT"
)


def apply_deltas(graph: Graph, deltas: DataFrame) -> Graph:
    """The graph after a batch of deltas, in order of generation.

    op: added (node or edge), removed, superseded (an edge gets new_valid_until), mutated (likewise, when given), merged (a
    node: object_id is absorbed, target survives). Of several changes to one object the last counts.
    """
    last = deltas.groupBy("object", "object_id").agg(F.max_by(F.struct("op", "source", "target", "type_tag", "new_valid_until"), F.struct("generation", "op")).alias("d"))
    n = last.where("object = 'node'").select(F.col("object_id").alias("_id"), "d.*")
    e = last.where("object = 'edge'").select(F.col("object_id").alias("_id"), "d.*")
    gone = n.where("op in ('removed', 'merged')").select("_id")
    new_nodes = conform(n.where("op = 'added'").select(F.col("_id").alias("id"), F.lit("Concept").alias("node_type"), F.col("type_tag").alias("concept_type"), F.col("_id").cast("string").alias("label"), F.lit(0).alias("created_at")), NODES)
    nodes = graph.nodes.join(n.where("op in ('removed', 'merged', 'added')").select("_id"), F.col("id") == F.col("_id"), "left_anti").unionByName(new_nodes)
    added = e.where("op = 'added'").select(
        F.col("_id").alias("id"), "source", "target", F.lit("Association").alias("edge_kind"), F.col("type_tag").alias("assoc_type"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"),
        F.lit(0).alias("created_at"), F.col("new_valid_until").alias("valid_until"), F.lit(True).alias("is_valid"),
    )
    edges = graph.edges.join(e.where("op in ('removed', 'added')").select("_id"), F.col("id") == F.col("_id"), "left_anti").unionByName(conform(added, EDGES))
    until = e.where("op in ('superseded', 'mutated')").select("_id", F.col("new_valid_until").alias("_until"))
    edges = edges.join(until, F.col("id") == F.col("_id"), "left").withColumn("valid_until", F.coalesce("_until", "valid_until")).drop("_id", "_until")
    for end in ("source", "target"):
        merged = n.where("op = 'merged'").select(F.col("_id").alias("_m"), F.col("target").alias("_to"))
        edges = edges.join(merged, F.col(end) == F.col("_m"), "left").withColumn(end, F.coalesce("_to", end)).drop("_m", "_to")
    # edges of nodes that are gone go with them
    for end in ("source", "target"):
        edges = edges.join(gone, F.col(end) == F.col("_id"), "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def incremental(q: A.Query) -> bool:
    """Whether changed nodes and edges alone determine the change of the result: one pattern of at most one edge
    of fixed length, filters without functions, and neither aggregates with HAVING nor order nor limit."""
    if len(q.patterns) != 1 or q.joins or q.limit is not None or q.order_by or q.having is not None:
        return False
    p = q.patterns[0]
    if len(p.edges) > 1 or any(e.high is not None for e in p.edges):
        return False
    if q.where is not None and any(isinstance(x, (A.Predicate, A.Call)) for x in walk(q.where)):
        return False
    calls = [x for i in q.items for x in walk(i.expr) if isinstance(x, A.Call) and x.name in AGGREGATES]
    return not calls and not any(i.distinct for i in q.items)


@dataclass(frozen=True)
class Grouping:
    """An aggregating query in two steps: its rows (keys k0.., arguments v0.., as a query) and what each item makes of them."""

    rows: A.Query
    items: tuple[tuple[str, str, A.Call | None], ...]  # (output name, column of the rows, aggregate or None)

    @property
    def keys(self) -> list[str]:
        return [c for _, c, call in self.items if call is None]

    def multiset(self, rows: DataFrame, sign: int = 1) -> DataFrame:
        return rows.groupBy(*rows.columns).agg((sign * F.count("*")).cast("long").alias("_n"))

    def aggregate(self, state: DataFrame) -> DataFrame:
        """The query's result from a multiset of its rows."""

        def value(column: str, call: A.Call) -> Column:
            v, n = F.col(column), F.col("_n")
            filled = F.when(v.isNotNull(), n)
            if call.name == "count":
                if isinstance(call.args[0], A.Star):
                    return F.coalesce(F.sum(n), F.lit(0)).cast("long")
                return F.count_distinct(v) if call.distinct else F.coalesce(F.sum(filled), F.lit(0)).cast("long")
            if call.name == "sum":
                return F.sum_distinct(v) if call.distinct else F.sum(v * n)
            if call.name == "avg":
                return F.sum(v * n) / F.sum(filled)
            if call.name == "collect":
                all_values = F.flatten(F.collect_list(F.array_repeat(F.struct(v.alias("x")), F.lit(1) if call.distinct else n.cast("int"))))
                all_values = F.array_distinct(all_values) if call.distinct else all_values
                return F.transform(F.array_sort(all_values), lambda s: s["x"])
            return {"min": F.min, "max": F.max}[call.name](v)

        aggs = [value(c, call).alias(f"_r{i}") for i, (_, c, call) in enumerate(self.items) if call is not None]
        out = state.groupBy(*dict.fromkeys(self.keys)).agg(*aggs) if self.keys else state.agg(*aggs)
        return out.select(*(F.col(c if call is None else f"_r{i}").alias(name) for i, (name, c, call) in enumerate(self.items)))


def grouping(q: A.Query) -> Grouping | None:
    """How to maintain a query whose items are keys and plain aggregates over one pattern of at most one edge; None for others."""
    calls = [isinstance(i.expr, A.Call) and i.expr.name in AGGREGATES for i in q.items]
    if not any(calls) or any(i.distinct for i in q.items):
        return None
    plain = [i.expr for i, call in zip(q.items, calls) if not call]
    nested = [x for e in plain for x in walk(e) if isinstance(x, A.Call) and x.name in AGGREGATES]
    aliases = {i.alias: i.expr for i in q.items if i.alias}
    grouped = [aliases.get(e.name, e) if isinstance(e, A.Var) else e for e in q.group_by]
    if nested or any(e not in plain for e in grouped) or any(len(i.expr.args) != 1 for i, call in zip(q.items, calls) if call):
        return None
    items, rows, names = [], [], []
    for k, (item, call) in enumerate(zip(q.items, calls)):
        base = item.alias or name_of(item.expr, k)
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
        argument = item.expr.args[0] if call else item.expr
        if call and item.expr.name == "count" and isinstance(argument, A.Var) and argument.name in {x.var for p in q.patterns for x in p.nodes}:
            argument = A.Prop(argument.name, "id")
        items.append((name, f"c{k}", item.expr if call else None))
        rows.append(A.Item(A.Literal(1) if isinstance(argument, A.Star) else argument, f"c{k}"))
    below = replace(q, items=tuple(rows), group_by=())
    return Grouping(below, tuple(items)) if incremental(below) else None


def triggers(q: A.Query) -> tuple[set[str] | None, set[str] | None]:
    """(labels, edge types) that can matter to the query, lower case; None: any. Batches without them are skipped."""
    labels = [label.lower() for p in q.patterns for n in p.nodes for label in n.labels]
    any_label = any(not n.labels for p in q.patterns for n in p.nodes)
    kinds = [e.kind.lower() for p in q.patterns for e in p.edges if e.kind]
    any_kind = any(not e.kind for p in q.patterns for e in p.edges)
    return None if any_label else set(labels), None if any_kind else set(kinds)


@dataclass
class Subscription:
    """A standing query of an engine."""

    engine: object
    query: A.Query
    id: int
    generation: int = 0
    pending: list = field(default_factory=list)
    last: int | None = None  # the last generation of deltas that was seen

    def __post_init__(self):
        if len(self.engine.subscriptions) >= MOST:
            raise ValueError(f"more than {MOST} subscriptions")
        self.grouping = grouping(self.query)
        self.incremental = self.grouping is not None or incremental(self.query)
        self.start()

    def start(self) -> None:
        """The result on the engine's present graph."""
        graph = self.engine.graph
        if self.grouping:
            self.state = shared.cut(self.grouping.multiset(self._run(graph, self.grouping.rows)), "state")
            self.result = shared.cut(self.grouping.aggregate(self.state), "subscription")
        else:
            self.result = shared.cut(self._run(graph), "subscription")

    def _run(self, graph: Graph, query: A.Query | None = None) -> DataFrame:
        return Compiler(self.engine.spark, graph, self.engine.registered, self.engine._clock(), self.engine.compat).compile(query or self.query)

    def concerns(self, deltas: DataFrame) -> bool:
        """Whether the batch can change the result; edge changes matter by their type, removals and merges always."""
        labels, kinds = triggers(self.query)
        if kinds is None or not self.query.patterns:
            return not deltas.isEmpty()
        tag = F.lower(F.coalesce("type_tag", F.lit("")))
        hit = F.col("op").isin("removed", "merged", "superseded", "mutated") | tag.isin(list(kinds)) | F.split(tag, ":")[0].isin(list(kinds))
        hit = hit | ((F.col("object") == "node") & (F.lit(labels is None) | tag.isin(list(labels or ()))))
        return not deltas.where(hit).isEmpty()

    def _touched(self, before: Graph, after: Graph, deltas: DataFrame) -> tuple[Graph, Graph]:
        """The parts of both graphs that the batch's objects belong to."""
        nodes = deltas.where("object = 'node'").select(F.col("object_id").alias("_id")).unionByName(deltas.where("op = 'merged'").select(F.col("target").alias("_id"))).distinct()
        edges = deltas.where("object = 'edge'").select(F.col("object_id").alias("_e")).distinct()

        def part(g: Graph) -> Graph:
            hit = g.edges.join(edges, g.edges["id"] == edges["_e"], "left_semi")
            at = g.edges.join(nodes, g.edges["source"] == nodes["_id"], "left_semi").unionByName(g.edges.join(nodes, g.edges["target"] == nodes["_id"], "left_semi"))
            e = hit.unionByName(at).dropDuplicates(["id"])
            ends = e.select(F.col("source").alias("_id")).unionByName(e.select(F.col("target").alias("_id"))).unionByName(nodes).distinct()
            return Graph(g.nodes.join(ends, g.nodes["id"] == ends["_id"], "left_semi"), e)

        if not self.query.patterns[0].edges:  # nodes alone
            keep = lambda g: Graph(g.nodes.join(nodes, g.nodes["id"] == nodes["_id"], "left_semi"), g.edges.limit(0))
            return keep(before), keep(after)
        return part(before), part(after)

    def _regrouped(self, before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
        """(old, new) rows of the groups that the change of ``before`` into ``after`` touches; the state moves on."""
        g = self.grouping
        signed = g.multiset(self._run(after, g.rows)).unionByName(g.multiset(self._run(before, g.rows), -1))
        columns = [c for c in signed.columns if c != "_n"]
        total = lambda df: df.groupBy(*columns).agg(F.sum("_n").alias("_n"))
        delta = shared.cut(total(signed).where("_n <> 0"), "delta")
        state = shared.cut(total(self.state.unionByName(delta)).where("_n > 0"), "state")
        old, new = self.state, state
        if g.keys:
            keys = delta.select(*(F.col(k).alias(f"_{k}") for k in g.keys)).distinct()
            same = lambda df: [df[k].eqNullSafe(keys[f"_{k}"]) for k in g.keys]
            old, new = old.join(keys, same(old), "left_semi"), new.join(keys, same(new), "left_semi")
        out = shared.cut(g.aggregate(old), "old"), shared.cut(g.aggregate(new), "new")
        shared.drop(self.state, delta)
        self.state = state
        return out

    def advance(self, before: Graph, after: Graph, deltas: DataFrame, span: tuple[int | None, int | None] = (None, None)) -> tuple[DataFrame, DataFrame] | None:
        """(inserted, deleted) rows; None when the batch does not concern the query. ``span``: the batch's least and
        greatest generation; when the least does not follow the last one seen, changes were missed and the query is run again."""
        gap = self.last is not None and span[0] is not None and span[0] > self.last + 1
        self.last = span[1] if span[1] is not None else self.last
        if not gap and not self.concerns(deltas):
            return None
        kept = self.result
        if gap or not self.incremental:
            self.start()
            old, new = kept, self.result
        elif self.grouping:
            old, new = self._regrouped(*self._touched(before, after, deltas))
        else:
            a, b = self._touched(before, after, deltas)
            old, new = shared.cut(self._run(a), "old"), shared.cut(self._run(b), "new")
        inserted, deleted = shared.cut(new.exceptAll(old), "inserted"), shared.cut(old.exceptAll(new), "deleted")
        if self.result is kept:
            self.result = shared.cut(kept.exceptAll(deleted).unionByName(inserted), "subscription")
            shared.drop(old, new)
        shared.drop(kept)
        self.generation += 1
        self.pending.append((inserted, deleted))
        return inserted, deleted

    def poll(self) -> list[tuple[DataFrame, DataFrame]]:
        """Changes since the last poll."""
        out, self.pending = self.pending, []
        return out


def push(engine, deltas: DataFrame, keep: bool = False) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Apply a batch to an engine's graph and advance its subscriptions. The tables of the graph before go, unless ``keep``."""
    deltas = shared.cut(deltas, "deltas")
    before = engine.graph
    after = apply_deltas(before, deltas)
    after = Graph(shared.cut(after.nodes, "nodes"), shared.cut(after.edges, "edges"))
    engine.graph = after
    span = tuple(deltas.agg(F.min("generation"), F.max("generation")).first())
    changed = {}
    for s in engine.subscriptions.values():
        change = s.advance(before, after, deltas, span)
        if change is not None:
            changed[s.id] = change
    shared.drop(deltas)
    if not keep:
        shared.drop(before.nodes, before.edges)
    return changed


def follow(engine, deltas: DataFrame, checkpoint: str, interval: str | None = None):
    """Run a streaming DataFrame of deltas into the engine.

    After every batch the graph's tables and the batch's number are noted beside the checkpoint. A restart takes up the
    noted graph, starts the subscriptions on it, and skips a batch that it already has.
    """
    note = f"{checkpoint.rstrip('/')}-graph.json"
    state = shared.load_json(engine.spark, note) or {"batch": -1}
    if state["batch"] >= 0:
        engine.graph = Graph(shared.read(engine.spark, state["nodes"]), shared.read(engine.spark, state["edges"]))
        for s in engine.subscriptions.values():
            s.start()
            s.last = state["generation"]

    def batch(df: DataFrame, number: int) -> None:
        if number <= state["batch"]:
            return
        before = engine.graph
        push(engine, df, keep=True)
        last = max((s.last for s in engine.subscriptions.values() if s.last is not None), default=None)
        state.update(batch=number, nodes=engine.graph.nodes._written_to, edges=engine.graph.edges._written_to, generation=last)
        shared.save_json(engine.spark, note, state)
        shared.drop(before.nodes, before.edges)

    w = deltas.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def signed_aggregate(state: DataFrame, changes: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts, sums and averages by group after signed changes (columns by..., value, sign of 1 or -1).

    ``state``: by..., n, total. Groups without rows go. Minima and maxima need the rows: use multiset_aggregate.
    """
    delta = changes.groupBy(*by).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col(value)).alias("total"))
    out = state.select(*by, "n", "total").unionByName(delta).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    return out.withColumn("average", F.col("total") / F.col("n"))


def multiset_aggregate(values: DataFrame, changes: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(values, extremes): the multiset of values by group (by..., value, n) after signed changes, and its least and greatest."""
    delta = changes.groupBy(*by, value).agg(F.sum("sign").alias("n"))
    new = values.unionByName(delta).groupBy(*by, value).agg(F.sum("n").alias("n")).where("n > 0")
    return new, new.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))


def on_change(subscription: Subscription, handler) -> None:
    """Call a handler with (inserted, deleted) for each pending change of a subscription."""
    for inserted, deleted in subscription.poll():
        handler(inserted, deleted)
