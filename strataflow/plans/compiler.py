"""From the syntax tree to DataFrames.

A binding is a row of flat columns ``variable.column``; only the columns that a query mentions are taken
from the sources, so pruning and pushed filters reach the scans whatever joins follow. The default value
semantics are SQL's. ``compat`` gives the two-valued logic and loose comparisons of the language's
older executors, see ``Semantics``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import temporal as T
from strataflow.operators import paths, temporal
from strataflow.plans import ast as A
from strataflow.plans.lexer import QueryError

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
NODE_COLUMNS = ("id", "node_type", "concept_type", "label", "created_at", "updated_at", "group_id", "confidence", "props")
EDGE_COLUMNS = (
    "id", "source", "target", "edge_kind", "assoc_type", "weight", "confidence", "cost_signal", "created_at", "updated_at", "valid_from", "valid_until",
    "observation_count", "group_id", "props", "confidence_history", "weight_history",
)
NODE_NAMES = {"name": "label", "type": "node_type"}
EDGE_NAMES = {"association_type": "assoc_type", "type": "assoc_type"}
ROW_NAMES = {"row_id": "_row_id", "version_id": "_version_id", "valid_from": "_valid_from", "valid_until": "_valid_until"}
EPSILON = 2.220446049250313e-16


def name_of(e: A.Expr, i: int = 0) -> str:
    """Default output name of an expression."""
    match e:
        case A.Prop(var, name):
            return f"{var}.{name}"
        case A.Var(name):
            return name
        case A.Call(name, _):
            return name
        case A.Literal(value):
            return str(value)
    return f"_col_{i}"


def children(x) -> list:
    """Direct parts of an expression or condition."""
    match x:
        case A.Call(_, args):
            return list(args)
        case A.Compare(_, left, right):
            return [left, right]
        case A.IsNull(e) | A.Like(e, _):
            return [e]
        case A.InList(e, values):
            return [e, *values]
        case A.Between(e, low, high):
            return [e, low, high]
        case A.Predicate(call):
            return [call]
        case A.And(parts) | A.Or(parts):
            return list(parts)
        case A.Not(part):
            return [part]
    return []


def walk(x):
    yield x
    for c in children(x):
        yield from walk(c)


class Semantics:
    """How leaves compare. Default: SQL. ``graph`` and ``table`` reproduce the compat modes:
    conditions are never null, NULL sorts below everything, floats are equal within EPSILON; the graph
    mode compares strings without regard to ASCII case and takes NULL = NULL as true."""

    def __init__(self, mode: str = "ansi"):
        if mode not in ("ansi", "graph", "table"):
            raise ValueError(mode)
        self.mode = mode

    @staticmethod
    def _kind(df: DataFrame, c: Column) -> str:
        return df.select(c).schema[0].dataType.typeName()

    def compare(self, df: DataFrame, op: str, a: Column, b: Column) -> Column:
        if self.mode == "ansi":
            return {
                "=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
                "contains": lambda: F.contains(a, b), "starts_with": lambda: F.startswith(a, b),
            }[op]()
        text = {self._kind(df, a), self._kind(df, b)} == {"string"}
        if self.mode == "graph" and text and op in ("=", "!=", "contains", "starts_with"):
            a, b = F.lower(a), F.lower(b)
        numeric = bool({self._kind(df, a), self._kind(df, b)} & {"double", "float"})
        same = F.abs(a - b) < F.lit(EPSILON) if numeric else a == b
        same = F.coalesce(same, (a.isNull() & b.isNull()) if self.mode == "graph" else F.lit(False))
        less = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
        more = (b.isNull() & a.isNotNull()) | F.coalesce(a > b, F.lit(False))
        if op in ("contains", "starts_with"):
            return F.coalesce(F.contains(a, b) if op == "contains" else F.startswith(a, b), F.lit(False))
        return {"=": same, "!=": ~same, "<": less, ">": more, "<=": ~more, ">=": ~less}[op]

    def wrap(self, c: Column) -> Column:
        return c if self.mode == "ansi" else F.coalesce(c, F.lit(False))


def like(e: Column, pattern: str) -> Column:
    """LIKE without an escape character: % and _ only."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return e.rlike(f"(?s)^{body}$")


@dataclass
class Scope:
    """What the names of a query mean: node and edge variables, and tables by alias."""

    nodes: set[str] = field(default_factory=set)
    edges: set[str] = field(default_factory=set)
    paths: set[str] = field(default_factory=set)  # variable-length: no binding
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table_column(self, alias: str, name: str) -> str:
        have = self.tables[alias].columns
        if name in have:
            return name
        if name in ROW_NAMES and ROW_NAMES[name] in have:
            return ROW_NAMES[name]
        if name == "id" and "_row_id" in have:
            return "_row_id"
        raise QueryError(f"table {alias} has no column {name}")

    def bare(self, name: str) -> A.Prop:
        """A column named without its table, when one table has it."""
        found = [t for t, df in self.tables.items() if name in df.columns or (name in ROW_NAMES and ROW_NAMES[name] in df.columns)]
        if len(found) > 1:
            raise QueryError(f"column {name} is ambiguous: {', '.join(sorted(found))}")
        if not found:
            raise QueryError(f"unknown name {name}")
        return A.Prop(found[0], name)


class Compiler:
    """Compiles queries over a catalog: a graph, tables by name, and the time that ``now()`` means."""

    def __init__(self, spark, graph=None, tables: dict[str, DataFrame] | None = None, now: int = 0, compat: bool = False, max_rows: int | None = None):
        self.spark, self.graph, self.tables = spark, graph, tables or {}
        self.now, self.compat, self.max_rows = now, compat, max_rows

    # ---- query

    def compile(self, q: A.Query) -> DataFrame:
        scope = self._scope(q)
        needed = self._needed(q, scope)
        semantics = Semantics("ansi" if not self.compat else "graph" if q.patterns else "table")
        view = self._view(q)
        df = self._match(q.patterns, scope, needed, view, semantics) if q.patterns else self._scan(q.alias, scope, needed, view)
        for join in q.joins:
            df = self._join(df, join, scope, needed, view)
        df = self._with_paths(df, q, scope)
        x = Expressions(self, df, scope, semantics)
        if q.where is not None:
            df = df.where(x.condition(q.where))
        df = self._project(df, q, x)
        limit = q.limit if self.max_rows is None else min(q.limit or self.max_rows, self.max_rows)
        return df if limit is None else df.limit(limit)

    def _scope(self, q: A.Query) -> Scope:
        s = Scope()
        for p in q.patterns:
            s.nodes |= {n.var for n in p.nodes if n.var}
            for e in p.edges:
                if e.var:
                    (s.paths if e.high is not None else s.edges).add(e.var)
        for alias, table in ([(q.alias, q.table)] if q.table else []) + [(j.alias, j.table) for j in q.joins]:
            if table not in self.tables:
                raise QueryError(f"unknown table {table}")
            if alias in s.tables or alias in s.nodes | s.edges:
                raise QueryError(f"{alias} is used twice")
            s.tables[alias] = self.tables[table]
        if q.patterns and self.graph is None:
            raise QueryError("there is no graph")
        return s

    def _needed(self, q: A.Query, s: Scope) -> dict[str, set[str]]:
        """Columns of each variable that any clause mentions."""
        out: dict[str, set[str]] = {}
        roots: list = [*(i.expr for i in q.items), *q.group_by, *(e for e, _ in q.order_by), *(e for j in q.joins for e in (j.left, j.right))]
        roots += [c for c in (q.where, q.having) if c is not None]
        aliases = {i.alias for i in q.items if i.alias}
        for root in roots:
            for e in walk(root):
                var = prop = None
                if isinstance(e, A.Prop):
                    var, prop = e.var, e.name
                elif isinstance(e, A.Var):
                    if e.name in s.nodes | s.edges | s.paths:
                        var = e.name
                    elif s.tables and (e.name not in aliases or any(e.name in df.columns for df in s.tables.values())):
                        var, prop = s.bare(e.name).var, e.name
                    elif not s.tables and e.name not in aliases:
                        raise QueryError(f"unknown name {e.name}")
                if var is None:
                    continue
                if var in s.tables:
                    out.setdefault(var, set()).add(s.table_column(var, prop))
                elif var in s.nodes:
                    out.setdefault(var, set()).update([self._node_column(prop)] if prop else ["label"])
                elif var in s.edges:
                    out.setdefault(var, set()).update([self._edge_column(prop)] if prop else ["assoc_type", "edge_kind"])
                elif var not in s.paths and var not in aliases:
                    raise QueryError(f"unknown variable {var}")
                elif var in s.paths:
                    raise QueryError(f"{var} stands for a path of variable length and has no properties")
            for e in walk(root):
                if isinstance(e, A.Call):
                    for a in e.args:
                        if isinstance(a, A.Var) and a.name in s.nodes:
                            out.setdefault(a.name, set()).update(_NODE_NEEDS.get(e.name.lower(), ()))
                        if isinstance(a, A.Var) and a.name in s.edges:
                            out.setdefault(a.name, set()).update(_EDGE_NEEDS.get(e.name.lower(), ("valid_from", "valid_until", "created_at")))
        return out

    @staticmethod
    def _node_column(name: str) -> str:
        name = NODE_NAMES.get(name, name)
        return name if name in NODE_COLUMNS else "degree" if name == "degree" else "props"

    @staticmethod
    def _edge_column(name: str) -> str:
        name = EDGE_NAMES.get(name, name)
        return name if name in EDGE_COLUMNS else "props"

    def _view(self, q: A.Query) -> dict:
        view: dict = {"kind": "active"}
        if q.when is not None:
            kind = q.when.kind
            if kind == "all":
                view = {"kind": "all"}
            elif kind == "last":
                if not isinstance(q.when.start, A.Literal):
                    raise QueryError("WHEN LAST takes a duration")
                view = {"kind": "range", "start": self.now - T.parse_duration(q.when.start.value), "end": self.now}
            else:
                view = {"kind": kind, "start": self.time(q.when.start)}
                if kind == "range":
                    view["end"] = self.time(q.when.end)
        if q.as_of is not None:
            view["as_of"] = self.time(q.as_of)
        return view

    def time(self, e: A.Expr) -> int:
        """A constant time in nanoseconds."""
        match e:
            case A.Literal(str() as s):
                return T.parse_time(s, self.compat)
            case A.Literal(int() as n):
                return n
            case A.Call(name, ()) if name.lower() == "now":
                return self.now
            case A.Call(name, (A.Literal(str() as s),)) if name.lower() == "ago":
                return self.now - T.parse_duration(s)
        raise QueryError("expected a constant time")

    # ---- graph

    def _label_filter(self, labels: tuple[str, ...]) -> Column:
        """Any of the labels, as node or concept type, in any case."""
        wanted = [x.lower() for x in labels]
        return F.lower("node_type").isin(wanted) | F.coalesce(F.lower("concept_type").isin(wanted), F.lit(False))

    def _nodes(self, p: A.NodePattern, var: str, columns: set[str], view: dict, semantics: Semantics) -> DataFrame:
        df = self.graph.nodes
        if view.get("as_of") is not None:
            df = df.where(F.col("created_at") <= view["as_of"])
        if p.labels:
            df = df.where(self._label_filter(p.labels))
        for key, value in p.props:
            column = self._node_column(key)
            c = F.try_element_at("props", F.lit(key)) if column == "props" else F.col(column)
            value = F.lit(value.value if column != "props" or value.value is None else str(value.value))
            df = df.where(semantics.compare(df, "=", c, value))
        return df.select(*(F.col(c).alias(f"{var}.{c}") for c in sorted(columns | {"id"}) if c != "degree"))

    def _edge_filter(self, kind: str) -> Column:
        """Exact association type, its category (in any case), or the edge kind's snake-case name."""
        snake = F.lower(F.regexp_replace("edge_kind", r"(?<=[a-z])(?=[A-Z])", "_"))
        k = kind.lower()
        assoc = F.coalesce((F.col("assoc_type") == kind) | F.startswith(F.lower("assoc_type"), F.lit(f"{k}:")), F.lit(False))
        return assoc | F.coalesce((snake == k) | (F.lower("edge_kind") == k), F.lit(False))

    def _edges(self, p: A.EdgePattern, view: dict) -> DataFrame:
        df = temporal.edge_viewport(self.graph.edges, **view)
        if p.kind:
            df = df.where(self._edge_filter(p.kind))
        for key, value in p.props:
            column = self._edge_column(key)
            c = F.try_element_at("props", F.lit(key)) if column == "props" else F.col(column)
            df = df.where(c == F.lit(value.value if column != "props" else str(value.value)))
        return df

    def _match(self, patterns, scope: Scope, needed, view, semantics: Semantics) -> DataFrame:
        df: DataFrame | None = None
        bound: set[str] = set()
        hidden = 0
        for p in patterns:
            names = []
            for n in p.nodes:
                if n.var is None:
                    hidden += 1
                names.append(n.var or f"_n{hidden}")
            first = names[0]
            if df is not None and first in bound:
                chain, own = df, set(bound)
                chain = self._restrict(chain, p.nodes[0], first, view, semantics)
            else:
                chain, own = self._nodes(p.nodes[0], first, needed.get(first, set()), view, semantics), {first}
            for i, (e, n, name) in enumerate(zip(p.edges, p.nodes[1:], names[1:])):
                hidden += 1
                chain = self._expand(chain, names[i], e, e.var or f"_e{hidden}", n, name, own, needed, view, semantics)
                own.add(name)
                if e.var and e.high is None:
                    own.add(e.var)
            if df is None or first in bound:
                df = chain
            else:
                common = sorted((bound & own) & scope.nodes)
                if common:
                    # the later pattern's columns of shared variables repeat the earlier ones
                    right = chain.select(*(F.col(f"`{c}`").alias(f"_r.{c}" if c.split(".")[0] in common else c) for c in chain.columns))
                    on = [F.col(f"`{c}.id`") == F.col(f"`_r.{c}.id`") for c in common]
                    df = df.join(right, on).drop(*(c for c in right.columns if c.startswith("_r.")))
                else:
                    df = df.crossJoin(chain)  # what disjoint patterns mean
            bound |= own
        return self._with_degrees(df, needed, scope, view)

    def _restrict(self, df: DataFrame, p: A.NodePattern, name: str, view, semantics) -> DataFrame:
        """A bound node's further labels and properties."""
        if not p.labels and not p.props:
            return df
        ids = self._nodes(p, "_x", set(), view, semantics)
        return df.join(ids, F.col(f"`{name}.id`") == F.col("`_x.id`"), "left_semi")

    def _with_degrees(self, df: DataFrame, needed, scope: Scope, view) -> DataFrame:
        for var in sorted(v for v in scope.nodes if "degree" in needed.get(v, ())):
            e = temporal.edge_viewport(self.graph.edges, **view)
            ends = e.select(F.col("source").alias("_id")).unionByName(e.select(F.col("target").alias("_id")))
            degree = ends.groupBy("_id").count().withColumnRenamed("count", f"{var}.degree")
            df = df.join(degree, F.col(f"`{var}.id`") == F.col("_id"), "left").drop("_id").fillna(0, [f"`{var}.degree`"])
        return df

    def _expand(self, df: DataFrame, source: str, e: A.EdgePattern, edge: str, n: A.NodePattern, target: str, bound: set[str], needed, view, semantics) -> DataFrame:
        edges = self._edges(e, view)
        here, there = ("target", "source") if e.incoming else ("source", "target")
        far = "_far"
        if e.high is not None:
            starts = df.select(F.col(f"`{source}.id`").alias("start")).distinct()
            hops = paths.reach(edges, starts, e.low, e.high, "in" if e.incoming else "out").select(F.col("start").alias("_near"), F.col("node").alias(far))
        else:
            columns = sorted(needed.get(edge, set()) - {"degree"})
            hops = edges.select(F.col(here).alias("_near"), F.col(there).alias(far), *(F.col(c).alias(f"{edge}.{c}") for c in columns))
        df = df.join(hops, F.col(f"`{source}.id`") == F.col("_near")).drop("_near")
        if target in bound:
            df = df.where(F.col(far) == F.col(f"`{target}.id`")).drop(far)
            return self._restrict(df, n, target, view, semantics)
        wanted = needed.get(target, set()) - {"id", "degree"}
        if not wanted and not n.labels and not n.props and view.get("as_of") is None:
            # edges join existing nodes, so the end's id is all that is asked for
            return df.withColumnRenamed(far, f"{target}.id")
        nodes = self._nodes(n, target, needed.get(target, set()), view, semantics)
        return df.join(nodes, F.col(far) == F.col(f"`{target}.id`")).drop(far)

    # ---- tables

    def _scan(self, alias: str, scope: Scope, needed, view: dict) -> DataFrame:
        df = scope.tables[alias]
        if "_valid_from" in df.columns:
            df = temporal.row_viewport(df, **view)
        return df.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in sorted(needed.get(alias, set())) or df.columns[:1]))

    def _join(self, df: DataFrame, j: A.Join, scope: Scope, needed, view: dict) -> DataFrame:
        right = self._scan(j.alias, scope, needed, view)

        def side(e: A.Expr) -> tuple[str, str]:
            if isinstance(e, A.Var) and e.name in scope.nodes:
                return e.name, f"{e.name}.id"
            p = scope.bare(e.name) if isinstance(e, A.Var) else e
            if not isinstance(p, A.Prop):
                raise QueryError("ON compares a column with a column or a node")
            if p.var in scope.nodes:
                return p.var, f"{p.var}.{self._node_column(p.name)}"
            if p.var not in scope.tables:
                raise QueryError(f"unknown table {p.var}")
            return p.var, f"{p.var}.{scope.table_column(p.var, p.name)}"

        a, b = side(j.left), side(j.right)
        if a[0] == j.alias:
            a, b = b, a
        if b[0] != j.alias or a[0] == j.alias or a[1] not in df.columns:
            raise QueryError(f"the condition of {j.alias} must join it with what comes before")
        return df.join(right, F.col(f"`{a[1]}`") == F.col(f"`{b[1]}`"), j.kind)

    # ---- path()

    def _with_paths(self, df: DataFrame, q: A.Query, scope: Scope) -> DataFrame:
        """Columns of path(a, b): the labels on a shortest path, over all edges."""
        calls = []
        roots = [*(i.expr for i in q.items), *q.group_by, *(e for e, _ in q.order_by), *(c for c in (q.where, q.having) if c is not None)]
        for root in roots:
            calls += [c for c in walk(root) if isinstance(c, A.Call) and c.name.lower() == "path"]
        for call in dict.fromkeys(calls):
            if len(call.args) != 2 or not all(isinstance(a, A.Var) and a.name in scope.nodes for a in call.args):
                raise QueryError("path() takes two nodes")
            a, b = (x.name for x in call.args)
            pairs = df.select(F.col(f"`{a}.id`").alias("start"), F.col(f"`{b}.id`").alias("node")).distinct()
            steps = self.graph.edges.select("source", "target", F.lit(1.0).alias("cost")).distinct()
            found = paths.shortest_paths(steps, pairs.select("start").distinct())
            found = found.join(pairs, ["start", "node"], "left_semi")
            labels = self.graph.nodes.select(F.col("id").alias("_id"), "label")
            named = found.select("start", "node", F.posexplode("path").alias("_at", "_id")).join(labels, "_id")
            named = named.groupBy("start", "node").agg(F.array_sort(F.collect_list(F.struct("_at", "label"))).alias("_p"))
            named = named.select(F.col("start").alias("_a"), F.col("node").alias("_b"), F.transform("_p", lambda p: p["label"]).alias(f"path({a},{b})"))
            df = df.join(named, (F.col(f"`{a}.id`") == F.col("_a")) & (F.col(f"`{b}.id`") == F.col("_b")), "left").drop("_a", "_b")
        return df

    # ---- RETURN

    def _project(self, df: DataFrame, q: A.Query, x: "Expressions") -> DataFrame:
        names: list[str] = []
        for i, item in enumerate(q.items):
            if isinstance(item.expr, A.Star):
                raise QueryError("RETURN * is not in the language; name the columns")
            base = item.alias or name_of(item.expr, i)
            name, k = base, 1
            while name in names:
                k += 1
                name = f"{base}_{k}"
            names.append(name)
        aggregated = [any(isinstance(e, A.Call) and e.name in AGGREGATES for e in walk(i.expr)) for i in q.items]
        order = [(self._ordinal(e, q, names), e, desc) for e, desc in q.order_by]
        if any(aggregated) or q.group_by:
            keys: dict[A.Expr, str] = {}
            for e in [i.expr for i, agg in zip(q.items, aggregated) if not agg] + list(q.group_by):
                by_alias = next((i.expr for i in q.items if isinstance(e, A.Var) and i.alias == e.name), e)
                if not self.compat or by_alias in [i.expr for i in q.items]:
                    keys.setdefault(by_alias, f"_k{len(keys)}")
            aggs: dict[A.Expr, str] = {}
            roots = [i.expr for i in q.items] + [e for at, e, _ in order if at is None] + ([q.having] if q.having is not None else [])
            for root in roots:
                for e in walk(root):
                    if isinstance(e, A.Call) and e.name in AGGREGATES:
                        aggs.setdefault(e, f"_a{len(aggs)}")
            built = [x.aggregate(e).alias(n) for e, n in aggs.items()] or [F.count("*").alias("_a0")]
            grouped = df.groupBy(*(x.value(e).alias(n) for e, n in keys.items())).agg(*built)
            x = Expressions(self, grouped, x.scope, x.semantics, {**keys, **aggs, **{A.Var(n): self._known(i.expr, keys, aggs) for n, i in zip(names, q.items)}})
            df = grouped
            if q.having is not None and not (self.compat and q.patterns):
                df = df.where(x.condition(q.having))
        elif q.having is not None:
            raise QueryError("HAVING needs an aggregate or GROUP BY")
        values = [x.value(i.expr).alias(n) for i, n in zip(q.items, names)]
        extra = [(x.value(e).alias(f"_o{k}"), f"_o{k}") for k, (at, e, _) in enumerate(order) if at is None]
        distinct = any(i.distinct for i in q.items) and not (self.compat and q.table)
        if distinct and extra:
            raise QueryError("with DISTINCT, ORDER BY takes returned columns only")
        out = df.select(*values, *(c for c, _ in extra))
        if distinct:
            out = out.distinct()
        if order:
            columns = [F.col(f"`{at}`") if at is not None else F.col(f"_o{k}") for k, (at, _, _) in enumerate(order)]
            out = out.orderBy(*(c.desc_nulls_last() if desc else c.asc_nulls_first() for c, (_, _, desc) in zip(columns, order)))
        return out.drop(*(n for _, n in extra))

    @staticmethod
    def _known(e: A.Expr, keys: dict, aggs: dict) -> str | A.Expr:
        return keys.get(e) or aggs.get(e) or e

    @staticmethod
    def _ordinal(e: A.Expr, q: A.Query, names: list[str]) -> str | None:
        """The returned column that an ORDER BY expression names."""
        for item, name in zip(q.items, names):
            if e == item.expr or isinstance(e, A.Var) and e.name == name or isinstance(e, A.Prop) and f"{e.var}.{e.name}" == name:
                return name
        return None


_NODE_NEEDS = {
    "type": ("node_type", "concept_type"), "id": ("id",), "labels": ("node_type", "concept_type"), "properties": ("props",), "created_at": ("created_at",), "updated_at": ("updated_at",),
}
_EDGE_NEEDS = {
    "type": ("assoc_type", "edge_kind"), "id": ("id",), "properties": ("props",), "updated_at": ("updated_at",), "confidence_at": ("confidence_history",),
    "weight_at": ("weight_history",), "confidence_history": ("confidence_history",), "weight_history": ("weight_history",), "created_at": ("created_at",),
    "valid_from": ("valid_from",), "valid_until": ("valid_until",), "duration": ("valid_from", "valid_until"), "open_ended": ("valid_until",), "count": (), "collect": ("assoc_type", "edge_kind"),
}


class Expressions:
    """Compiles expressions and conditions against the columns of a DataFrame."""

    def __init__(self, compiler: Compiler, df: DataFrame, scope: Scope, semantics: Semantics, known: dict | None = None):
        self.c, self.df, self.scope, self.semantics, self.known = compiler, df, scope, semantics, known or {}

    # ---- conditions

    def condition(self, b: A.Bool) -> Column:
        wrap, compare = self.semantics.wrap, self.semantics.compare
        match b:
            case A.And(parts):
                out = self.condition(parts[0])
                for p in parts[1:]:
                    out = out & self.condition(p)
                return out
            case A.Or(parts):
                out = self.condition(parts[0])
                for p in parts[1:]:
                    out = out | self.condition(p)
                return out
            case A.Not(part):
                return ~self.condition(part)
            case A.Compare(op, left, right):
                if op == "contains" and self.df.select(self.value(left)).schema[0].dataType.typeName() == "array":
                    return wrap(F.array_contains(self.value(left), self.value(right)))
                a, c = self._pair(left, right)
                return compare(self.df, op, a, c)
            case A.IsNull(e, negated):
                return self.value(e).isNotNull() if negated else self.value(e).isNull()
            case A.InList(e, values, negated):
                if self.semantics.mode == "ansi":
                    found = self.value(e).isin([v.value for v in values]) if values else F.lit(False)
                else:
                    found = F.lit(False)
                    for v in values:
                        found = found | compare(self.df, "=", *self._pair(e, v))
                return ~found if negated else found
            case A.Between(e, low, high):
                return compare(self.df, ">=", *self._pair(e, low)) & compare(self.df, "<=", *self._pair(e, high))
            case A.Like(e, pattern):
                return wrap(like(self.value(e), pattern))
            case A.Predicate(call):
                return F.lit(False) if self.semantics.mode == "table" else wrap(self.value(call))
        raise QueryError(f"not a condition: {b}")

    def _pair(self, a: A.Expr, b: A.Expr) -> tuple[Column, Column]:
        """Both sides; properties, which are strings, meet number literals as numbers."""
        x, y = self.value(a), self.value(b)
        for side, other in ((a, b), (b, a)):
            if isinstance(other, A.Literal) and isinstance(other.value, (int, float)) and not isinstance(other.value, bool) and self._is_prop(side):
                number = self.value(side).try_cast("double")
                return (number, y) if side is a else (x, number)
        return x, y

    def _is_prop(self, e: A.Expr) -> bool:
        if not isinstance(e, A.Prop) or e in self.known:
            return False
        if e.var in self.scope.nodes:
            return self.c._node_column(e.name) == "props"
        return e.var in self.scope.edges and self.c._edge_column(e.name) == "props"

    # ---- values

    def value(self, e: A.Expr) -> Column:
        if e in self.known:
            k = self.known[e]
            return F.col(k) if isinstance(k, str) else self.value(k)
        match e:
            case A.Literal(value):
                return F.lit(value)
            case A.NodeRef(id):
                return F.lit(id).cast("long")
            case A.Prop(var, name):
                return self._property(var, name)
            case A.Var(name):
                if name in self.scope.nodes:
                    return F.col(f"`{name}.label`")
                if name in self.scope.edges:
                    return F.coalesce(F.col(f"`{name}.assoc_type`"), F.col(f"`{name}.edge_kind`"))
                p = self.scope.bare(name)
                return self.value(p)
            case A.Call():
                return self.call(e)
        raise QueryError(f"cannot evaluate {e}")

    def _property(self, var: str, name: str) -> Column:
        s = self.scope
        if var in s.tables:
            return F.col(f"`{var}.{s.table_column(var, name)}`")
        if var in s.nodes or var in s.edges:
            column = (self.c._node_column if var in s.nodes else self.c._edge_column)(name)
            if column == "props":
                return F.try_element_at(F.col(f"`{var}.props`"), F.lit(name))
            if var in s.edges and name == "type":
                return F.coalesce(F.col(f"`{var}.assoc_type`"), F.col(f"`{var}.edge_kind`")) if f"{var}.edge_kind" in self.df.columns else F.col(f"`{var}.assoc_type`")
            return F.col(f"`{var}.{column}`")
        raise QueryError(f"unknown variable {var}")

    def aggregate(self, call: A.Call) -> Column:
        if len(call.args) != 1:
            raise QueryError(f"{call.name}() takes one argument")
        a = call.args[0]
        if call.name == "count":
            if isinstance(a, A.Star):
                return F.count(F.lit(1))
            if isinstance(a, A.Var) and a.name in self.scope.nodes:
                v = F.col(f"`{a.name}.id`")
            else:
                v = self.value(a)
            return F.count_distinct(v) if call.distinct else F.count(v)
        v = self.value(a)
        if call.name == "collect":
            values = F.collect_list(F.struct(v.alias("x")))
            values = F.array_distinct(values) if call.distinct else values
            return F.transform(F.array_sort(values), lambda s: s["x"])  # sorted, so that results agree; nulls stay
        if call.name == "sum":
            return F.sum_distinct(v) if call.distinct else F.sum(v)
        return {"avg": F.avg, "min": F.min, "max": F.max}[call.name](v)

    def _interval(self, a: A.Expr) -> T.Interval:
        if not isinstance(a, A.Var) or a.name not in self.scope.edges:
            raise QueryError("expected an edge variable")
        return T.Interval(F.col(f"`{a.name}.valid_from`"), F.col(f"`{a.name}.valid_until`"))

    def _moment(self, a: A.Expr) -> Column:
        if isinstance(a, A.Literal) and isinstance(a.value, str):
            return F.lit(T.parse_time(a.value, self.c.compat)).cast("long")
        return self.value(a).cast("long")

    def call(self, e: A.Call) -> Column:
        name, args = e.name.lower(), e.args
        edge = lambda column: F.col(f"`{args[0].name}.{column}`")
        is_edge = bool(args) and isinstance(args[0], A.Var) and args[0].name in self.scope.edges
        is_node = bool(args) and isinstance(args[0], A.Var) and args[0].name in self.scope.nodes

        def need(n: int, most: int | None = None):
            if not n <= len(args) <= (n if most is None else most):
                raise QueryError(f"{e.name}() takes {n if most is None else f'{n} to {most}'} arguments")

        if e.name in AGGREGATES:
            raise QueryError(f"{e.name}() cannot stand here")
        if name == "now":
            need(0)
            return F.lit(self.c.now).cast("long")
        if name == "ago":
            need(1)
            return F.lit(self.c.time(e)).cast("long")
        if name == "coalesce":
            return F.coalesce(*(self.value(a) for a in args))
        if name in ("toupper", "to_upper", "tolower", "to_lower"):
            need(1)
            return (F.upper if "upper" in name else F.lower)(self.value(args[0]).cast("string"))
        if name == "path":
            return F.col(f"`path({args[0].name},{args[1].name})`")
        if name == "hops":
            need(1)
            return T.hops(self.value(args[0]))
        if name in ("time_bucket", "date_trunc"):
            need(2)
            if not isinstance(args[0], A.Literal):
                raise QueryError(f"{name}() takes a constant unit")
            return (T.time_bucket if name == "time_bucket" else T.date_trunc)(args[0].value, self._moment(args[1]))
        if name in T.ALLEN:
            need(2)
            return T.ALLEN[name](self._interval(args[0]), self._interval(args[1]))
        if name == "successive":
            need(2, 3)
            tolerance = 10**9
            if len(args) == 3:
                tolerance = T.parse_duration(args[2].value) if isinstance(args[2].value, str) else args[2].value
            return T.successive(self._interval(args[0]), self._interval(args[1]), tolerance)
        if name in ("changed", "change_type"):
            need(3)
            f = T.changed if name == "changed" else T.change_type
            return f(self._interval(args[0]), edge("created_at"), self._moment(args[1]), self._moment(args[2]))
        if name in ("duration", "open_ended"):
            need(1)
            return (T.duration if name == "duration" else T.open_ended)(self._interval(args[0]))
        if name in ("valid_from", "valid_until") and is_edge:
            return edge(name)
        if name in ("confidence_at", "weight_at") and is_edge:
            need(2)
            return T.value_at(edge(name.replace("_at", "_history")), self._moment(args[1]))
        if name in ("confidence_history", "weight_history") and is_edge:
            return edge(name)
        if name in ("created_at", "updated_at", "id") and (is_edge or is_node):
            return edge(name)
        if name == "type":
            need(1)
            return F.coalesce(edge("assoc_type"), edge("edge_kind")) if is_edge else edge("node_type")
        if name == "labels" and is_node:
            return edge("node_type")
        if name == "properties" and (is_edge or is_node):
            return edge("props")
        raise QueryError(f"unknown function {e.name}")
