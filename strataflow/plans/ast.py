"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """A scalar expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class NodeRef(Expr):
    """NODE(n): a literal reference to a node."""

    id: int


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    var: str
    name: str


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


class Bool:
    """A condition."""


@dataclass(frozen=True)
class Compare(Bool):
    op: str  # = != < > <= >= contains starts_with
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Bool):
    expr: Expr
    negated: bool = False


@dataclass(frozen=True)
class InList(Bool):
    expr: Expr
    values: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Between(Bool):
    expr: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Like(Bool):
    expr: Expr
    pattern: str


@dataclass(frozen=True)
class Predicate(Bool):
    call: Call


@dataclass(frozen=True)
class And(Bool):
    parts: tuple[Bool, ...]


@dataclass(frozen=True)
class Or(Bool):
    parts: tuple[Bool, ...]


@dataclass(frozen=True)
class Not(Bool):
    part: Bool


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class EdgePattern:
    var: str | None
    kind: str | None = None
    low: int | None = None  # variable length when high is set
    high: int | None = None
    props: tuple[tuple[str, Expr], ...] = ()
    incoming: bool = False


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    left: Expr
    right: Expr
    kind: str = "inner"


@dataclass(frozen=True)
class When:
    """Valid time: all, last (duration), point or range."""

    kind: str
    start: Expr | None = None
    end: Expr | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Query:
    patterns: tuple[Pattern, ...] = ()
    table: str | None = None
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    when: When | None = None
    as_of: Expr | None = None
    where: Bool | None = None
    group_by: tuple[Expr, ...] = ()
    having: Bool | None = None
    items: tuple[Item, ...] = ()
    order_by: tuple[tuple[Expr, bool], ...] = ()  # (expression, descending)
    limit: int | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False
    primary_key: bool = False
    unique: bool = False
    autoincrement: bool = False
    references_graph: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class AlterTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Bool


@dataclass(frozen=True)
class Delete:
    table: str
    where: Bool


@dataclass(frozen=True)
class Subscribe:
    query: Query


@dataclass(frozen=True)
class Unsubscribe:
    id: int


Statement = Query | CreateTable | DropTable | AlterTable | CreateIndex | Insert | Update | Delete | Subscribe | Unsubscribe
