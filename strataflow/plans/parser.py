"""Recursive-descent parser of the query language."""

from __future__ import annotations

from strataflow.plans import ast as A
from strataflow.plans.lexer import QueryError, Token, tokenize

MAX_DEPTH = 64
DEFAULT_HOPS = 10
_CLAUSES = frozenset("join left inner when as where group having return order limit on match from".split())


def parse(text: str) -> A.Statement:
    return _Parser(tokenize(text)).statement()


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i, self.depth = tokens, 0, 0

    # ---- helpers

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted} at {self.now.at}, found {self.now.text or 'the end'!r}")

    def is_word(self, *words: str, n: int = 0) -> bool:
        t = self.ahead(n) if n else self.now
        return t.kind == "word" and t.text.lower() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            self.i += 1
            return self.tokens[self.i - 1].text.lower()
        return None

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word.upper())

    def is_symbol(self, s: str, n: int = 0) -> bool:
        t = self.ahead(n) if n else self.now
        return t.kind == "symbol" and t.text == s

    def symbol(self, s: str) -> bool:
        if self.is_symbol(s):
            self.i += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.symbol(s):
            self.fail(repr(s))

    def name(self) -> str:
        if self.now.kind in ("word", "quoted"):
            self.i += 1
            return self.tokens[self.i - 1].text
        self.fail("a name")

    def integer(self) -> int:
        if self.now.kind != "int":
            self.fail("an integer")
        self.i += 1
        return int(self.tokens[self.i - 1].text)

    def listed(self, one, opening: str | None = None, closing: str | None = None) -> tuple:
        if opening:
            self.need(opening)
        out = [one()]
        while self.symbol(","):
            out.append(one())
        if closing:
            self.need(closing)
        return tuple(out)

    # ---- statements

    def statement(self) -> A.Statement:
        s = self._statement()
        self.symbol(";")
        if self.now.kind != "end":
            self.fail("the end")
        return s

    def _statement(self) -> A.Statement:
        if self.word("subscribe"):
            return A.Subscribe(self.query())
        if self.word("unsubscribe"):
            return A.Unsubscribe(self.integer())
        if self.word("create"):
            unique = bool(self.word("unique"))
            if self.word("index"):
                name = self.name()
                self.need_word("on")
                table = self.name()
                return A.CreateIndex(name, table, self.listed(self.name, "(", ")"), unique)
            self.need_word("table")
            return self.create_table()
        if self.word("drop"):
            self.need_word("table")
            return A.DropTable(self.name())
        if self.word("alter"):
            self.need_word("table")
            table = self.name()
            return A.AlterTable(table, self.listed(self.added_column))
        if self.word("insert"):
            self.need_word("into")
            table = self.name()
            columns = self.listed(self.name, "(", ")") if self.is_symbol("(") else ()
            self.need_word("values")
            return A.Insert(table, columns, self.listed(lambda: self.listed(self.literal, "(", ")")))
        if self.word("update"):
            table = self.name()
            self.need_word("set")
            assignments = self.listed(self.assignment)
            self.need_word("where")
            return A.Update(table, assignments, self.condition())
        if self.word("delete"):
            self.need_word("from")
            table = self.name()
            self.need_word("where")
            return A.Delete(table, self.condition())
        return self.query()

    def assignment(self) -> tuple[str, A.Expr]:
        column = self.name()
        self.need("=")
        return column, self.expr()

    def added_column(self) -> A.ColumnDef:
        self.need_word("add")
        self.word("column")
        return self.column()

    def column(self) -> A.ColumnDef:
        name, kind = self.name(), self.name()
        options: dict = {}
        while True:
            if self.word("not"):
                self.need_word("null")
                options["not_null"] = True
            elif self.word("primary"):
                self.need_word("key")
                options["primary_key"] = True
            elif self.word("unique"):
                options["unique"] = True
            elif self.word("default"):
                options["default"] = self.literal()
            elif self.word("autoincrement"):
                options["autoincrement"] = True
            elif self.word("references"):
                self.need_word("graph")
                options["references_graph"] = True
            else:
                return A.ColumnDef(name, kind, **options)

    def create_table(self) -> A.CreateTable:
        table, columns, key, uniques = self.name(), [], (), []
        self.need("(")
        while True:
            if self.is_word("primary") and self.is_word("key", n=1):
                self.i += 2
                key = self.listed(self.name, "(", ")")
            elif self.is_word("unique") and self.is_symbol("(", 1):
                self.i += 1
                uniques.append(self.listed(self.name, "(", ")"))
            else:
                columns.append(self.column())
            if not self.symbol(","):
                break
        self.need(")")
        return A.CreateTable(table, tuple(columns), key, tuple(uniques))

    # ---- queries

    def query(self) -> A.Query:
        q: dict = {}
        if self.word("match"):
            q["patterns"] = self.listed(self.pattern)
        elif self.word("from"):
            q["table"] = self.name()
            q["alias"] = self.table_alias(q["table"])
        else:
            self.fail("MATCH or FROM")
        joins = []
        while self.is_word("join", "left", "inner"):
            joins.append(self.join())
        q["joins"] = tuple(joins)
        if self.word("when"):
            q["when"] = self.when()
        if self.is_word("as") and self.is_word("of", n=1):
            self.i += 2
            q["as_of"] = self.expr()
        if self.word("where"):
            q["where"] = self.condition()
        if self.word("group"):
            self.need_word("by")
            q["group_by"] = self.listed(self.expr)
        if self.word("having"):
            q["having"] = self.condition()
        self.need_word("return")
        q["items"] = self.listed(self.item)
        if self.word("order"):
            self.need_word("by")
            q["order_by"] = self.listed(self.order)
        if self.word("limit"):
            q["limit"] = self.integer()
        return A.Query(**q)

    def table_alias(self, table: str) -> str:
        if self.is_word("as") and not self.is_word("of", n=1):
            self.i += 1
            return self.name()
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.text.lower() not in _CLAUSES:
            return self.name()
        return table

    def join(self) -> A.Join:
        kind = self.word("left", "inner") or "inner"
        self.word("join")
        table = self.name()
        alias = self.table_alias(table)
        self.need_word("on")
        left = self.expr()
        self.need("=")
        return A.Join(table, alias, left, self.expr(), kind)

    def when(self) -> A.When:
        if self.is_word("all"):
            self.i += 1
            return A.When("all")
        if self.is_word("last"):
            self.i += 1
            return A.When("last", self.expr())
        start = self.expr()
        if self.word("to"):
            return A.When("range", start, self.expr())
        return A.When("point", start)

    def item(self) -> A.Item:
        distinct = bool(self.word("distinct"))
        e = self.expr()
        alias = self.name() if self.word("as") else None
        return A.Item(e, alias, distinct)

    def order(self) -> tuple[A.Expr, bool]:
        e = self.expr()
        return e, (self.word("asc", "desc") or "asc") == "desc"

    def pattern(self) -> A.Pattern:
        nodes, edges = [self.node()], []
        while self.is_symbol("-") or self.is_symbol("<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        return A.Pattern(tuple(nodes), tuple(edges))

    def props(self) -> tuple[tuple[str, A.Expr], ...]:
        if not self.symbol("{"):
            return ()
        out = []
        while not self.is_symbol("}"):
            key = self.name()
            self.need(":")
            out.append((key, self.literal()))
            if not self.symbol(","):
                break
        self.need("}")
        return tuple(out)

    def node(self) -> A.NodePattern:
        self.need("(")
        var = self.name() if self.now.kind in ("word", "quoted") else None
        labels = []
        while self.symbol(":"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return A.NodePattern(var, tuple(labels), props)

    def edge(self) -> A.EdgePattern:
        incoming = self.symbol("<-")
        if not incoming:
            self.need("-")
        self.need("[")
        var = self.name() if self.now.kind in ("word", "quoted") else None
        kind = self.name() if self.symbol(":") else None
        low = high = None
        if self.symbol("*"):
            low, high = 1, DEFAULT_HOPS
            if self.now.kind == "int":
                low = high = self.integer()
                if self.symbol(".."):
                    high = self.integer() if self.now.kind == "int" else DEFAULT_HOPS
            elif self.symbol(".."):
                high = self.integer()
            if low > high:
                raise QueryError(f"no path has {low} to {high} steps")
        props = self.props()
        self.need("]")
        if incoming:
            self.need("-")
        else:
            self.need("->")
        return A.EdgePattern(var, kind, low, high, props, incoming)

    # ---- conditions

    def condition(self) -> A.Bool:
        parts = [self.conjunction()]
        while self.word("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else A.Or(tuple(parts))

    def conjunction(self) -> A.Bool:
        parts = [self.negation()]
        while self.word("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else A.And(tuple(parts))

    def negation(self) -> A.Bool:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError(f"conditions are nested deeper than {MAX_DEPTH}")
        try:
            if self.word("not"):
                return A.Not(self.negation())
            if self.symbol("("):
                inner = self.condition()
                self.need(")")
                return inner
            return self.comparison()
        finally:
            self.depth -= 1

    def comparison(self) -> A.Bool:
        left = self.expr()
        if self.word("is"):
            negated = bool(self.word("not"))
            self.need_word("null")
            return A.IsNull(left, negated)
        if self.is_word("not") and self.is_word("in", n=1):
            self.i += 2
            return A.InList(left, self.values(), True)
        if self.word("in"):
            return A.InList(left, self.values())
        if self.word("between"):
            low = self.expr()
            self.need_word("and")
            return A.Between(left, low, self.expr())
        if self.word("like"):
            if self.now.kind != "string":
                self.fail("a string")
            self.i += 1
            return A.Like(left, self.tokens[self.i - 1].text)
        if self.word("contains"):
            return A.Compare("contains", left, self.expr())
        if self.is_word("starts") and self.is_word("with", n=1):
            self.i += 2
            return A.Compare("starts_with", left, self.expr())
        for op in ("=", "!=", "<>", "<=", ">=", "<", ">"):
            if self.symbol(op):
                return A.Compare("!=" if op == "<>" else op, left, self.expr())
        if isinstance(left, A.Call):
            return A.Predicate(left)
        self.fail("a comparison")

    def values(self) -> tuple[A.Expr, ...]:
        self.need("(")
        if self.symbol(")"):
            return ()
        out = self.listed(self.literal)
        self.need(")")
        return out

    # ---- expressions

    def literal(self) -> A.Expr:
        if self.is_word("node") and self.is_symbol("(", 1):
            self.i += 2
            n = self.integer()
            self.need(")")
            return A.NodeRef(n)
        e = self.expr()
        if not isinstance(e, A.Literal):
            self.fail("a literal")
        return e

    def expr(self) -> A.Expr:
        t = self.now
        if t.kind == "symbol" and t.text == "-" and self.ahead().kind in ("int", "float"):
            self.i += 1
            return A.Literal(-self.expr().value)
        if t.kind == "symbol" and t.text == "*":
            self.i += 1
            return A.Star()
        if t.kind == "string":
            self.i += 1
            return A.Literal(t.text)
        if t.kind in ("int", "float"):
            self.i += 1
            return A.Literal(int(t.text) if t.kind == "int" else float(t.text))
        if t.kind == "word" and t.text.lower() in ("true", "false", "null") and not self.is_symbol(".", 1):
            self.i += 1
            return A.Literal({"true": True, "false": False, "null": None}[t.text.lower()])
        name = self.name()
        if self.is_symbol("(") and t.kind == "word":
            self.i += 1
            distinct = bool(self.word("distinct"))
            args = () if self.is_symbol(")") else self.listed(self.expr)
            self.need(")")
            return A.Call(name, args, distinct)
        if self.symbol("."):
            return A.Prop(name, self.name())
        return A.Var(name)
