import pytest

from strataflow.plans import ast as A
from strataflow.plans.lexer import QueryError, tokenize
from strataflow.plans.parser import parse


def test_tokens_strings_comments_and_quoted_names():
    t = tokenize('MATCH (a) // comment\n `x``y` "q\\"\\n" 1.5 <= ..')
    assert [(x.kind, x.text) for x in t][:5] == [("word", "MATCH"), ("symbol", "("), ("word", "a"), ("symbol", ")"), ("quoted", "x`y")]
    assert [x.text for x in t if x.kind == "string"] == ['q"\n']
    with pytest.raises(QueryError):
        tokenize("a ? b")


def test_keywords_remain_usable_as_names():
    q = parse("FROM `table` RETURN `table`.key, value, `from` AS x")
    assert [i.expr for i in q.items] == [A.Prop("table", "key"), A.Var("value"), A.Var("from")]


def test_pattern_with_variable_length_and_props():
    q = parse('MATCH (a:Person:Agent {name: "x", age: 3})-[r:knows*2..4]->(b)<-[:likes]-(c) WHEN ALL RETURN a')
    p = q.patterns[0]
    assert p.nodes[0] == A.NodePattern("a", ("Person", "Agent"), (("name", A.Literal("x")), ("age", A.Literal(3))))
    assert (p.edges[0].low, p.edges[0].high, p.edges[1].incoming) == (2, 4, True)
    assert parse("MATCH (a)-[*]->(b) RETURN b").patterns[0].edges[0].high == 10
    assert parse("MATCH (a)-[*..3]->(b) RETURN b").patterns[0].edges[0].high == 3


def test_boolean_precedence():
    q = parse("FROM t WHERE a = 1 OR b = 2 AND NOT c = 3 RETURN a")
    assert isinstance(q.where, A.Or) and isinstance(q.where.parts[1], A.And) and isinstance(q.where.parts[1].parts[1], A.Not)


def test_clause_order_is_fixed():
    with pytest.raises(QueryError):
        parse("FROM t RETURN a WHERE a = 1")


@pytest.mark.parametrize("text", ["", "FROM", "FROM t", "MATCH (a RETURN a", "FROM t WHERE RETURN a", "FROM t RETURN a LIMIT x", "FROM t RETURN a extra words here", "MATCH (a)-[*3..1]->(b) RETURN a", "CREATE VIEW v"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_depth_is_limited():
    with pytest.raises(QueryError):
        parse("FROM t WHERE " + "(" * 70 + "a = 1" + ")" * 70 + " RETURN a")


def test_negative_literals_and_dml():
    u = parse('UPDATE t SET a = -1, b = "x" WHERE id = 2')
    assert u.assignments == (("a", A.Literal(-1)), ("b", A.Literal("x")))
    i = parse("INSERT INTO t VALUES (1, NODE(7), NULL, true)")
    assert i.rows == ((A.Literal(1), A.NodeRef(7), A.Literal(None), A.Literal(True)),)
    c = parse('CREATE TABLE t (id Int64 PRIMARY KEY AUTOINCREMENT, n String NOT NULL DEFAULT "a", r NodeRef REFERENCES GRAPH, PRIMARY KEY (id), UNIQUE (n, r))')
    assert c.columns[0].primary_key and c.columns[1].default == A.Literal("a") and c.columns[2].references_graph and c.uniques == (("n", "r"),)
