"""Interval algebra, views, histories and temporal joins against plain Python."""

import random
from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.functions import temporal as T
from strataflow.operators import temporal as O

FAR = (1 << 63) - 1
RULES = {
    "precedes": lambda a, b, c, d: b <= c, "meets": lambda a, b, c, d: b == c, "covers": lambda a, b, c, d: a <= c and b >= d, "starts": lambda a, b, c, d: a == c and b <= d,
    "finishes": lambda a, b, c, d: b == d and a >= c, "equals": lambda a, b, c, d: (a, b) == (c, d), "overlap": lambda a, b, c, d: a < d and c < b,
}


def test_interval_relations_on_all_small_intervals(spark):
    ends = [None, 0, 1, 2, 3]
    intervals = [(s, e) for s, e in product(ends, ends) if s is None or e is None or s < e]
    rows = [(i, *x, *y) for i, (x, y) in enumerate(product(intervals, intervals))]
    df = spark.createDataFrame(rows, "i int, a long, b long, c long, d long")
    one, two = T.Interval(F.col("a"), F.col("b")), T.Interval(F.col("c"), F.col("d"))
    out = df.select("i", "a", "b", "c", "d", *(f(one, two).alias(n) for n, f in T.ALLEN.items())).collect()
    for r in out:
        a, b, c, d = r.a or 0, FAR if r.b is None else r.b, r.c or 0, FAR if r.d is None else r.d
        for n, rule in RULES.items():
            assert r[n] == rule(a, b, c, d), (n, r)


@given(st.integers(1, 10**6), st.sampled_from(["ns", "us", "ms", "s", "m", "min", "h", "d", "w", "y"]))
def test_durations(n, unit):
    assert T.parse_duration(f"{n}{unit}") == n * T.NANOS[unit]


@pytest.mark.parametrize(
    "text, seconds", [("2024-01", 1704067200), ("2024-01-10", 1704844800), ("2024-01-10T01:02:03", 1704848523), ("2024-01-10T01:02:03Z", 1704848523), ("1704844800000", 1704844800)]
)
def test_times(text, seconds):
    assert T.parse_time(text) == seconds * 10**9


def test_times_compat_and_errors():
    assert T.parse_time("2024-01-10T01:02:30Z", compat=True) == (1704844800 + 3720) * 10**9
    for bad in ("tomorrow", "2024-13-45x", "5 parsecs"):
        with pytest.raises(ValueError):
            T.parse_time(bad)
    with pytest.raises(ValueError):
        T.parse_duration("5 parsecs")


def test_buckets_and_truncation(spark):
    t = (1704848523 * 10**9) + 5  # Wednesday 2024-01-10 01:02:03
    df = spark.createDataFrame([(t,)], "t long")
    got = df.select(T.time_bucket("1w", F.col("t")), T.time_bucket("week", F.col("t")), T.time_bucket("1h", F.col("t")), T.date_trunc("quarter", F.col("t")), T.date_trunc("second", F.col("t"))).first()
    week = 7 * 86400 * 10**9
    assert tuple(got) == (t - t % week, 1704672000 * 10**9, 1704848400 * 10**9, 1704067200 * 10**9, 1704848523 * 10**9)


def test_successive_changed_and_duration(spark):
    df = spark.createDataFrame([(1, 10, 12, 20), (1, 10, 14, 20), (None, None, 12, 20)], "a long, b long, c long, d long")
    i, j = T.Interval(F.col("a"), F.col("b")), T.Interval(F.col("c"), F.col("d"))
    got = df.select(T.successive(i, j, 2), T.changed(i, F.lit(7), F.lit(6), F.lit(8)), T.duration(i), T.change_type(i, F.lit(0), F.lit(0), F.lit(11))).collect()
    assert [tuple(r) for r in got] == [(True, True, 9, "started_and_ended"), (False, True, 9, "started_and_ended"), (False, True, None, "created")]


def test_histories(spark):
    df = spark.createDataFrame([([(1, 0.1), (5, 0.5), (9, 0.9)],), (None,)], "h array<struct<t:bigint,v:double>>")
    h = F.col("h")
    got = df.select(T.value_at(h, F.lit(6)), T.value_at(h, F.lit(0)), F.size(T.history_window(h, F.lit(5), F.lit(9))), T.compact_history(h, F.lit(6))).first()
    assert (got[0], got[1], got[2], [tuple(x) for x in got[3]]) == (0.5, None, 2, [(5, 0.5), (9, 0.9)])


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(4)
    make = lambda: [(i, s := rng.randrange(100), None if rng.random() < 0.1 else s + rng.randrange(1, 30)) for i in range(60)]
    left, right = make(), make()
    a = spark.createDataFrame(left, "a long, s1 long, e1 long")
    b = spark.createDataFrame(right, "b long, s2 long, e2 long")
    found = sorted((r.a, r.b) for r in O.interval_join(a, b, ("s1", "e1"), ("s2", "e2"), 7, horizon=1000).collect())
    expected = sorted((x, y) for x, s, e in left for y, t, u in right if s < (u or 1000) and t < (e or 1000))
    assert found == expected


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "c", 9)], "i int, k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), ("b", 8, None), ("b", 1, "w")], "k string, u long, v string")
    got = {r.i: (r.u, r.v) for r in O.asof_join(left, right, ["k"], "t", "u", ["u", "v"]).collect()}
    assert got == {1: (5, "y"), 2: (None, None), 3: (8, None), 4: (None, None)}


def test_row_views_and_newest(spark):
    rows = [(1, 1, 0, 0, 10, 0), (1, 2, 0, 10, None, 10), (1, 3, 0, 5, None, 20)]
    df = spark.createDataFrame(rows, "_row_id long, _version_id long, _group_id long, _valid_from long, _valid_until long, _created_at long")
    ids = lambda *a, **k: sorted(r._version_id for r in O.row_viewport(df, *a, **k).collect())
    assert ids("active") == [2, 3] and ids("active", newest=True) == [2] and ids("point", 7) == [1, 3] and ids("range", 10, 10) == [1, 2, 3] and ids("all", as_of=10) == [1, 2]
    with pytest.raises(ValueError):
        O.row_viewport(df, "sometimes")
