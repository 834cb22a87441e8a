import hashlib
import random

import numpy as np
import pytest

from strataflow.llm import suffixes
from tests.llm import util


def brute(rows):
    """By a set of all strings seen so far, in order of doc_id."""
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def check(spark, rows):
    got = suffixes.dedup(util.documents(spark, rows, extra=True)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows) and len(got) == len(rows)


def tricky(seed, n=120):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcde \n") for _ in range(600))
    rows = []
    for i in range(n):
        k = rng.randint(0, 8)
        if k == 0:
            t = rng.choice([None, "", "short"])
        elif k == 1:
            t = "a" * rng.randint(0, 400)
        elif k < 5:
            t = base[rng.randint(0, 300) : rng.randint(301, 600)]
        elif k < 7:
            t = "".join(rng.choice("xy") for _ in range(rng.randint(1, 30))) * rng.randint(1, 20)
        else:
            t = base[: rng.randint(90, 300)] + "\0" * rng.randint(0, 200) + "é" * rng.randint(1, 90)
        rows.append((i, t, "en", "a"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    check(spark, tricky(seed))
    check(spark, util.edge_rows(seed, 60))


@pytest.mark.parametrize("lists, shard", [(5, 1 << 20), (5, 3000), (4096, 2000)])
def test_split_groups_and_small_shards(spark, monkeypatch, lists, shard):
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(suffixes)
    monkeypatch.setattr(suffixes, "LIST", lists)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    try:
        check(spark, tricky(3))
    finally:
        pickle.unregister_pickle_by_value(suffixes)


def test_exactly_one_hundred_bytes(spark):
    s = "".join(chr(97 + i % 26) for i in range(100))
    check(spark, [(1, s, "en", "a"), (2, s, "en", "a"), (3, s[:99], "en", "a"), (4, "zz" + s + "yy", "en", "a"), (5, s[:99] + "!", "en", "a")])


def test_repeated_rows_null_ids_and_empty_table(spark):
    s = util.BASE
    got = suffixes.dedup(util.documents(spark, [(1, s, "en", "a"), (1, s, "en", "a"), (2, s, "en", "a"), (None, "q" + s, "en", "a")])).collect()
    n = len(s)
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, n), (1, n), (2, n)]
    assert suffixes.dedup(util.documents(spark, [])).collect() == []


@pytest.mark.parametrize("batch", ["1", "2000"])
def test_copies_read_in_descending_order(spark, batch):
    """One task reads the later copies of a text first; the earliest must still lose and own passages."""
    rng = random.Random(7)
    a, p, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(5))
    text = a + p + b
    rows = [(i, t, "en", "a") for i, t in [(60, text), (50, text), (30, c + p + d), (20, text), (10, text), (5, a[:150] + c[:120])]]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        one = spark.createDataFrame([(*r, len(r[1])) for r in rows], util.SCHEMA).coalesce(1)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(one).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == brute(rows) and got[10][1] == 150 and got[30][1] > 200


@pytest.mark.parametrize("tasks", [1, 3])
def test_repeated_row_owns_its_passage(spark, tasks):
    rng = random.Random(8)
    a, p, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(5))
    first, second = (1, a + p + b + a[:150], "en", "a"), (2, c + p + d, "en", "a")
    for n in (2, 5):  # in both orders, in one task and in several
        rows = [first, second, *[first] * (n - 1)]
        df = spark.createDataFrame([(*r, len(r[1])) for r in rows], util.SCHEMA)
        df = df.coalesce(1) if tasks == 1 else df.repartition(tasks)
        got = suffixes.dedup(df).collect()
        assert len(got) == n + 1 and {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(i, *x) for i, x in brute([first, second]).items()}


def test_repeated_rows_in_split_groups():
    """The same segment of the same owner twice in one shard, or once in each of two, is one start."""
    segment = bytes(97 + i % 26 for i in range(120))
    item = (5, 0, 1, 9, 0, 21, segment)
    assert list(suffixes._shard([item, item])) == []
    assert list(suffixes._merge([[item], [item]])) == []


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        segments = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        codes = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        order = suffixes.suffix_array(codes, left)
        suffix = [bytes(codes[i : i + left[i]]) for i in range(len(codes))]
        expected = sorted(range(len(codes)), key=lambda i: (suffix[i], i))
        assert order.tolist() == expected

        def common(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        assert suffixes.common_prefixes(codes, left, order).tolist() == [0] + [common(suffix[a], suffix[b]) for a, b in zip(expected, expected[1:])]


def test_merging_by_binary_search():
    merged = suffixes.Merged()
    key = lambda *s: np.array([x.encode().ljust(100, b"-") + b"\1" for x in s], dtype="S101")
    assert len(merged.add(key("a", "c"), np.array([[5, 0, 1], [5, 0, 2]]))) == 0
    later = merged.add(key("b", "c"), np.array([[4, 0, 9], [3, 0, 7]]))
    assert later.tolist() == [[5, 0, 2]] and [k[:1] for k in merged.keys.tolist()] == [b"a", b"b", b"c"]


def test_texts_of_very_many_lengths(spark):
    """Comparisons with lengths are pushed down to a written table, whose dictionary of lengths is larger than 8 KB."""
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(1200))
    rows = [(i, text[: i % 1100 + 100], "en", "a") for i in range(2200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    got = suffixes.dedup(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows) and len(got) == len(rows)


def test_texts_are_read_in_small_batches(spark):
    """On a heap of 1 GB, eight tasks' batches of 4,096 long texts ended the job."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    rows = [(1, "x" * 200, "en", "a"), (2, "x" * 200, "en", "a")]
    got = suffixes.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_row_groups_are_read_in_small_pieces(spark):
    """A row group's texts in one array of 12 to 20 MB found no free heap in a row on a heap of 1 GB, and ended the job."""
    keys = ("parquet.read.allocation.size", "parquet.hadoop.vectored.io.enabled", "spark.sql.columnVector.offheap.enabled")
    for key in keys:
        spark.conf.unset(key)
    rows = [(1, "x" * 200, "en", "a"), (2, "x" * 200, "en", "a")]
    got = suffixes.dedup(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows)
    reader = spark._jsparkSession.sessionState().newHadoopConf()  # what the Parquet reader gets
    pieces, vectored, beside = (reader.get(key) for key in keys)
    assert pieces is not None and int(pieces) <= 1 << 18 and vectored == "false" and beside == "true"
