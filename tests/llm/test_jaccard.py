import random
from itertools import combinations
from math import comb

import numpy as np
import pyarrow.parquet as pq
import pytest

from strataflow import shared
from strataflow.llm import bitmap, jaccard
from tests.llm import util


def check(spark, rows, **settings):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(util.documents(spark, rows, extra=True)).collect()}
    assert found == util.jaccard_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    check(spark, util.edge_rows(seed, 120))


def test_small_sets_by_subsets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 16))), "en", "a") for i in range(150)]
    check(spark, rows)


@pytest.mark.parametrize("lists", [2, 7])
def test_salted_lists(spark, monkeypatch, lists):
    import pyspark.cloudpickle as pickle

    pickle.register_pickle_by_value(jaccard)
    monkeypatch.setattr(jaccard, "LIST", lists)
    monkeypatch.setattr(jaccard, "MOST_LIGHT", 3)
    try:
        check(spark, util.edge_rows(9, 100))
    finally:
        pickle.unregister_pickle_by_value(jaccard)


def test_chain_of_links_without_a_common_hub(spark):
    """Neighbours in the chain link, the ends do not."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100]), "en", "a") for i in range(20)]
    check(spark, rows)
    assert len({c for _, c in util.jaccard_components(rows).values()}) == 1


def test_empty_table_and_repeated_ids(spark):
    assert jaccard.jaccard_components(util.documents(spark, [])).collect() == []
    rows = [(1, util.BASE, "en", "a"), (1, util.BASE, "en", "a"), (2, util.BASE, "en", "a"), (None, util.BASE, "en", "a")]
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(util.documents(spark, rows)).collect())
    assert found == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_keep_first_keeps_one_of_each_group(spark):
    rows = util.edge_rows(4, 80)
    kept = sorted(r.doc_id for r in jaccard.keep_first(util.documents(spark, rows)).collect())
    assert kept == sorted(i for i, (_, c) in util.jaccard_components(rows).items() if i == c)


def test_overlap_bounds():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next((i for i in range(0, min(n, m) + 1) if 100 * i >= 80 * (n + m - i)), None)
            assert (least is None) == (jaccard.needed(n, m) > min(n, m))
            if least is not None:
                assert jaccard.needed(n, m) == least
                assert jaccard.prefix_length(n) + least > n


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({2: 1000, 3: 1000}) >= 3
    assert all(comb(n, jaccard.needed(n, m)) > 0 for n in range(1, 13) for m in jaccard.partners(n, 12))


def test_bitmap_has_no_false_negatives(spark):
    ids = [0, 1, -1, -5, 2**40, 2**62, -(2**62)] + list(range(1000, 3000, 7))
    bits = bitmap.build(spark.createDataFrame([(i,) for i in ids], "doc long"), "doc")
    assert bitmap.contains(bits, np.array(ids)).all()
    assert bitmap.contains(bits, np.arange(10**6, 10**6 + 5000)).mean() < 0.1


def test_sets_of_very_many_sizes(spark):
    """Comparisons with sizes are pushed down to a written table, whose dictionary of sizes is larger than 8 KB."""
    found = {tuple(r) for r in jaccard.jaccard_components(util.of_every_size(spark)).select("doc_id", "n_shingles", "component_id").collect()}
    assert found == {(i, i % 1100 + 1, i % 1100) for i in range(2200)}


def test_reads_and_writes_in_small_pieces(spark):
    """On a heap of 1 GB, eight tasks' batches of 4,096 long texts ended the job, beside writers' row groups of 128 MB."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    check(spark, util.edge_rows(n=20))
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    wide = shared.cut(spark.range(0, 6_000_000, 1, 1).selectExpr("xxhash64(id) as x"), "wide")  # 48 MB in one task
    parts = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in wide.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in parts for i in range(m.num_row_groups)]
    assert sum(groups) > 40 << 20 and max(groups) <= 20 << 20
    assert wide.count() == 6_000_000


def test_a_bitmap_of_few_ids_lets_few_others_through(spark):
    bits = bitmap.build(spark.range(0, 10**6, 1000), "id")
    others = np.setdiff1d(np.arange(10**6), np.arange(0, 10**6, 1000))
    assert bitmap.contains(bits, others).mean() < 0.002 and bits.nbytes <= 1 << 18


def test_long_lists_are_joined_again_without_copies(spark, monkeypatch):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(1000)) for _ in range(20)) for _ in range(6)]
    texts = [" ".join(passages[j] for j in three) for three in combinations(range(6), 3)]
    rows = [(i, texts[i % len(texts)], "en", "a") for i in range(5 * len(texts))]
    given = []

    def noted(docs, members, known, long):
        given.extend(r.doc for r in members.collect())
        return again(docs, members, known, long)

    again = jaccard._again
    monkeypatch.setattr(jaccard, "_again", noted)
    monkeypatch.setattr(jaccard, "SHORT", 1)
    check(spark, rows)
    assert len(given) > 10 and len({rows[i][1] for i in given}) == len(given)
