import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strataflow.llm import sharding
from tests.llm import util

M = (1 << 64) - 1


def jump(key, shards):
    key &= M
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & M
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1] + [i * 987654321987 for i in range(-60, 60)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 100):
        assert {r.k: r.s for r in df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect()} == {k: jump(k, shards) for k in keys}


def test_rows_slots_and_growth(spark):
    rows = util.edge_rows() + [(7, util.BASE, "en", "a"), (7, "other", "en", "a"), (None, None, None, None)]
    got = sharding.assign_shards(util.documents(spark, rows, extra=True), 8, chunks=4).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    for r in got:
        slots[r.shard].append(r.slot)
        key = r.doc_id or 0
        assert r.shard == jump(key, 8) and r.grown_shard == jump(key, 9) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        assert (r.size, r.text_crc32) in [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts[r.doc_id]]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(spark):
    assert sharding.assign_shards(util.documents(spark, []), 8).collect() == []
