from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataflow.llm import mixing
from tests.llm import util


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    goal, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            goal[s] += give[s]
            if goal[s] >= cap * sizes[s]:
                left += goal[s] - cap * sizes[s]
                goal[s] = cap * sizes[s]
                open_.discard(s)
    return goal


def words(t):
    return len(util.WORD.findall(t or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = util.edge_rows(seed, 90)
    docs = util.documents(spark, rows, extra=True)
    got = mixing.mix(mixing.sized(docs), cells=2).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    goal = fill(sizes)
    taken = defaultdict(int)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        assert r.size == words(texts[r.doc_id]) and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix(mixing.sized(docs.repartition(7)), cells=2).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_epochs_come_first(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(10)] + [(100 + i, "w " * 100, "en", "c") for i in range(10)]
    got = mixing.mix(mixing.sized(util.documents(spark, rows))).collect()
    for s in ("a", "c"):
        full = {r.taken // r.size for r in got if r.source == s}
        assert max(full) - min(full) <= 1


def test_quality_draws_documents_earlier(spark):
    rows = [(i, ("good words here " * 5) if i % 2 else ("#$%& " * 15), "en", "a") for i in range(400)] + [(1000, "w " * 1000, "en", "b")]
    got = [r for r in mixing.mix(mixing.sized(util.documents(spark, rows)), weights=(1, 3), share=0.6).collect() if r.source == "a"]
    share = lambda odd: sum(r.taken for r in got if r.doc_id % 2 == odd) / sum(r.size for r in got if r.doc_id % 2 == odd)
    assert share(1) > share(0)


def test_applying_the_mix(spark):
    rows = util.edge_rows(3, 60)
    docs = util.documents(spark, rows)
    taken = mixing.mix(mixing.sized(docs)).select("doc_id", "size", "taken")
    out = mixing.apply_cuts(docs, mixing.cuts(mixing.sized(docs)))
    assert out.columns == docs.columns
    plan = {r.doc_id: r.taken for r in taken.collect()}
    have = defaultdict(int)
    texts = {i: t for i, t, *_ in rows}
    for r in out.collect():
        have[r.doc_id] += words(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert dict(have) == {k: v for k, v in plan.items() if v}


def in_python(rows, keys, weights=(5, 2, 1), share=1.5, cap=2.0):
    """taken of every row, by sorting each whole source; rows are (doc_id, text, lang, source), keys by doc_id and text."""
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    out = []
    for source, goal in fill(sizes, weights, share, cap).items():
        mine = sorted((keys[i, t], i is not None, i or 0, words(t), i, t) for i, t, _, s in rows if s == source)
        epochs = int(goal // sizes[source]) if sizes[source] else 0
        left = round(goal - epochs * sizes[source])
        for *_, size, i, _ in mine:
            part = max(0, min(size, left))
            left -= size
            out.append((i, source, epochs * size + part))
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [None, 1, 64])
def test_every_document_equals_brute_force(spark, cells):
    rows = util.edge_rows(6, 120) + [(9000, "same words again", "en", "b")] * 40 + [(9001, "# $ % & " * 10, "en", "c")] * 3 + [(None, "no id here", "en", "a")]
    docs = util.documents(spark, rows, extra=True)
    sized = mixing.sized(docs)
    keyed = docs.select("doc_id", "text", mixing._key(F.col("doc_id"), mixing.quality_weight(F.col("text")), mixing.SEED).alias("k")).collect()
    got = mixing.mix(sized, cells=cells).collect()
    assert sorted(((r.doc_id, r.source, r.taken) for r in got), key=str) == in_python(rows, {(r.doc_id, r.text): r.k for r in keyed})


def test_ranges_stay_even_at_any_weight(spark):
    for weight in (1.0, 0.05):
        log = F.floor(F.log(mixing._key(F.col("id"), F.lit(weight), 1)) * 64)
        assert spark.range(50_000).groupBy(log.alias("b")).count().agg(F.max("count")).first()[0] < 50_000 * 0.01


@pytest.mark.parametrize("copies,share", [(6, 0.2), (50, 0.31), (7, 0.9)])
def test_repeated_rows_at_the_cut(spark, copies, share):
    """Equal rows are taken up to the budget, some whole and one in part, also when they lie in several files."""
    rows = [(5, "ten words make up this text that repeats itself here", "en", "a")] * copies + [(6, "x y z", "en", "b")]
    docs = util.documents(spark, rows).repartition(4)
    plan = sum(r.taken for r in mixing.mix(mixing.sized(docs), share=share).collect() if r.source == "a")
    out = mixing.apply_cuts(docs, mixing.cuts(mixing.sized(docs), share=share))
    assert sum(words(r.text) for r in out.collect() if r.source == "a") == plan


def test_empty_and_wordless(spark):
    assert mixing.mix(mixing.sized(util.documents(spark, []))).collect() == []
    got = mixing.mix(mixing.sized(util.documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)]))).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_word_count_and_prefix(spark):
    texts = [None, "", " ", "a", " a  b\n", "\x0ba\x0cb c d", "é 😀"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", mixing.word_count(F.col("t")).alias("n")).orderBy("i").collect()] == [words(t) for t in texts]
    assert df.where("i = 4").select(mixing.first_words(F.col("t"), F.lit(1))).first()[0] == " a"
