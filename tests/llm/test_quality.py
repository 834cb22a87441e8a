import random
from collections import Counter

import pytest

from strataflow.llm import quality
from tests.llm import util


def counts(text):
    text = text or ""
    w = util.WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if util.WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = util.edge_rows(8, 70) + [(1000 + i, "".join(rng.choice("ab \n\t#|é") for _ in range(rng.randint(0, 400))), "en", "a") for i in range(60)]
    texts = {i: t for i, t, *_ in rows}
    got = quality.judge(util.documents(spark, rows, extra=True), None).collect()
    assert len(got) == len(rows)
    for r in got:
        n = counts(texts[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert r.base_failed == failed and r.kept == (not failed)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    good, bad = util.BASE.split(), "buy $$$ now!!! click ### free *** win &&& cash %%% deal".split()
    rows, labels = [], []
    for i in range(600):
        ok = i % 3 != 0
        rows.append((i, " ".join(rng.choice(good if ok or rng.random() < 0.3 else bad) for _ in range(40)), "en", "a"))
        if i < 400:
            labels.append((i, int(ok)))
    return util.documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 0)], "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark, labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    rest = [got[i] for i in range(400, 600) if not got[i].base_failed]
    assert sum(r.kept == (r.doc_id % 3 != 0) for r in rest) >= 0.95 * len(rest)
    assert abs(sum(r.quality_score for r in rest) / len(rest) - 2 / 3) < 0.15


def test_training_repeats_and_is_bounded(spark, labelled):
    docs, labels = labelled
    a, b = quality.train(docs, labels), quality.train(docs.repartition(5), labels.repartition(3))
    assert abs(a["w"] - b["w"]).max() < 1e-9
    assert quality.train(docs, labels, rows=10) is None


def test_score_of_a_batch_equals_that_of_single_texts(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    texts = [t.text.encode() for t in docs.limit(9).collect()] + [b"", b"a", b"abcd", b"abcde"]
    table, parts = quality.rule_counts(texts)
    together = quality.score(model, texts, parts)
    for t, p in zip(texts, together):
        _, one = quality.rule_counts([t])
        assert abs(quality.score(model, [t], one)[0] - p) < 1e-9


def test_no_labels_and_empty_tables(spark, labelled):
    docs, labels = labelled
    assert all(r.kept == (not r.base_failed) for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(util.documents(spark, []), labels).collect() == []
