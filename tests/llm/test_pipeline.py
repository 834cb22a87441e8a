"""The pipeline's stages, each on its own input, and the whole against them and brute force."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from strataflow.llm import langid, mixing, secrets
from tests.llm import util
from tests.llm.test_langid import WORDS
from tests.llm.test_mixing import fill
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(WORDS))
        t = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(12, 60)))
        if i % 20 == 3:
            t += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
        rows.append((i, t, lang, rng.choice("abc")))
    rows += [(200 + k, rows[k][1], rows[k][2], "a") for k in range(0, 30, 3)] + [(300, None, "en", "a"), (301, "### 123", "en", "b"), (302, "", None, None)]
    path = tmp_path_factory.mktemp("corpus")
    util.documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages_one_after_the_other(spark, table):
    path, rows = table
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "sentencepiece"]

    one = stage["language_id"](spark, docs, path).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}

    two = stage["near_duplicates"](spark, one, path).cache()
    kept = [(r.doc_id, r.text, r.lang, r.source) for r in one.collect()]
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {i for i, (_, c) in util.jaccard_components(kept).items() if i == c}

    three = stage["secret_scan"](spark, two, path).cache()
    before = {r.doc_id: r.text for r in two.collect()}
    assert three.columns == columns
    for r in three.collect():
        assert ("[SECRET]" in r.text) == bool(base(before[r.doc_id])) and not base(r.text) and r.n_chars == len(r.text)
        assert base(before[r.doc_id]) or r.text == before[r.doc_id]

    four = stage["source_mixing"](spark, three, path).cache()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in three.collect():
        sizes[r.source] += len(util.WORD.findall(r.text))
    for r in four.collect():
        taken[r.source] += len(util.WORD.findall(r.text))
    assert four.columns == columns and all(abs(taken[s] - g) <= 1 for s, g in fill(sizes).items())

    five = stage["sentencepiece"](spark, four, path)
    assert five.columns == [*columns, "ids"] and five.count() == four.count() and five.where("size(ids) = 0").count() == 0

    whole = corpus_pipeline.run(spark, path)
    key = lambda df: sorted((r.doc_id, r.text, tuple(r.ids)) for r in df.collect())
    assert key(whole) == key(five)
    for df in (one, two, three, four):
        df.unpersist()


def test_stages_call_the_operators(monkeypatch, spark, table):
    called = []
    for module, name in ((langid, "known_language"), (secrets, "redact_documents"), (mixing, "mix")):
        monkeypatch.setattr(module, name, lambda *a, _n=name, **k: called.append(_n) or a[0])
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    corpus_pipeline.language_id(spark, docs, table[0])
    corpus_pipeline.secret_scan(spark, docs, table[0])
    assert called == ["known_language", "redact_documents"]


def test_empty_table(spark, tmp_path):
    util.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_of_very_many_sizes(spark):
    """The stage reads its own written tables by set sizes, whose dictionary is larger than 8 KB."""
    found = corpus_pipeline.near_duplicates(spark, util.of_every_size(spark), "")
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(1100))
