import random
import zlib

import numpy as np

from strataflow.llm import langid
from tests.llm import util

WORDS = {"en": "the and of that with this house water river people never there".split(), "de": "der und die das mit ich nicht wasser haus für über schön".split(), "es": "el la de que y los agua niño casa pero muy mañana".split()}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang, "a") for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def phrases(sample, symbols):
    """Greedy cross-parsing by substring search, segment by segment."""
    count = 0
    for k in range(0, len(symbols), langid.SEGMENT):
        part, i = symbols[k : k + langid.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and sample.find(part[i : i + n + 1]) >= 0:
                n += 1
            if n == 1 and sample.find(part[i : i + 1]) < 0:
                n = 1
            i += n
            count += 1
    return count


def test_phrases_equal_substring_search():
    samples = {lang: [" ".join(WORDS[lang] * 3)] for lang in WORDS}
    model = langid.learn(samples)
    texts = ["the water", "zzz", "x", "Über mañana der", " ".join(WORDS["es"] * 40), "日本 the", "a\n\tb  c" * 50]
    got, sizes = langid.phrases(model, texts)
    for t, row, size in zip(texts, got, sizes):
        symbols = langid.normalise(t).tobytes()
        assert size == len(symbols)
        assert row.tolist() == [phrases(langid.normalise(samples[lang][0]).tobytes(), symbols) for lang in model["langs"]]


def test_automaton_accepts_exactly_the_substrings():
    rng = random.Random(2)
    for _ in range(30):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        step = langid.automaton(s)
        for _ in range(60):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
            state = 0
            for c in w:
                state = step[state].get(c, -1)
                if state < 0:
                    break
            assert (state >= 0) == (w in s)


def test_held_out_accuracy(spark):
    rows = corpus()
    got = langid.language(util.documents(spark, rows, extra=True)).collect()
    lang = {i: x for i, _, x, _ in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_and_sources_do_not_matter(spark):
    rows = corpus(120)
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x, "z") for i, t, x, _ in rows]
    a = sorted(tuple(r) for r in langid.language(util.documents(spark, rows)).collect())
    b = sorted(tuple(r) for r in langid.language(util.documents(spark, other)).collect())
    assert a == b


def test_undetermined(spark):
    rows = corpus(60) + [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 -- !!", "en", "a"), (903, "é", None, None), (None, "the water", "en", "a"), (904, "the " * 30000, None, "a")]
    got = {r.doc_id: r for r in langid.language(util.documents(spark, rows)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred != "und" and got[904].lang_pred == "en" and got[None].lang_pred == "en"
    assert langid.language(util.documents(spark, [])).collect() == []
    assert [r.lang_pred for r in langid.language(util.documents(spark, [(1, "text", None, None)])).collect()] == ["und"]


def test_filter_keeps_clean_documents_as_they_are(spark):
    rows = corpus(80) + [(900, None, "en", "a"), (901, "@@@@ 12", "en", "a")]
    docs = util.documents(spark, rows, extra=True)
    out = langid.known_language(docs)
    assert out.columns == docs.columns and {r[0] for r in out.select("doc_id").collect()} == {i for i, *_ in corpus(80)}


def test_scores_grow_with_evidence():
    model = langid.learn({lang: [" ".join(w * 3)] for lang, w in WORDS.items()})
    _, score, _ = langid.predict(model, ["the", "the people never with this water " * 4])
    assert score[1] > score[0] and np.isclose(score[1], 1.0)
