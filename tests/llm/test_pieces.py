import hashlib
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.llm import pieces
from strataflow.llm.queries import TOKENIZER, op10_sentencepiece
from tests.llm import util

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs the public tokenizer files")
TEXTS = ["", " ", "  ", "a  b", " lead", "trail ", "x   y    z", "日本語 テスト\n\n\t한국", "▁odd▁", "\0 a", "a" * 40, "hellohellohello worldworld", "😀😀 x", " " * 22 + "many", "internationalization antidisestablishmentarianism", util.BASE, "\n" * 7]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(TOKENIZER))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


def test_equals_the_library(codec, library):
    got = codec.encode(TEXTS)
    for t, x in zip(TEXTS, got):
        assert x.tolist() == library.encode(t), t
        assert codec.decode([x])[0] == library.decode(x.tolist())
    assert codec.encode([None])[0].tolist() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst  .\né日▁😀-0"), max_size=60))
def test_equals_the_library_on_random_texts(codec, library, text):
    ids = codec.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    if "▁" not in text:
        assert codec.decode([ids])[0] == text


def test_long_words_and_many_lengths(codec, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (1, 2, 3, 17, 100, 3000)] + ["inter" * 300]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t) for t in texts]


def test_very_long_words_and_runs_of_spaces(codec, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(50_000)), "a" + " " * 50_000 + "b", "a" * 5000, "the" * 3000, "日本語é😀" * 1000]
    texts += ["".join(rng.choice(["the", "ing", "qu", "zzz", "ation", "é", "0", "--"]) for _ in range(n)) for n in (900, 2000, 9000)]
    assert [x.tolist() for x in codec.encode(texts)] == [library.encode(t) for t in texts]
    assert codec._in_blocks("▁" + texts[0]) == library.encode(texts[0])


def test_a_column_of_the_results_name_is_replaced(spark, library):
    docs = util.documents(spark, [(1, "one two", "en", "a")]).selectExpr("*", "'x' ids", "'y' decoded")
    r = pieces.decode(pieces.encode(docs, TOKENIZER), TOKENIZER).first()
    assert r.ids == library.encode("one two") and r.decoded == "one two"


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 5)
    codec = pieces.Codec(pieces.load(TOKENIZER))
    for _ in range(3):
        for t in (util.BASE, "one two three four five six seven", util.BASE.upper(), " x  y"):
            assert codec.encode([t])[0].tolist() == library.encode(t)


def test_unigram_viterbi_equals_enumeration():
    """A toy unigram model: the best sum of scores over all ways to cut the word."""
    vocabulary = {"▁": -2.0, "a": -3.0, "b": -3.5, "c": -4.0, "ab": -4.5, "bc": -6.9, "▁a": -3.1, "abc": -8.0, "ca": -7.5}
    table = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in vocabulary.items()]
    codec = pieces.Codec({"pieces": table, "bpe": False, "prefix": True, "unk": 0})

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, len(word) + 1):
            if word[:n] in vocabulary:
                s, rest = best(word[n:])
                options.append((vocabulary[word[:n]] + s, [word[:n], *rest]))
        return max(options)

    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        ids = codec.encode([word])[0]
        score, _ = best("▁" + word)
        assert abs(sum(table[i][1] for i in ids) - score) < 1e-9


def test_spark_columns_and_query(spark, library, tmp_path):
    rows = [(i, t, "en", "a") for i, t in enumerate([*TEXTS, None])] + [(3, "a  b", "en", "a")]
    docs = util.documents(spark, rows)
    out = pieces.decode(pieces.encode(docs, TOKENIZER), TOKENIZER)
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and (r.decoded == (r.text or "") or "▁" in r.text)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.round_trip == ("▁" not in texts[r.doc_id])
    assert pieces.digests(util.documents(spark, []), TOKENIZER).collect() == []


def test_pairs_are_remembered(monkeypatch):
    """Few transitions that were met before are tested again, and the answers are those of the merging itself."""
    codec = pieces.Codec(pieces.load(TOKENIZER))
    words = [f"{pieces.SPACE}{a}{b}" for a in ("remember", "transit", "under", "Ein") for b in ("ing", "ion", "stand", "heit", "")]
    tested, unmerged = [], codec.unmerged
    monkeypatch.setattr(codec, "unmerged", lambda a, b: tested.append(len(a)) or unmerged(a, b))
    first, once = codec.encode_words(words), sum(tested)
    assert codec.encode_words(words) == first and 10 * (sum(tested) - once) <= once
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, codec.size, (2, 5000))
    assert (codec.apart(a, b) == unmerged(a, b)).all() and (codec.apart(a, b) == unmerged(a, b)).all()
