"""Language identification by cross-parsing entropy.

One suffix automaton per language is built on the driver from a bounded sample of labelled text:
SAMPLE_DOCS documents a language (least hashes of doc_id) and TRAIN_BYTES normalised bytes. A text
is cross-parsed against each: the longest match with the language's sample is a phrase, then the
next begins. The language that needs the fewest phrases per symbol wins; ties go to the
first in code point order.

The automata become dense transition tables and all segments of a batch advance one
symbol at a time together. A text is cut into segments of SEGMENT symbols, which end a phrase, the
same for every language; every segment of the whole text counts.

Normalisation: lower case; what is neither an ASCII letter nor part of a multi-byte character
becomes a space, runs of spaces become one.

Nulls: a null text, or one without a letter, gives ``und`` and score 0. Labelled rows with a null
lang or text teach nothing; with nothing learned every text is ``und``. A null doc_id counts as the
empty text for the fold. Repeated rows get a row each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strataflow.llm import scratch

SAMPLE_DOCS = 64
TRAIN_BYTES = 32768
ALL_BYTES = 1 << 21
SEGMENT = 256
UNKNOWN = "und"

_KEEP = np.zeros(256, dtype=bool)
_KEEP[97:123] = True
_KEEP[128:] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def normalise(text: str) -> np.ndarray:
    """Bytes of the text in lower case with single spaces between words; it ends with a space."""
    data = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)
    keep = _KEEP[data]
    data = np.where(keep, data, 32).astype(np.uint8)
    first = np.ones(len(data), dtype=bool)
    first[1:] = keep[1:] | keep[:-1]
    return data[first]


def automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def table(step: list[dict[int, int]], width: int) -> np.ndarray:
    """Entry state*width + symbol: (next state * width) << 1, plus 1 when a new phrase begins.

    A last state follows symbols that are nowhere in the sample, each a phrase of its own.
    """
    lost = len(step)
    first = np.full(width, lost, dtype=np.int32)
    for c, n in step[0].items():
        first[c] = n
    out = np.tile(first * width << 1 | 1, (lost + 1, 1))
    out[0] = first * width << 1
    for s, moves in enumerate(step):
        for c, n in moves.items():
            out[s, c] = n * width << 1
    return out.ravel()


def learn(samples: dict[str, list[str]], train_bytes: int = TRAIN_BYTES) -> dict:
    """Model of the languages in ``samples``; all tables together come from ALL_BYTES at most."""
    limit = min(train_bytes, ALL_BYTES // max(len(samples), 1))
    texts = {}
    for lang in sorted(samples):
        parts = [normalise(t) for t in samples[lang]]
        texts[lang] = np.concatenate(parts)[:limit] if parts else np.zeros(0, np.uint8)
    seen = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint8)]))
    classes = np.zeros(256, dtype=np.int32)  # 0: in no sample
    classes[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    return {"langs": list(texts), "classes": classes, "tables": [table(automaton(classes[t].tolist()), width) for t in texts.values()]}


def phrases(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrase counts (text x language) and symbols of each text."""
    symbols = [model["classes"][normalise(t)] for t in texts]
    sizes = np.array([len(s) for s in symbols], dtype=np.int64)
    flat = np.concatenate(symbols) if symbols else np.zeros(0, np.int32)
    begin = np.cumsum(sizes) - sizes
    pieces = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[doc] + nth * SEGMENT
    size = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    doc, start, size = doc[order], start[order], size[order]
    out = np.zeros((len(texts), len(model["tables"])), dtype=np.int64)
    alive = np.searchsorted(-size, -np.arange(SEGMENT), side="left")
    for j, move in enumerate(model["tables"]):
        state = np.zeros(len(doc), dtype=np.int32)
        count = np.ones(len(doc), dtype=np.int32)
        for t in range(SEGMENT):
            n = alive[t]
            if n == 0:
                break
            v = move[state[:n] + flat[start[:n] + t]]
            count[:n] += v & 1
            np.right_shift(v, 1, out=state[:n])
        out[:, j] = np.bincount(doc, weights=count, minlength=len(texts))
    return out, sizes


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and phrases per symbol of each text."""
    known = [i for i, t in enumerate(texts) if t and model["langs"] and any(c.isalpha() for c in t)]
    langs, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
    low = 0
    while low < len(known):
        high, size = low, 0
        while high < len(known) and (high == low or size + len(texts[known[high]]) <= 1 << 20):
            size += len(texts[known[high]])
            high += 1
        part = known[low:high]
        counts, symbols = phrases(model, [texts[i] for i in part])
        best = counts.argmin(axis=1)
        least = counts[np.arange(len(part)), best]
        # each phrase saved is worth a bit of evidence
        score[part] = 1.0 / np.exp2(-np.minimum(counts - least[:, None], 1000)).sum(axis=1)
        rate[part] = least / symbols
        for i, b in zip(part, best):
            langs[i] = model["langs"][b]
        low = high
    return langs, score, rate


def train(docs: DataFrame) -> dict:
    """Learn from text and lang of the rows outside the held-out fold, a bounded sample of them."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ranked = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    # the row number's limit is applied before the shuffle; SAMPLE_DOCS small rows a language remain
    chosen = ranked.where(F.col("_n") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "doc_id", F.left("text", F.lit(TRAIN_BYTES)).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return learn({k: [t[: max(1, 2 * TRAIN_BYTES // len(v))] for t in v] for k, v in samples.items()})


def identify(docs: DataFrame, model: dict, keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs``, and lang_pred, score, phrase_rate."""
    scratch.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_BYTES of samples bound its size
    given = "text" if "text" in keep else "_sf_text"  # texts travel once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rate = predict(shared.value, batch.column(given).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], [*keep, "_sf_lang", "_sf_score", "_sf_rate"]
            )

    schema = StructType([*(docs.schema[c] for c in keep), StructField("_sf_lang", StringType()), StructField("_sf_score", DoubleType()), StructField("_sf_rate", DoubleType())])
    return docs.select(*keep, *([] if given == "text" else [F.col("text").alias(given)])).mapInArrow(scratch.lean(run), schema)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and phrase_rate of every row."""
    found = identify(docs, train(docs), ["doc_id"])
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_sf_lang").alias("lang_pred"), F.col("_sf_score").alias("score"), F.col("_sf_rate").alias("phrase_rate")
    )


MAX_RATE = 0.75


def known_language(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """The documents whose text some learned language parses: not ``und``, and phrases of more than
    1 / ``max_rate`` symbols on average. All columns and the text stay as they are."""
    found = identify(docs, train(docs), docs.columns)
    return found.where((F.col("_sf_lang") != UNKNOWN) & (F.col("_sf_rate") <= max_rate)).select(*docs.columns)
