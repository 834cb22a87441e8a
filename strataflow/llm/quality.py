"""Quality rules: counts by rule, and a calibrated hashed n-gram logistic regression.

The regression sees relative frequencies of hashed words and of hashed byte 4-grams. It is fitted
with class weights on TRAIN_ROWS labelled rows at most (the smallest hashes of doc_id, so the same rows each
time), and Platt-scaled on every fifth of them, which the fit leaves out. Scoring runs in Arrow batches, in memory bounded by
one text, against a fixed threshold; every row is scored over its whole text.

Lines and windows of a text are compared by 52 bits of a 64-bit hash: two different ones among n pass for equal with a
probability of about n * n / 2**53, which is 5e-8 for 20,000 words.

Nulls: a null text has no words. A text without words fails the base rules. Labels with a null
doc_id or quality are left out; of repeated ones the largest counts. With no labels, or with one class only, the verdict keeps
whatever the base rules keep. Repeated rows get a row each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import bytesops as B
from strataflow.llm import scratch

TRAIN_ROWS = 4000
BUCKETS = 1 << 13
KEEP = 0.3
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GRAM = B.U64(0x9E3779B97F4A7C15)


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """0 for a (doc, hash) that occurs once, 1 for the first of several, 2 for later ones."""
    out = np.zeros(len(h), dtype=np.int8)
    if len(h) < 2:
        return out
    # 12 bits of the text's number within the chunk above 52 bits of the hash
    key = (doc.astype(B.U64) << B.U64(52)) | (h >> B.U64(12))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    later = np.concatenate([[False], same])
    first = np.concatenate([same, [False]]) & ~later
    out[order[later]] = 2
    out[order[first]] = 1
    return out


def rule_counts(texts: list[bytes]) -> tuple[np.ndarray, tuple]:
    """COUNTS of each text (one row each), and what the features need of the same pass. 4,096 texts at most."""
    data, starts = B.layout(texts)
    n = len(texts)
    s, e = B.word_bounds(data)
    prefix = B.prefix_hashes(data)
    words = B.span_hashes(prefix, s, e)
    first = np.searchsorted(s, starts)
    counts = np.diff(first)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])
    chars = per_text(~B.WS[data] & ((data & 0xC0) != 0x80))
    symbols = per_text(SYMBOLS[data])
    # lines: each text ends with the newline of the layout
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    worded = np.searchsorted(s, line_ends) > np.searchsorted(s, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_doc = np.searchsorted(starts, line_starts, side="right") - 1
    dup = np.bincount(line_doc, weights=_repeats(line_doc, B.span_hashes(prefix, line_starts, line_ends)) == 2, minlength=n)
    # words within repeated windows
    word_doc = np.repeat(np.arange(n), counts)
    repeat = np.zeros(n)
    if len(words) >= 5:
        at = np.flatnonzero(word_doc[4:] == word_doc[:-4])
        hit = at[_repeats(word_doc[at], B.windows(words, 5)[at]) > 0]
        cover = np.zeros(len(words) + 6, dtype=np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = np.bincount(word_doc, weights=np.cumsum(cover)[: len(words)] > 0, minlength=n)
    table = np.stack([counts, chars, symbols, dup, repeat], axis=1).astype(np.int64)
    return table, (data, starts, words, word_doc, counts)


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the byte 4-gram that starts at each position but the last three, in BUCKETS to 2 BUCKETS - 1."""
    d = B.LOWER[data].astype(np.uint32)
    code = d[:-3] | (d[1:-2] << np.uint32(8)) | (d[2:-1] << np.uint32(16)) | (d[3:] << np.uint32(24))
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - 13)) + np.uint32(BUCKETS)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: occupied buckets and their relative frequencies, words and grams each summing to 1."""
    for text in texts:
        data, _ = B.layout([text])
        s, e = B.word_bounds(data)
        h = (B.span_hashes(B.prefix_hashes(data), s, e) % B.U64(BUCKETS)).astype(np.int64)
        x = np.bincount(h, minlength=2 * BUCKETS) / max(len(h), 1)
        if len(data) > 4:
            g = _grams(data[:-1])
            x += np.bincount(g, minlength=2 * BUCKETS) / len(g)
        at = np.flatnonzero(x)
        yield at, x[at]


def score(model: dict, texts: list[bytes], parts: tuple) -> np.ndarray:
    """Calibrated probability of good quality, for the texts that ``parts`` came from."""
    data, starts, words, word_doc, counts = parts
    n, w = len(texts), model["w"]
    z = np.bincount(word_doc, weights=w[(words % B.U64(BUCKETS)).astype(np.int64)], minlength=n) / np.maximum(counts, 1)
    if len(data) > 4:
        # grams that would take in the newline between texts are no grams of either
        run = np.concatenate([[0.0], np.cumsum(w[_grams(data)])])
        last = np.maximum(starts[1:] - 4, starts[:-1])
        z += (run[np.minimum(last, len(run) - 1)] - run[np.minimum(starts[:-1], len(run) - 1)]) / np.maximum(last - starts[:-1], 1)
    return 1.0 / (1.0 + np.exp(-(model["a"] * (z + model["b"]) + model["c"])))


def _fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, rounds: int = 120) -> dict | None:
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 20 or min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) == 0:
        return None
    row = np.repeat(np.arange(len(y)), [len(r) for r in rows])
    col, val = np.concatenate(rows), np.concatenate(values)
    dims = 2 * BUCKETS
    scale = 1.0 / np.sqrt(np.bincount(col, weights=val**2, minlength=dims) / len(y) + 1e-7)
    val = val * scale[col] / np.sqrt(200.0)
    weight = np.where(y > 0, 0.5 / y[~held].sum(), 0.5 / (1 - y[~held]).sum()) * ~held
    w, b, vw, vb = np.zeros(dims), 0.0, np.zeros(dims), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights=val * w[col], minlength=len(y)) + b
        g = weight * (1.0 / (1.0 + np.exp(-z)) - y)
        vw = 0.9 * vw - 0.5 * (np.bincount(col, weights=val * g[row], minlength=dims) + 1e-4 * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        w, b = w + vw, b + vb
    z = (np.bincount(row, weights=val * w[col], minlength=len(y)) + b)[held]
    # Platt scaling by Newton's steps on the held-out fifth, with his smoothed targets
    pos, neg = y[held].sum(), (1 - y[held]).sum()
    t = np.where(y[held] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-(a * z + c)))
        r, d = p - t, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(d * z * z).sum() + 1e-3, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-6]])
        a, c = np.array([a, c]) - np.linalg.solve(hess, grad)
    return {"w": (w * scale / np.sqrt(200.0)).astype(np.float64), "b": float(b), "a": float(a), "c": float(c)}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """Fit on ``rows`` labelled documents at most. Only they leave the executors, as hashed counts."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(B.texts_of(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))],
                ["doc_id", "quality", "at", "x"],
            )

    # the chosen labels are 4,000 rows of two numbers at most
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(scratch.lean(hashed), "doc_id long, quality int, at array<int>, x array<float>")
    table = sample.toArrow().sort_by([("doc_id", "ascending")])
    at, x = ([np.asarray(v) for v in table.column(c).to_numpy()] for c in ("at", "x"))
    y = (np.asarray(table.column("quality").to_pylist(), dtype=float) > 0).astype(float)
    order = np.argsort([hash((int(i), 5)) for i in table.column("doc_id").to_pylist()], kind="stable") if len(y) else []
    return _fit([at[i] for i in order], [x[i].astype(float) for i in order], y[order]) if len(y) else None


def judge(docs: DataFrame, model: dict | None, keep: float = KEEP) -> DataFrame:
    """doc_id, the counts, base_failed, kept and quality_score of every row."""
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2 x BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = B.texts_of(batch.column("text"))
            tables, scores = [np.zeros((0, 5), dtype=np.int64)], [np.zeros(0)]
            for low, high in B.chunks(texts):
                for i in range(low, high, 4096):
                    part = texts[i : min(i + 4096, high)]
                    table, parts = rule_counts(part)
                    tables.append(table)
                    scores.append(score(m, part, parts) if m else np.ones(len(part)))
            t, p = np.concatenate(tables), np.concatenate(scores)
            failed = (t[:, 0] < 10) | (100 * t[:, 4] > 20 * t[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(t[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (p >= keep)), pa.array(p)],
                ["doc_id", *COUNTS, "base_failed", "kept", "quality_score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "text").mapInArrow(scratch.lean(run), f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, quality_score double")


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, train_model: Callable = train) -> DataFrame:
    return judge(docs, train_model(docs, labels), keep)
