"""Whole-array numpy kernels over the UTF-8 bytes of many texts at once.

Texts of an Arrow batch are laid out back to back, a newline after each, in chunks of bounded size
(a longer text is a chunk of its own), so temporaries stay small whatever the batch holds.
Hashes are 64-bit: a polynomial of the bytes modulo 2**64 in an odd base, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WS = np.zeros(256, dtype=bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEPS = [U64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_powers: dict[str, np.ndarray] = {}


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` bytes, one text at least."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > limit:
            yield low, i
            low, size = i, 0
        size += len(t) + 1
    if low < len(texts):
        yield low, len(texts)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a newline after each text, and the texts' starts with the end at last."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 18, 1 << int(n).bit_length())
        have = np.full(size, BASE_INVERSE if inverse else BASE, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 22:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space; the data ends with a newline."""
    solid = ~WS[data]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edges = np.concatenate([[0], edges])
    return edges[0::2], edges[1::2]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; k is 5 at most. Windows may cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = words[:n] * STEPS[0]
    for j in range(1, k):
        h = h + words[j : j + n] * STEPS[j]
    return mix(h + U64(k))


def shingles(texts: list[bytes], lower: bool, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct k-word shingles of each text, sorted by both.

    A text of 1 to k-1 words has its whole sequence as one shingle.
    """
    data, starts = layout(texts)
    if lower:
        data = LOWER[data]
    s, e = word_bounds(data)
    if not len(s):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    words = span_hashes(prefix_hashes(data), s, e)
    first = np.searchsorted(s, starts)
    counts = np.diff(first)
    whole = np.repeat(np.arange(len(texts)), np.maximum(counts - k + 1, 0))
    offset = np.arange(len(whole)) - np.repeat(np.cumsum(np.maximum(counts - k + 1, 0)) - np.maximum(counts - k + 1, 0), np.maximum(counts - k + 1, 0))
    doc, h = [whole], [windows(words, k)[first[:-1][whole] + offset] if len(whole) else np.zeros(0, dtype=U64)]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            doc.append(short)
            h.append(windows(words, m)[first[short]])
    doc, h = np.concatenate(doc), np.concatenate(h)
    order = np.lexsort((h, doc)) if len(texts) > 1 else np.argsort(h)
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]
