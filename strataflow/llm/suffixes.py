"""Suffix-array deduplication of repeated byte strings.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id,
or before in the same document. Strings are judged on the input.

1. Anchors. A window of LENGTH bytes is represented by its minimizer, the least of the hashes of its
   GRAM-byte strings (the leftmost of equal ones). Equal windows have equal minimizers, so only windows whose
   minimizer occurs twice anywhere can repeat. Anchors are narrow rows; texts stay where they are.
2. Segments. For documents with shared anchors, each maximal run of windows with one such minimizer
   becomes a segment, sent to its minimizer's shard. Repeats within a document are settled there.
3. Shards. Equal segments collapse onto the earliest. Over the distinct ones a suffix array is built by
   Larsson-Sadakane refinement (ranks double in depth, only unresolved groups are sorted again), and
   Kasai's common prefixes, filled from the irreducible ones: neighbours with LENGTH common bytes
   are one string, of which the earliest start stays.
4. Merging. Minimizers that very many documents share are split over several shards, whose earliest windows meet again by
   a hash of their bytes: hashes are counted first, and only windows whose hash several shards have are sent, dealt by it. So
   what documents add around a common passage goes nowhere, and the passage's windows are spread over all tasks. Sorted
   distinct windows of shards are merged by binary search, as are those of a group too large for one array.

Later copies of a whole text of LENGTH bytes or more lose everything and are settled by digest.

Nulls: a null text is empty; a null doc_id is the smallest. Rows that repeat a doc_id with another
text are ordered by a hash of their texts; with the same text they are one document, and give equal rows. Texts
shorter than LENGTH lose nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataflow.llm import bitmap, scratch
from strataflow.llm import bytesops as B

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
FREQUENT, LOCAL, LIST = 1 << 14, 1 << 22, 4096
SHARD_BYTES = 1 << 20
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- anchors


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each position as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view("<u8").ravel()


def minimizers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, position of its minimizer) for all windows within texts laid out with
    ``starts``, and the hash of the GRAM bytes at every position. Hashes only group; bytes decide later."""
    n = len(data)
    if n < LENGTH + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, B.U64)
    words = _words(data)
    m = n - GRAM + 1
    grams = words[:m] * B.STEPS[0]
    grams ^= words[8 : m + 8] * B.STEPS[1]
    grams ^= words[16 : m + 16] * B.STEPS[2]
    grams ^= grams >> B.U64(31)
    grams *= B.STEPS[3]
    bits = int(n).bit_length()
    least = grams & B.U64((1 << 64) - (1 << bits))
    least |= np.arange(m, dtype=B.U64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    inside = np.ones(len(least), dtype=bool)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):  # a text ends a byte before the next begins
        inside[max(s, e - LENGTH) : e] = False
    window = np.flatnonzero(inside)
    return window, (least[window] & B.U64((1 << bits) - 1)).astype(np.int64), grams


def _runs(window: np.ndarray, place: np.ndarray) -> np.ndarray:
    """First index of each run of consecutive windows with one minimizer."""
    new = np.ones(len(window), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    return np.flatnonzero(new)


def _fresh(texts: list[bytes], ids: np.ndarray, seen: dict[bytes, int]) -> list[bytes]:
    """The texts, with copies left empty of ones that this task has taken for the same or a smaller id, or will take
    from this batch: later copies are settled by digest, and the earliest is always taken, in whatever order rows are read."""
    keys = [hashlib.sha256(t).digest() if len(t) >= LENGTH else None for t in texts]
    least: dict[bytes, int] = {}
    for i, key in enumerate(keys):
        if key is not None and (key not in least or ids[i] < ids[least[key]]):
            least[key] = i
    out = [b""] * len(texts)
    for key, i in least.items():
        doc = int(ids[i])
        if key in seen and seen[key] <= doc:
            continue
        if len(seen) >= 1 << 18:  # memory bound; taking a copy twice costs time only
            seen.clear()
        seen[key] = doc
        out[i] = texts[i]
    return out


def _anchors(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, text index, anchor hash, times) chunk by chunk; one row per text and hash."""
    for low, high in B.chunks(texts, 1 << 16):
        data, starts = B.layout(texts[low:high])
        window, place, grams = minimizers(data, starts)
        if not len(window):
            continue
        first = _runs(window, place)
        h = grams[place[first]]
        doc = np.searchsorted(starts, window[first], side="right") - 1
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        yield low, high, doc[head], h[head], np.diff(np.append(head, len(h)))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of anchors that several of the documents read in a row share."""
    held, total, seen = [], 0, {}

    def frequent() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held) if held else np.zeros(0, B.U64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 7].view(np.int64)), pa.array(n[n > 7].astype(np.int64))], ["h", "n"])

    for batch in batches:
        for _, _, _, h, _ in _anchors(_fresh(B.texts_of(batch.column("text")), np.asarray(batch.column("doc")), seen)):
            held.append(h)
            total += len(h)
            if total > LOCAL:
                yield frequent()
                held, total = [], 0
    yield frequent()


def _shards(keyed: DataFrame) -> dict[int, int]:
    """Shards of the minimizers with more than LIST documents, the FREQUENT most frequent at most."""
    counts = keyed.select("doc", "text").mapInArrow(scratch.lean(_survey), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > LIST)
    return {r["h"]: -(-r["n"] // LIST) for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()}


def _anchor_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        hot = np.array(sorted(shared.value), dtype=np.int64)
        for batch in batches:
            ids, marks = (np.asarray(batch.column(c)) for c in ("doc", "mark"))
            texts = _fresh(B.texts_of(batch.column("text")), ids, seen)
            for low, high, doc, h, times in _anchors(texts):
                h = h.view(np.int64)
                salt = np.zeros(len(h), dtype=np.int32)
                if len(hot):
                    for i in np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h):
                        salt[i] = 1 + hash((int(ids[low + doc[i]]), int(marks[low + doc[i]]))) % shared.value[int(h[i])]
                flags = salt.astype(np.int64) * 2 + (times > 1)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[low + doc]), pa.array(marks[low + doc]), pa.array(flags)], ["h", "doc", "mark", "flags"])

    return run


def _possible(bits):
    """Rows whose ids may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.contains(bits.value, np.asarray(batch.column("doc")))))

    return run


# ---------------------------------------------------------------- segments


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE rows of documents with their shared anchors: segments, and spans settled on the spot.

    A segment that the task has sent for an earlier start is not sent again: its windows are later ones.
    """
    sent: dict[bytes, tuple[int, int, int]] = {}
    held = 0
    for batch in batches:
        rows: list[tuple] = []
        anchors = batch.column("anchors")
        offsets = anchors.offsets.to_numpy()
        hashes, flags = (anchors.values.field(c).to_numpy() for c in ("h", "flags"))
        for i, (doc, mark, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text")))):
            raw = text.encode()
            data, starts = B.layout([raw])
            window, place, grams = minimizers(data, starts)
            mine = slice(offsets[i] - offsets[0], offsets[i + 1] - offsets[0])
            salts = dict(zip(hashes[mine].tolist(), (flags[mine] >> 1).tolist()))
            first = _runs(window, place)
            h = grams[place[first]].view(np.int64)
            begin = window[first]
            end = window[np.append(first[1:], len(window)) - 1] + 1 if len(first) else begin
            own = np.flatnonzero(np.isin(h, hashes[mine]))
            late: list[list[int]] = []
            for x, s, e in zip(h[own].tolist(), begin[own].tolist(), end[own].tolist()):
                segment = raw[s : e - 1 + LENGTH]
                have = sent.get(segment)
                if have == (doc, mark, s):  # a repeated row
                    continue
                if have is not None and have < (doc, mark, s):
                    if late and late[-1][1] == s:
                        late[-1][1] = e
                    else:
                        late.append([s, e])
                    continue
                if held > 1 << 26:  # memory bound; sending a segment again is harmless
                    sent.clear()
                    held = 0
                sent[segment] = doc, mark, s
                held += len(segment) + 200
                rows.append((1, x, salts[x], doc, mark, s, e, segment))
            rows += [(0, s * 0x9E37 + doc & 0xFFFFFF, 0, doc, mark, s, e, None) for s, e in late]
            if len(rows) > 20000:
                yield _pieces(rows)
                rows = []
        if rows:
            yield _pieces(rows)


PIECE = "kind int, h long, salt int, doc long, mark long, s long, e long, segment binary"
_PIECE = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("mark", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("segment", pa.binary())])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


# ---------------------------------------------------------------- suffix arrays


def suffix_array(codes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffix array of strings laid end to end; ``left`` says how many characters its string has from each
    position on. Suffixes end with their strings; equal ones are in order of position.

    Larsson-Sadakane: suffixes are ranked by 7 characters, then by pairs of ranks at distance h, 2h,
    ...; a resolved suffix is never touched again.
    """
    n = len(codes)
    # 7 characters, big end first, and below them how many the string still has: a prefix sorts first
    key = _words(codes).byteswap() >> B.U64(8) << B.U64(8)
    near = np.flatnonzero(left < 7)
    key[near] = key[near] >> (64 - 8 * left[near]).astype(B.U64) << (64 - 8 * left[near]).astype(B.U64)
    key |= np.minimum(left, 7).astype(B.U64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, dtype=np.int64)
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    lone = new & np.append(new[1:], True)
    active = order[~lone]
    most, h = int(left.max()) if n else 0, 7
    while len(active) and h < most:
        ahead = np.where(left[active] > h, rank[np.minimum(active + h, n - 1)] + 1, 0)
        pair = (rank[active] << 32) | ahead
        by = np.argsort(pair)
        active, pair = active[by], pair[by]
        base = pair >> 32
        group = np.ones(len(active), dtype=bool)
        group[1:] = base[1:] != base[:-1]
        index = np.arange(len(active))
        place = base + index - np.maximum.accumulate(np.where(group, index, 0))
        new = np.ones(len(active), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        order[place] = active
        rank[active] = place[np.maximum.accumulate(np.where(new, index, 0))]
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    if len(active):  # equal to their strings' ends
        by = np.lexsort((active, rank[active]))
        active = active[by]
        base = rank[active]
        group = np.ones(len(active), dtype=bool)
        group[1:] = base[1:] != base[:-1]
        index = np.arange(len(active))
        order[base + index - np.maximum.accumulate(np.where(group, index, 0))] = active
    return order


def common_prefixes(codes: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Characters that each suffix of the array shares with the one before it.

    By Kasai's inequality the value of a position is at least that of the one before less one, and equal
    to it unless the characters in front differ; only those irreducible values are compared.
    """
    n = len(codes)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    begins = np.ones(n, dtype=bool)
    begins[1:] = left[1:] != left[:-1] - 1
    b = np.maximum(before, 1)
    reducible = ~begins & (before > 0) & ~begins[b] & (codes[np.maximum(at, 1) - 1] == codes[b - 1])
    i = np.flatnonzero(~reducible & (before >= 0))
    j = before[i]
    most = np.minimum(left[i], left[j])
    words = np.append(_words(codes), B.U64(0))
    same = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    while len(live):
        x = words[np.minimum(i[live] + same[live], n)] ^ words[np.minimum(j[live] + same[live], n)]
        low = x & (~x + B.U64(1))
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, B.U64(1)).astype(np.float64)).astype(np.int64) >> 3)
        same[live] = np.minimum(same[live] + equal, most[live])
        live = live[(equal == 8) & (same[live] < most[live])]
    value = np.full(n, -(1 << 40), dtype=np.int64)
    value[i] = same + i
    value[before < 0] = at[before < 0]
    filled = np.maximum.accumulate(value) - at
    return np.maximum(filled[order], 0)


def first_starts(segments: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of distinct segments: their position, segment, whether they are the earliest
    start of their string, and the windows in sorted order. ``owners`` has (doc, mark, start) rows."""
    codes = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    order = suffix_array(codes, left)
    shared = common_prefixes(codes, left, order)
    is_window = left[order] >= LENGTH
    # strings shorter than LENGTH sort among the windows but share too little to join two of them
    group = np.cumsum(shared < LENGTH)
    window, group = order[is_window], group[is_window]
    seg = np.searchsorted(ends, window, side="right")
    start = owners[seg, 2] + window - (ends - sizes)[seg]
    first = np.ones(len(window), dtype=bool)
    met = np.zeros(len(window), dtype=bool)
    met[1:] = group[1:] == group[:-1]
    met[:-1] |= met[1:]
    k = np.flatnonzero(met)
    by = k[np.lexsort((start[k], owners[seg[k], 1], owners[seg[k], 0], group[k]))]
    first[by[1:][group[by[1:]] == group[by[:-1]]]] = False
    return window, seg, first, start


def _as_strings(codes: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Windows as comparable byte strings; a last byte 1 keeps trailing zeros significant."""
    out = np.ones((len(windows), LENGTH + 1), dtype=np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(codes, LENGTH)[windows] if len(windows) else 0
    return out.view(f"S{LENGTH + 1}").ravel()


class Merged:
    """Distinct windows of several shards in order, each with its earliest start."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=f"S{LENGTH + 1}")
        self.owners = np.zeros((0, 3), dtype=np.int64)

    def add(self, keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Merge sorted distinct windows by binary search; returns the starts that turn out later ones."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == keys[inner]
        k = np.flatnonzero(known)
        old, new = self.owners[at[k]], owners[k]
        earlier = (new[:, 0] < old[:, 0]) | ((new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | ((new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))))
        same = (new == old).all(axis=1)
        later = np.where(earlier[:, None], old, new)[~same]
        self.owners[at[k[earlier]]] = new[earlier]
        fresh = np.flatnonzero(~known)
        self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        self.owners = np.insert(self.owners, at[fresh], owners[fresh], axis=0)
        return later


def _intervals(doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> Iterator[tuple]:
    """Kind 0 rows of runs of consecutive starts."""
    by = np.lexsort((start, mark, doc))
    doc, mark, start = doc[by], mark[by], start[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] > start[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(by)) - 1
    for d, m, s, e in zip(doc[head].tolist(), mark[head].tolist(), start[head].tolist(), (start[tail] + 1).tolist() if len(head) else []):
        yield 0, 0, 0, d, m, s, e, None


def _shard(items: list[tuple]) -> Iterator[tuple]:
    """Settle (h, salt, doc, mark, s, e, segment) items of whole groups, SHARD_BYTES or so. Yields kind 0 rows of later
    starts, and for salted groups kind 1 rows of the earliest, as sorted windows' segments."""
    best: dict[bytes, tuple] = {}
    for x in items:
        have = best.get(x[6])
        if have is not None and x[2:5] == have[2:5]:  # a row that repeats a document: the same start
            continue
        if have is None or x[2:5] < have[2:5]:
            best[x[6]] = x
            x, have = have, x
        if x is not None:
            yield 0, 0, 0, x[2], x[3], x[4], x[5], None
    # windows of one minimizer are equal only at equal distance from it, so a segment alone in its group has no repeats
    groups = Counter((x[0], x[1]) for x in best.values())
    yield from ((1, *x) for x in best.values() if groups[x[0], x[1]] == 1 and x[1] > 0)
    distinct = [x for x in best.values() if groups[x[0], x[1]] > 1]
    if not distinct:
        return
    owners = np.array([x[2:5] for x in distinct], dtype=np.int64).reshape(-1, 3)
    window, seg, first, start = first_starts([x[6] for x in distinct], owners)
    late = ~first
    yield from _intervals(owners[seg[late], 0], owners[seg[late], 1], start[late])
    salted = np.array([x[1] > 0 for x in distinct], dtype=bool)
    keep = first & salted[seg]
    if keep.any():
        by = np.lexsort((start[keep], seg[keep]))
        s, at = seg[keep][by], start[keep][by]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        for k, a, z in zip(s[head].tolist(), at[head].tolist(), (at[np.append(head[1:], len(s)) - 1] + 1).tolist()):
            x = distinct[k]
            yield 1, x[0], x[1], x[2], x[3], a, z, x[6][a - x[4] : z - 1 - x[4] + LENGTH]


def _merge(shards: list[list[tuple]]) -> Iterator[tuple]:
    """Kind 0 rows of starts that are earliest in their own shard only."""
    merged = Merged()
    for items in shards:
        codes = np.frombuffer(b"".join(x[6] for x in items), dtype=np.uint8)
        sizes = np.array([len(x[6]) for x in items])
        offset = np.cumsum(sizes) - sizes
        count = sizes - LENGTH + 1
        seg = np.repeat(np.arange(len(items)), count)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        owners = np.array([x[2:5] for x in items], dtype=np.int64)[seg]
        owners[:, 2] += nth
        keys = _as_strings(codes, offset[seg] + nth)
        by = np.argsort(keys, kind="stable")
        later = merged.add(keys[by], owners[by])
        yield from _intervals(later[:, 0], later[:, 1], later[:, 2])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, salt) -> kind 0 rows, and kind 1 rows of salted groups. Whole groups are gathered
    into shards; a group larger than a shard is cut into several, merged by binary search."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = group_size = 0
    parts: list[list[tuple]] = []

    def settled(items: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(_shard(items))
        for i in range(0, len(rows), 20000):
            yield _pieces(rows[i : i + 20000])

    def close() -> Iterator[pa.RecordBatch]:
        """The group is complete."""
        nonlocal group, group_size, size, parts
        if parts:
            shards = []
            for items in [*parts, group]:
                marked = [(x[0], 1, *x[2:]) for x in items]
                rows = list(_shard(marked))
                yield _pieces([r for r in rows if r[0] == 0])
                shards.append([r[1:] for r in rows if r[0] == 1])
            # a salted group's earliest starts go on to the merging of its shards
            merged = list(_merge(shards))
            yield _pieces(merged)
            if group and group[0][1] > 0:
                lost: dict[tuple, list[tuple]] = {}
                for r in merged:
                    lost.setdefault((r[3], r[4]), []).append((r[5], r[6]))
                for items in shards:
                    yield _pieces([(1, x[0], group[0][1], x[2], x[3], a, z, x[6][a - x[4] : z - 1 - x[4] + LENGTH]) for x in items for a, z in _without(x[4], x[5], lost.get((x[2], x[3]), ()))])
        else:
            held.extend(group)
            size += group_size
        group, group_size, parts = [], 0, []
        if size > SHARD_BYTES:
            yield from settled(held)
            held.clear()
            size = 0

    for batch in batches:
        through = batch.filter(pa.array(np.asarray(batch.column("kind")) == 0))
        if through.num_rows:
            yield through
        work = batch.filter(pa.array(np.asarray(batch.column("kind")) == 1))
        for x in zip(*(work.column(c).to_pylist() for c in ("h", "salt", "doc", "mark", "s", "e", "segment"))):
            if group and (group[-1][0] != x[0] or group[-1][1] != x[1]):
                yield from close()
            group.append(x)
            group_size += len(x[6])
            if group_size > SHARD_BYTES:
                parts.append(group)
                group, group_size = [x], 0  # the last stays, so that the group is known; twice the same start is harmless
    yield from close()
    if held:
        yield from settled(held)


def _without(start: int, end: int, gone) -> Iterator[tuple[int, int]]:
    """The parts of a range that none of the ranges ``gone`` covers."""
    for a, z in sorted(gone):
        if a > start and start < end:
            yield start, min(a, end)
        start = max(start, z)
    if start < end:
        yield start, end


def _windows(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, segment, position in it, position in all) of every window of the segments laid end to end."""
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(x) for x in segments], dtype=np.int64)
    offset, number = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    seg = np.repeat(np.arange(len(segments)), number)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(number) - number, number)
    at = offset[seg] + nth
    return B.span_hashes(B.prefix_hashes(data), at, at + LENGTH).view(np.int64), seg, nth, at


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            h, *_ = _windows(batch.column("segment").slice(i, 2000).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h)], ["k"])


WINDOW = "k long, salt int, doc long, mark long, s long, window binary"


def _shared_windows(bits):
    """WINDOW rows of the windows whose hash may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                segments = part.column("segment").to_pylist()
                h, seg, nth, at = _windows(segments)
                some = np.flatnonzero(bitmap.contains(bits.value, h))
                salt, doc, mark, s = (np.asarray(part.column(c))[seg[some]] for c in ("salt", "doc", "mark", "s"))
                data = b"".join(segments)
                windows = [data[x : x + LENGTH] for x in at[some].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(salt), pa.array(doc), pa.array(mark), pa.array(s + nth[some]), pa.array(windows, pa.binary())], ["k", "salt", "doc", "mark", "s", "window"])

    return run


def _settle_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOW rows sorted by k: merge the shards' windows, whole hashes at a time. A hash has a row for each shard at most."""
    held: list[tuple] = []

    def close() -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple]] = {}
        for _, salt, doc, mark, s, window in held:
            shards.setdefault(salt, []).append((0, 0, doc, mark, s, s + 1, window))
        rows = list(_merge(list(shards.values())))
        if rows:
            yield _pieces(rows)
        held.clear()

    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("k", "salt", "doc", "mark", "s", "window"))):
            if len(held) >= 20000 and held[-1][0] != x[0]:
                yield from close()
            held.append(x)
    if held:
        yield from close()


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_removed, n_spans and kept_sha256 of documents with the starts of their later strings."""
    for batch in batches:
        rows = []
        for doc, mark, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "spans"))):
            raw, at, out, removed, count, last = text.encode(), 0, [], 0, 0, -1
            for s, e in sorted((x["s"], x["e"] - 1 + LENGTH) for x in spans):
                if s > last:
                    count += 1
                    out.append(raw[at:s])
                    removed += e - s
                else:
                    removed += max(0, e - last)
                last = at = max(last, e)
            out.append(raw[at:])
            rows.append((doc, mark, removed, count, hashlib.sha256(b"".join(out)).hexdigest()))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_doc", "_mark", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    narrow = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"),
    )
    narrow = scratch.cut(narrow, "narrow", files=scratch.tasks(docs))
    firsts = narrow.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("_c")).where("_c > 1").select(F.col("sha").alias("_sha"), "first")
    firsts = scratch.broadcast_if_small(scratch.cut(firsts, "firsts", narrow=True))  # else a plain join, whose skew can be split
    placed = narrow.join(firsts, F.col("sha") == F.col("_sha"), "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)))

    hot = spark.sparkContext.broadcast(_shards(keyed))  # FREQUENT entries at most
    # flags: twice the salt, plus 1 for an anchor that its document has several times
    # without nulls, so that no inferred filter tells its two readers apart
    anchor = StructType([StructField(c, LongType(), False) for c in ("h", "doc", "mark", "flags")])
    anchors = keyed.mapInArrow(scratch.lean(_anchor_rows(hot)), anchor)
    salt = F.shiftright("flags", 1)
    anchors = anchors.repartition(F.col("h"), salt.alias("salt"))
    # both readers of the anchors use all columns, so that they share one shuffle
    met = anchors.groupBy(F.col("h").alias("_h"), salt.alias("_s")).agg(
        F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("mark").alias("m0"), F.max("mark").alias("m1"), F.max(F.col("flags").bitwiseAND(F.lit(1).cast("long"))).alias("t")
    ).where("_s > 0 or t = 1 or d0 < d1 or m0 < m1").select("_h", "_s")
    shared = anchors.join(met, (F.col("h") == F.col("_h")) & (salt == F.col("_s")))
    shared = shared.groupBy("doc", "mark").agg(F.collect_list(F.struct("h", "flags")).alias("anchors"))
    # a document's anchors are fewer than its bytes; documents without shared ones end here, before texts are shuffled
    shared = scratch.cut(shared, "shared")
    bits = spark.sparkContext.broadcast(bitmap.build(shared, "doc"))
    some = keyed.mapInArrow(scratch.lean(_possible(bits)), keyed.schema)
    wanted = some.join(shared.withColumnRenamed("doc", "_d").withColumnRenamed("mark", "_m"), (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m")))
    candidates = scratch.cut(wanted.select("doc", "mark", "text", "anchors"), "candidates")
    pieces = candidates.mapInArrow(scratch.lean(_segment_rows), PIECE).repartition("h", "salt").sortWithinPartitions("h", "salt")
    settled = scratch.cut(pieces.mapInArrow(scratch.lean(_settle), PIECE), "settled")
    earliest = settled.where("kind = 1")
    several = earliest.select("segment").mapInArrow(scratch.lean(_window_hashes), "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    several = spark.sparkContext.broadcast(bitmap.build(scratch.cut(several, "windows", narrow=True), "k"))
    windows = earliest.select("salt", "doc", "mark", "s", "segment").mapInArrow(scratch.lean(_shared_windows(several)), WINDOW)
    across = windows.repartition("k").sortWithinPartitions("k").mapInArrow(scratch.lean(_settle_across), PIECE)
    spans = settled.where("kind = 0").unionByName(across).groupBy("doc", "mark").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = spans.withColumnRenamed("doc", "_d").withColumnRenamed("mark", "_m")
    results = candidates.select("doc", "mark", "text").join(spans, (F.col("doc") == F.col("_d")) & (F.col("mark") == F.col("_m")))
    results = results.select("doc", "mark", "text", "spans").mapInArrow(scratch.lean(_cut_texts), "_doc long, _mark long, n_removed long, n_spans long, kept_sha256 string")
    # rows that repeat a document give the same result
    results = results.groupBy("_doc", "_mark").agg(*(F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")))
    done = placed.join(results, (F.col("doc") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    gone = F.col("copy")
    return done.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
