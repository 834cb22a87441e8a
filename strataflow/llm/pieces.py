"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The text is normalised as the model says (dummy prefix, spaces to U+2581), cut before each run of
spaces, since no piece has a space after another character, and distinct words are encoded once.
Words of equal length advance together: at each end position the hashes of the substrings that end
there probe the sorted keys of the pieces, and the admissible piece of highest score, over all
lengths at once, is stored as the backpointer.

A unigram model takes the sum of scores. In a BPE model, whose scores only order merges, the best
sum is not the model's own segmentation. There a transition from one piece to the next is admissible
only when byte-pair merging leaves the two unmerged; exactly one admissible path exists, and it is what
merging yields. The test undoes merges of the two pieces at their border, for all candidates at once.
Characters that are no piece fall back to bytes.

A word of more than LONG characters is cut into overlapping blocks of one length, which advance together like
words. Neighbouring blocks are joined where both have a border and its two pieces are admissible: then the
whole path is admissible, and so the only one. Runs of spaces, whose pieces share one score, are merged by a heap
of pairs, as is a word whose blocks find no such border; that takes n log n steps for n characters.

Nulls: a null text has no pieces, like an empty one. U+2581 in a text decodes to a space, as in the
format itself; ``round_trip`` is false there. Repeated rows get a row each; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from strataflow.llm import scratch

SPACE = "▁"
CACHE_WORDS = 150_000
LONG, BLOCK, LAP = 2048, 768, 128
MEMO = 18  # bits of the number of remembered pairs, 2 MB
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
LEFT_ALONE = np.int64(1) << np.int64(40)


def load(path: str) -> dict:
    """Pieces, scores and kinds of a model file, as plain data that can be broadcast."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in model.pieces):
        raise ValueError("only models with identity normalisation are supported")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, kind in pieces if kind == 1):
        raise ValueError("a piece crosses words")
    return {"pieces": pieces, "bpe": model.trainer_spec.model_type == 2, "prefix": spec.add_dummy_prefix, "unk": next(i for i, p in enumerate(pieces) if p[2] == 2)}


def _extend(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    return (h ^ (char.astype(U64) + U64(0x632BE5AB))) * _BASE


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of characters, last first, so that a substring grows to the left."""
    h = np.full(len(codes), 0x243F6A8885A308D3, dtype=U64)
    for j in range(codes.shape[1] - 1, -1, -1):
        h = _extend(h, codes[:, j])
        h ^= h >> U64(29)
    return h


class Table:
    """Integer keys to values by a sorted array, with a direct index on the keys' high bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("hashes of two pieces are equal")
        self.bits = U64(64 - max(8, int(len(keys)).bit_length() + 3))
        slots = np.arange(1 << int(64 - int(self.bits)), dtype=U64) << self.bits
        self.first = np.append(np.searchsorted(self.keys, slots), len(keys)).astype(np.int32)
        self.full = np.diff(self.first) > 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 where a key is absent."""
        out = np.full(len(keys), -1, dtype=np.int64)
        slot = (keys >> self.bits).astype(np.int64)
        live = np.flatnonzero(self.full[slot])
        at, end, wanted = self.first[slot[live]], self.first[slot[live] + 1], keys[live]
        while len(live):
            hit = self.keys[at] == wanted
            out[live[hit]] = self.values[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end, wanted = live[more], at[more], end[more], wanted[more]
        return out


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        self.model = model
        self.text = [p for p, _, _ in model["pieces"]]
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(model["pieces"]) if kind == 1]
        self.byte = np.array([next((i for i, (p, _, k) in enumerate(model["pieces"]) if k == 6 and p == f"<0x{b:02X}>"), model["unk"]) for b in range(256)])
        self.raw = {i: b"" if kind == 3 else (" \u2047 " if kind == 2 else p).encode() for i, (p, _, kind) in enumerate(model["pieces"])}
        self.raw.update({int(i): bytes([b]) for b, i in enumerate(self.byte) if i != model["unk"]})
        self.longest = max(len(p) for _, p, _ in normal)
        self.chars = np.array([len(p) for p in self.text], dtype=np.int64)
        self.score = np.array([s for _, s, _ in model["pieces"]], dtype=np.float64)
        self.floor = self.score[[i for i, _, _ in normal]].min() - 10.0
        self.cache: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"": ({}, {}), SPACE: ({}, {})}
        if model["bpe"]:
            normal = self._merges(normal)
        keys, ids = [], []
        for size in range(1, self.longest + 1):
            same = [(i, p) for i, p, _ in normal if len(p) == size]
            if same:
                codes = np.array([[ord(c) for c in p] for _, p in same], dtype=np.int64)
                keys.append(_hash(codes))
                ids.append(np.array([i for i, _ in same]))
        self.table = Table(np.concatenate(keys), np.concatenate(ids))

    def _merges(self, normal: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
        """Learn each piece's rank, the two pieces it is merged from, and the rank of each pair that
        merges. Returns the pieces that merging can produce."""
        n = len(self.text)
        ids = {p: i for i, p, _ in normal}
        scores = {s: r for r, s in enumerate(sorted({s for _, _, s in normal}, reverse=True), 1)}
        ranks = {p: scores[s] for _, p, s in normal if len(p) > 1}
        self.plain = ranks, ids
        self.rank = np.zeros(n, dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        made = []
        for i, p, s in normal:
            parts = list(p)
            while len(parts) > 2:
                best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 1 or len(parts) == 2 and all(x in ids for x in parts):
                made.append((i, p, s))
            if len(parts) == 2 and all(x in ids for x in parts):
                self.rank[i], self.left[i], self.right[i] = ranks[p], ids[parts[0]], ids[parts[1]]
        # any two pieces that together are a piece merge, whichever way that piece itself came about
        pairs = {ids[p[:k]] * n + ids[p[k:]]: ranks[p] for p in ranks for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = Table(np.array(list(pairs), dtype=U64) * _BASE, np.array(list(pairs.values()), dtype=np.int64))
        self.size = n
        self.memo = np.full(1 << MEMO, -1, dtype=np.int64)
        return made

    def unmerged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves neighbours a, b apart: no pair along their border merges before
        the merges that made its parts have used them up."""
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), LEFT_ALONE)
        while len(live):
            together = self.pairs.get((a * self.size + b).astype(U64) * _BASE)
            # limit is twice a rank, plus 1 where the later merge lies to the right, which the left pair precedes
            clash = (together >= 0) & (2 * together < limit)
            out[live[clash]] = False
            go = ~clash
            live, a, b = live[go], a[go], b[go]
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb  # undo the later merge: the left piece's when it is strictly later
            done = (ra == 0) & (rb == 0)
            limit = np.where(first, 2 * ra, 2 * rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """unmerged(a, b), by a table of MEMO slots for the pairs met lately; words have few different ones."""
        pair = a * self.size + b
        slot = (pair.astype(U64) * _BASE >> U64(64 - MEMO)).astype(np.int64)
        known = self.memo[slot]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            out[new] = self.unmerged(a[new], b[new])
            self.memo[slot[new]] = pair[new] << 1 | out[new]
        return out

    def _best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (last first, -1 padded) of words of one length, one row each; and their number."""
        n, size = codes.shape
        last = np.full((size + 1, n), -1, dtype=np.int64)  # piece that ends here; -1: an unknown character
        back = np.zeros((size + 1, n), dtype=np.int32)
        total = np.full((size + 1, n), -np.inf)
        total[0] = 0.0
        for end in range(1, size + 1):
            width = min(end, self.longest)
            h = np.full(n, 0x243F6A8885A308D3, dtype=U64)
            hashes = np.empty((width, n), dtype=U64)
            for k in range(width):  # row k: the substrings of k + 1 characters
                h = _extend(h, codes[:, end - 1 - k])
                h ^= h >> U64(29)
                hashes[k] = h
            # only substrings that begin where a path ends are looked up
            open_ = np.flatnonzero((total[end - width : end][::-1] > -np.inf).ravel())
            piece = self.table.get(hashes.ravel()[open_])
            hit = piece >= 0
            lone = open_[~hit & (open_ < n)]
            k, row = np.divmod(open_[hit], n)
            start, found = end - 1 - k, piece[hit]
            if self.model["bpe"]:
                before = np.where(start > 0, last[start, row], -1)
                ok = np.ones(len(row), dtype=bool)
                test = np.flatnonzero(before >= 0)
                ok[test] = self.apart(before[test], found[test])
                k, row, start, found = k[ok], row[ok], start[ok], found[ok]
            gain = total[start, row] + (k + 1 if self.model["bpe"] else self.score[found])
            total[end, lone] = total[end - 1, lone] + self.floor
            last[end, lone], back[end, lone] = -1 - codes[lone, end - 1], 1
            np.maximum.at(total[end], row, gain)
            best = gain >= total[end, row]
            last[end, row[best]], back[end, row[best]] = found[best], k[best] + 1
        out = np.zeros((size, n), dtype=np.int64)
        at, count = np.full(n, size), np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        while len(rows):
            out[count[rows], rows] = last[at[rows], rows]
            count[rows] += 1
            at[rows] -= back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out.T, count

    def _merged(self, word: str) -> list[int]:
        """Byte-pair merging as it is defined: the pair of the best rank first, the leftmost of equal ones."""
        ranks, ids = self.plain
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[a + b], i, a + b) for i, (a, b) in enumerate(zip(word, word[1:])) if a + b in ranks]
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            j = after[i]
            if parts[i] is None or j == n or parts[i] + parts[j] != piece:
                continue  # one of the two has been merged since
            parts[i], parts[j] = piece, None
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if piece + parts[k] in ranks:
                    heappush(heap, (ranks[piece + parts[k]], i, piece + parts[k]))
            if h >= 0 and parts[h] + piece in ranks:
                heappush(heap, (ranks[parts[h] + piece], h, parts[h] + piece))
        return [i for x in parts if x is not None for i in ([ids[x]] if x in ids else self._fallback(x))]

    def _in_blocks(self, word: str) -> list[int] | None:
        """Ids of a long word by blocks; None when two neighbours have no admissible border in their overlap."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        n = len(codes)
        begins = [max(0, k - LAP) for k in range(0, n, BLOCK)]
        ends = [min(n, b + BLOCK + (2 * LAP if b else LAP)) for b in begins]
        paths: list[tuple[np.ndarray, np.ndarray]] = []  # borders and the pieces that begin there
        size = BLOCK + 2 * LAP
        whole = [k for k in range(len(begins)) if ends[k] - begins[k] == size]
        found: dict[int, np.ndarray] = {}
        for low in range(0, len(whole), 256):
            part = whole[low : low + 256]
            pieces, count = self._best(np.stack([codes[begins[k] : ends[k]] for k in part]))
            found.update((k, pieces[r, : count[r]][::-1].copy()) for r, k in enumerate(part))
        for k in range(len(begins)):
            if k not in found:
                pieces, count = self._best(codes[None, begins[k] : ends[k]])
                found[k] = pieces[0, : count[0]][::-1]
            length = np.where(found[k] >= 0, self.chars[np.maximum(found[k], 0)], 1)
            paths.append((begins[k] + np.cumsum(length) - length, found[k]))
        out, start = [], 0
        for k, (at, pieces) in enumerate(paths):
            if k + 1 == len(paths):
                out.append(pieces[at >= start])
                break
            following, later = paths[k + 1]
            borders = np.intersect1d(at[at > start], following[following > following[0]])
            if not len(borders):
                return None
            a = pieces[np.searchsorted(at, borders) - 1]
            b = later[np.searchsorted(following, borders)]
            fits = (a < 0) | (b < 0)
            test = np.flatnonzero(~fits)
            fits[test] = self.unmerged(a[test], b[test])
            borders = borders[fits]
            if not len(borders):
                return None
            cut = int(borders[np.abs(borders - (begins[k + 1] + LAP)).argmin()])
            out.append(pieces[(at >= start) & (at < cut)])
            start = cut
        return [y for x in np.concatenate(out).tolist() for y in ([x] if x >= 0 else self._fallback(chr(-1 - x)))]

    def _fallback(self, char: str) -> list[int]:
        return self.byte[list(char.encode("utf-8", "surrogatepass"))].tolist()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        out = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if self.model["bpe"] and (w.startswith(SPACE * 2) or len(w) > LONG):
                ids = None if w.startswith(SPACE * 2) else self._in_blocks(w)
                out[i] = np.array(self._merged(w) if ids is None else ids, dtype="<i4").tobytes()
            else:
                by_size.setdefault(len(w), []).append(i)
        for size, members in by_size.items():
            step = max(1, (1 << 18) // (size + 1))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), size).astype(np.int64)
                pieces, count = self._best(codes)
                used = np.arange(size)[::-1] < count[:, None]
                flat = pieces[:, ::-1][used]
                blob, ends = flat.astype("<i4").tobytes(), (np.cumsum(count) * 4).tolist()
                begin = 0
                for i, end in zip(part, ends):
                    out[i] = blob[begin:end]
                    begin = end
                for r in np.flatnonzero((pieces < 0).any(axis=1)):
                    ids = [y for x in pieces[r, : count[r]][::-1].tolist() for y in ([x] if x >= 0 else self._fallback(chr(-1 - x)))]
                    out[part[r]] = np.array(ids, dtype="<i4").tobytes()
        return out

    def _split(self, text: str | None) -> tuple[str, list[str]]:
        """What each word of the text lacks in front, and the words."""
        if not text:
            return "", []
        if self.model["prefix"] and SPACE not in text and "  " not in text and text[0] != " ":
            return SPACE, text.split(" ")
        return "", _WORD.findall((" " * self.model["prefix"] + text).replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self._split(t) for t in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        for front in ("", SPACE):
            young, old = self.cache[front]
            if len(young) > CACHE_WORDS:
                young, old = {}, young
                self.cache[front] = young, old
            mine = [i for i, (f, _) in enumerate(split) if f == front]
            wanted = {w for i in mine for w in split[i][1]}.difference(young)
            known = wanted.intersection(old)
            young.update((w, old[w]) for w in known)
            unseen = list(wanted.difference(known))
            young.update(zip(unseen, self.encode_words([front + w for w in unseen])))
            for i in mine:
                out[i] = np.frombuffer(b"".join([young[w] for w in split[i][1]]), dtype="<i4")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of the ids; invalid byte sequences become U+FFFD."""
        out = []
        for x in ids:
            t = b"".join([self.raw[i] for i in x.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
            out.append(t[1:] if self.model["prefix"] and t[:1] == " " else t)
        return out


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The codec of a broadcast (key, model). A worker keeps the last one, with its bounded cache of words, for later tasks."""
    key, model = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _model(docs: DataFrame, path: str):
    """The model (its file bounds the size) and a key that names it, as a broadcast."""
    scratch.bounded_batches(docs.sparkSession)
    model = load(path)
    return docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(model).encode()).hexdigest(), model))


def _parts(texts: list, limit: int = 1 << 21) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` array<int>, in place of one of that name; the text column stays."""
    docs = docs.drop(ids)
    shared = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            found = [x for part in _parts(batch.column(text).to_pylist()) for x in codec.encode(part)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names, ids])

    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType()))])
    return docs.mapInArrow(scratch.lean(run), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column ``decoded``, in place of one of that name; null ids decode to an empty text."""
    docs = docs.drop(text)
    shared = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            found = codec.decode([np.asarray(x if x is not None else [], dtype=np.int64) for x in batch.column(ids).to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return docs.mapInArrow(scratch.lean(run), StructType([*docs.schema.fields, StructField(text, StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 and
    round_trip of every row: encoded, then decoded, in one pass, so no ids travel between processes."""
    shared = _model(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            rows = []
            for part in _parts(batch.column("text").to_pylist()):
                found = codec.encode(part)
                for t, x, back in zip(part, found, codec.decode(found)):
                    sha = lambda b: hashlib.sha256(b).hexdigest()
                    rows.append((len(t or ""), len(x), sha(x.astype("<i4").tobytes()), sha(back.encode("utf-8", "replace")), back == (t or "")))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_chars", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scratch.lean(run), f"doc_id {kind}, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
