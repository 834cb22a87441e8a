"""Media columns: interleaved document sequences.

HTML is parsed into ordered elements, texts and media references, each with its position and, for
media, its caption (figcaption, else alt). References name payloads by digest (``digest:<hex>``); a
join on the digest resolves them, and page numbers and positions keep text, media and captions aligned. Only
elements that name a digest are joined, so texts are not shuffled by it.

Payloads are stored as binary PGM images, 24 samples a row, 8 bits each: lossless, and self-describing.
The payload is the UTF-8 text with bytes 255 appended up to a positive multiple of 576.

Nulls: a null text is empty (its payload is 576 bytes 255), null html has no elements. A digest without a stored
payload leaves the media columns null. Equal payloads may be stored more than once, in different
tasks; the resolving table has one row per digest. Repeated rows are pages of their own; very long pages are parsed
whole, one at a time; an empty table has no sequences. Extra columns are not read, apart from the key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm import scratch

UNIT, WIDTH, FILL = 576, 24, 255
MEDIA = ("img", "video", "audio", "source", "embed")
BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table section article header footer nav figure figcaption blockquote pre hr title".split())
SILENT = frozenset(("script", "style", "template"))


class _Sequence(HTMLParser):
    """Collects [kind, text, reference, caption] in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.words: list[str] = []
        self.figure: list[int] = []
        self.caption: list[str] | None = None
        self.silent = 0

    def _flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS:
            self._flush()
        if tag == "figure":
            self.figure = [len(self.out)]
        if tag == "figcaption":
            self.caption = []
        if tag in MEDIA:
            values = dict(attrs)
            if values.get("src"):
                self._flush()
                self.out.append(["media", None, values["src"], values.get("alt") or None])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split()) or None
            for e in self.out[self.figure[0] if self.figure else len(self.out) :]:
                if e[0] == "media" and text:
                    e[3] = text
            self.caption = None
        if tag in BLOCKS:
            self._flush()
        if tag == "figure":
            self.figure = []

    def handle_data(self, data):
        if self.silent:
            return
        (self.words if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[list]:
    """Ordered [kind, text, reference, caption] of a page."""
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser._flush()
    return parser.out


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, page (a number of the row, so that rows with one key stay apart), position (from 0), kind, text, reference,
    digest (of digest: references) and caption. Write it before use: pages are numbered as tasks read them."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [elements(x) for x in batch.column(html).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [e for f in found for e in f]
            columns = [pa.array([e[i] for e in flat], pa.string()) for i in range(4)]
            place = pa.array([i for f in found for i in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at, pa.int64())), pa.array(number + at, pa.int64()), place, *columns], [key, "page", "position", "kind", "text", "reference", "caption"]
            )
            number += len(found)

    scratch.bounded_batches(pages.sparkSession)
    out = pages.select(key, html).mapInArrow(scratch.lean(run), f"{key} {kind}, page long, position int, kind string, text string, reference string, caption string")
    return out.withColumn("digest", F.regexp_extract("reference", "^digest:([0-9a-f]{64})$", 1)).withColumn("digest", F.when(F.col("digest") != "", F.col("digest")))


def payload(text: Column) -> Column:
    """UTF-8 of the text (null: empty), filled with bytes 255 to a positive multiple of 576."""
    utf8 = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(utf8)
    fill = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(utf8, F.unhex(F.repeat(F.lit("FF"), fill)))


def to_image(data: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def from_image(stored: bytes) -> tuple[int, int, bytes]:
    magic, size, most, data = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(data) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return width, height, data


def store(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """digest and media (the stored form) of payloads; a task stores each digest among its latest once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, stored = [], []
            for data in batch.column(column).to_pylist():
                digest = hashlib.sha256(data)
                if digest.digest() in seen:
                    continue
                if len(seen) >= 1 << 18:  # memory bound; a payload stored twice resolves as well
                    seen.clear()
                seen.add(digest.digest())
                digests.append(digest.hexdigest())
                stored.append(to_image(data))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(stored, pa.binary())], ["digest", "media"])

    scratch.bounded_batches(payloads.sparkSession)
    return payloads.select(column).mapInArrow(scratch.lean(run), "digest string, media binary")


def feature(width: int, height: int, data: bytes) -> str:
    """Size, mean, deviation, entropy, and a 64-bit hash of which of 8 x 8 blocks are lighter than the mean."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width)
    counts = np.bincount(x.ravel(), minlength=256)
    total = int(counts.sum())
    levels = np.arange(256)
    mean = float((counts * levels).sum()) / total
    deviation = (float((counts * levels**2).sum()) / total - mean**2) ** 0.5
    p = counts[counts > 0] / total
    rows = np.add.reduceat(x, np.arange(8) * height // 8, axis=0, dtype=np.int64)
    blocks = np.add.reduceat(rows, np.arange(8) * width // 8, axis=1)
    sizes = np.diff(np.append(np.arange(8) * height // 8, height))[:, None] * np.diff(np.append(np.arange(8) * width // 8, width))[None, :]
    bits = int("".join("1" if b else "0" for b in (blocks > mean * sizes).ravel()), 2)
    return f"{width}x{height}:{mean:.4f}:{deviation:.4f}:{-(p * np.log2(p)).sum():.4f}:{bits:016x}"


FEATURES = "digest string, content_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """FEATURES of every stored payload, from the stored bytes alone. content_bytes: without the filling; UTF-8 has no byte 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                width, height, data = from_image(stored)
                rows.append((digest, len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(width, height, data)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FEATURES.split(", ")])

    return media.mapInArrow(scratch.lean(run), FEATURES)


def resolve(sequence: DataFrame, features: DataFrame) -> DataFrame:
    """``sequence`` (a written table) with the features of the payload that each element's digest names."""
    fields = [f.split() for f in FEATURES.split(", ")][1:]
    # written, so that the join's sides are plain shuffles, of which adaptive execution splits a hot digest's
    one = scratch.cut(features.groupBy("digest").agg(*(F.min(n).alias(n) for n, _ in fields)).withColumnRenamed("digest", "_digest"), "payloads")
    named = sequence.where("digest is not null").join(one, F.col("digest") == F.col("_digest"), "left").drop("_digest")
    return named.unionByName(sequence.where("digest is null").select("*", *(F.lit(None).cast(kind).alias(n) for n, kind in fields)))


def sequences(resolved: DataFrame, key: str = "page_id") -> DataFrame:
    """key, page and its elements as one array of structs, in order of position."""
    columns = [c for c in resolved.columns if c not in (key, "page")]
    ordered = ["position", *(c for c in columns if c != "position")]
    return resolved.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("elements"))


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """doc_id and html: the first half of the text, a figure that names the whole text's payload by digest, and the second half."""
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("<article><p>"), _escaped(F.substring(text, F.lit(1), half)), F.lit('</p><figure><img src="digest:'), F.sha2(payload(F.col("text")), 256),
            F.lit('"><figcaption>'), F.concat_ws(" ", F.lit("Document"), F.col("doc_id").cast("string")), F.lit("</figcaption></figure><p>"),
            _escaped(F.substring(text, half + 1, F.char_length(text))), F.lit("</p></article>"),
        ).alias("html"),
    )
