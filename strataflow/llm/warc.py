"""WARC archives with revisit records.

Headers (page_id, url, digest, length) are made first and shuffled by payload digest, pre-aggregated, so a digest that
a third of the pages shares is one row per task. Digests seen more than once are joined back to the headers: those are
the revisits, narrow rows. Payloads stay where they are: pages that are no revisits are written as they are read. Only when
the revisits are too many to broadcast, payloads of pages that a bitmap of them holds are shuffled for the exact answer.

Archives are files ``*.warc.gz`` of WARC/1.1 records with fresh headers, one gzip member each, in a folder that driver and
executors share. Every attempt of a task writes files of its own names, and an index table (archive, at, length, records),
written by Spark's committer, says which count: an executor's loss leaves at most files that no index names.
Reading takes the files' byte ranges from the index, parses the members, hashes what they hold, and joins revisit
records to responses.

Rules: of records with equal payloads of ``least`` bytes or more, those of the smallest page_id are
responses and the others revisits; smaller payloads are always responses. Nulls: a null html is an
empty payload, a null url an empty target, a null page_id is never the smallest (alone with its payload it is a
response). Repeated rows of the smallest page_id are all responses. Control characters and spaces in urls are
percent-encoded, so a url cannot forge headers. Very long pages are one record each, in memory one at a time. An
empty table gives no archives. Extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm import bitmap, scratch

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 1 << 28
#: an index row covers about so many bytes of an archive; a reading task takes RANGES of them
RANGE_BYTES, RANGES = 1 << 22, 16
FEED = 1 << 15
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _rows(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, digest and refers_to of the pages that repeat an earlier payload; from headers alone."""
    headers = scratch.cut(_rows(pages).select("page_id", "url", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least).drop("n"), "headers")
    firsts = headers.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1 and refers_to is not null").drop("_n")
    firsts = scratch.broadcast_if_small(scratch.cut(firsts, "firsts"))
    found = headers.join(firsts, F.col("digest") == F.col("_digest")).where(~F.col("refers_to").eqNullSafe(F.col("page_id")))
    return found.select("page_id", "url", "digest", "refers_to")


def responses(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """page_id, url, payload and digest of the pages that are not among ``repeated``, a written table of revisits()."""
    rows = _rows(pages)
    gone = repeated.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"))
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    hinted = scratch.broadcast_if_small(gone)
    if hinted is not gone:
        return rows.join(hinted, same, "left_anti")
    bits = rows.sparkSession.sparkContext.broadcast(bitmap.build(gone.select(F.xxhash64("_page", "_digest").alias("k")), "k"))
    keyed = rows.withColumn("_k", F.xxhash64("page_id", "digest"))

    def held(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bitmap.contains(bits.value, np.asarray(batch.column("_k"))) == wanted))

        return keyed.mapInArrow(scratch.lean(run), keyed.schema).drop("_k")

    return held(False).unionByName(held(True).join(gone, same, "left_anti"))


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str = DATE) -> bytes:
    """One record, uncompressed."""
    target = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: strataflow\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


INDEX = "archive string, at long, length long, records long"


def _written(rows: DataFrame, kind: str, folder: str) -> DataFrame:
    """INDEX of the archives that hold one record of each row; ``kind``: response or revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        task, out, at = TaskContext.get().partitionId(), None, 0
        begun = count = 0
        path, index = "", []

        def mark() -> None:
            nonlocal begun, count
            if at > begun:
                index.append({"archive": path, "at": begun, "length": at - begun, "records": count})
            begun, count = at, 0

        try:
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            mark()
                            out.close()
                        path = f"{base}/{kind}-{task:06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, begun = store.open_output_stream(path, compression=None), 0, 0
                        at += out.write(gzip.compress(_info(path.rsplit("/", 1)[-1]), 6, mtime=0))
                    x = {c: v[i].as_py() for c, v in columns.items()}
                    at += out.write(gzip.compress(record(x["page_id"], x["url"], x.get("payload", b""), x["digest"], kind, x.get("refers_to")), 6, mtime=0))
                    count += 1
                    if at - begun >= RANGE_BYTES:
                        mark()
        finally:
            if out is not None:
                mark()
                out.close()
        yield pa.RecordBatch.from_pylist(index, pa.schema([("archive", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("records", pa.int64())]))

    return rows.mapInArrow(scratch.lean(run), INDEX)


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write archives to ``folder`` (a URI or an absolute path that all executors share; a fresh one in the shared
    folder if none is given) and return their INDEX, a written table."""
    spark = pages.sparkSession
    scratch.bounded_batches(spark)
    folder = folder or f"{scratch.folder(spark)}/strataflow/warc-{uuid.uuid4().hex}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    repeated = scratch.cut(revisits(pages, least), "revisits")
    return scratch.cut(_written(responses(pages, repeated), "response", folder).unionByName(_written(repeated, "revisit", folder)).withColumn("folder", F.lit(folder)), "warc-index")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("stated", pa.string()), ("held_digest", pa.string()), ("held_bytes", pa.int64()), ("refers", pa.string())])


def members(data: bytes) -> Iterator[bytes]:
    """The uncompressed gzip members of a byte range, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            parts.append(one.decompress(view[at : at + FEED]))
            at = min(at + FEED, len(view))
        at -= len(one.unused_data)
        yield b"".join(parts)


def records(index: DataFrame) -> DataFrame:
    """Every response and revisit of the archives of an INDEX, with the digest and length of what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, length, folder in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length", "folder"))):
                rows = []
                with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
                    data = f.read_at(length, at)
                for member in members(data):
                    fields, block = parse(member)
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    held = block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else None
                    page = fields.get("x-page-id")
                    rows.append({
                        "record_id": fields["warc-record-id"], "page_id": None if page is None else int(page), "record_type": fields["warc-type"],
                        "stated": fields["warc-payload-digest"].removeprefix("sha256:"), "held_digest": None if held is None else hashlib.sha256(held).hexdigest(),
                        "held_bytes": None if held is None else len(held), "refers": fields.get("warc-refers-to"),
                    })
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    # ranges are few small rows that stand for much work, so tasks are dealt by their number
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // RANGES))
    return index.repartition(tasks).mapInArrow(scratch.lean(run), "record_id string, page_id long, record_type string, stated string, held_digest string, held_bytes long, refers string")


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, revisits joined to originals."""
    r = scratch.cut(records(index), "records")
    again = r.where("record_type = 'revisit'")
    wanted = scratch.broadcast_if_small(scratch.cut(again.select(F.col("refers").alias("_id")).distinct(), "wanted", narrow=True))
    originals = r.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("_id"), "left_semi").groupBy(F.col("record_id").alias("_id")).agg(
        F.min("page_id").alias("_page"), F.min("held_digest").alias("_digest"), F.min("held_bytes").alias("_bytes")
    )
    originals = scratch.broadcast_if_small(scratch.cut(originals, "originals"))
    both = again.join(originals, (F.col("refers") == F.col("_id")) & (F.col("stated") == F.col("_digest")), "left")
    found = both.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    kept = r.where("record_type = 'response'").select("page_id", F.col("held_bytes").alias("payload_bytes"), F.col("held_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return kept.unionByName(found)
