import gzip
import hashlib

from strataflow.llm import warc

BIG = "<p>" + "x" * 200 + "</p>"
ROWS = [
    (5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (3, "http://a/2", BIG), (1, "http://a/ b\r\nX: y", "small"), (2, "http://a/4", "small"), (4, "u", None), (6, "u", ""),
    (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49), (12, "u", "a\r\n\r\nb" * 60), (None, "u", "n" * 150),
]


def pages(spark, rows, tmp=None):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_archives_read_back(spark):
    index = warc.write(pages(spark, ROWS))
    got = sorted((tuple(r) for r in warc.read(index).collect()), key=str)
    assert got == expected(ROWS)
    assert sum(r.records for r in index.collect()) == len(ROWS)


def test_many_ranges_and_archives(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choice("abc <>\r\n") for _ in range(rng.choice([10, 99, 100, 5000, 40000]))) if i % 3 else BIG + str(i % 7)) for i in range(200)]
    monkeypatch.setattr(warc, "RANGE_BYTES", 5000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20000)
    index = warc.write(pages(spark, rows).repartition(2))
    assert index.count() > 20 and index.select("archive").distinct().count() > 5
    assert sorted((tuple(r) for r in warc.read(index).collect()), key=str) == expected(rows)


def test_more_revisits_than_a_broadcast_holds(spark, monkeypatch):
    from strataflow.llm import scratch

    monkeypatch.setattr(scratch, "broadcast_if_small", lambda df: df)
    assert sorted((tuple(r) for r in warc.read(warc.write(pages(spark, ROWS))).collect()), key=str) == expected(ROWS)


def test_members_of_a_range():
    parts = [b"", b"a" * 100_000, bytes(range(256)) * 500]
    assert list(warc.members(b"".join(gzip.compress(p) for p in parts))) == parts


def test_records_are_valid_and_headers_cannot_be_forged(spark, tmp_path):
    warc.write(pages(spark, ROWS), str(tmp_path))
    n = 0
    for f in tmp_path.iterdir():
        data = gzip.decompress(f.read_bytes())
        while data:
            fields, block = warc.parse(data)
            head = data.index(b"\r\n\r\n") + 4
            assert data[head + len(block) : head + len(block) + 4] == b"\r\n\r\n"
            data = data[head + len(block) + 4 :]
            if fields["warc-type"] != "warcinfo":
                n += 1
                assert "x" not in fields
            if fields["warc-type"] == "revisit":
                assert fields["warc-profile"] == warc.PROFILE and len(block) < 120
    assert n == len(ROWS)


def test_empty_table(spark):
    assert warc.read(warc.write(pages(spark, []))).collect() == []


def test_query_on_extra_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    from strataflow.llm.queries import op6_warc_revisits

    pages(spark, ROWS).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted((tuple(r) for r in op6_warc_revisits(spark, str(tmp_path)).collect()), key=str) == expected(ROWS)
