import hashlib
import zlib

from hypothesis import given
from hypothesis import strategies as st

from strataflow.llm import media, scratch
from strataflow.llm.queries import op2_media_sequences
from tests.llm import util

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="<p>";</script></head><body><p>One &amp; two</p>
<figure><img src="digest:{0}" alt="x"><figcaption>First <b>caption</b></figcaption></figure><p>mid</p><img src="http://a/b.png" alt="Alt"/><img alt="no source">
<video src="digest:{1}"></video> tail</body></html>""".replace("{0}", "a" * 64).replace("{1}", "b" * 64)


def test_sequences_keep_order_and_captions():
    assert media.elements(PAGE) == [
        ["text", "T", None, None], ["text", "One & two", None, None], ["media", None, "digest:" + "a" * 64, "First caption"], ["text", "mid", None, None],
        ["media", None, "http://a/b.png", "Alt"], ["media", None, "digest:" + "b" * 64, None], ["text", "tail", None, None],
    ]
    assert media.elements(None) == [] and media.elements("") == [] and media.elements("a < b & <p") != []


@given(st.binary(min_size=1, max_size=2000))
def test_images_round_trip(data):
    data = data + b"\xff" * (-len(data) % media.UNIT)
    width, height, back = media.from_image(media.to_image(data))
    assert back == data and width * height == len(data)
    assert media.feature(width, height, data) == media.feature(width, height, bytes(bytearray(data)))


def test_query_equals_brute_force(spark, tmp_path):
    rows = util.edge_rows(2, 50) + [(5000, "x" * 576, "en", "a"), (5001, "x" * 577, "en", "a"), (5002, "é" * 288, "en", "a"), (5003, "a\nb\n", "en", "a"), (5004, "1 < 2 && <b>3</b> &amp; <!-- x --> &lt; \r\n<script>", "en", "a"), (None, "no id", "en", "a")]
    rows += [(5001, "x" * 577, "en", "a"), (5005, "a < b " * 300_000, "en", "a")]
    util.documents(spark, rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_media_sequences(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    features = {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = media.to_image(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert features.setdefault(data, r.feature) == r.feature
        text = texts[r.doc_id] or ""
        halves = [" ".join(h.split()) for h in (text[: len(text) // 2], text[len(text) // 2 :])]
        assert r.texts_sha256 == [hashlib.sha256(h.encode()).hexdigest() for h in halves if h]
        assert (r.position, r.n_elements, r.caption) == (1 if halves[0] else 0, 1 + sum(map(bool, halves)), "Document" if r.doc_id is None else f"Document {r.doc_id}")


def test_pages_resolve_by_digest(spark):
    data = b"abc" + b"\xff" * 573
    digest = hashlib.sha256(data).hexdigest()
    pages = spark.createDataFrame([(1, f'<p>a</p><img src="digest:{digest}"><p>b</p>'), (2, '<img src="digest:' + "0" * 64 + '">'), (3, None)], "page_id long, html string")
    stored = media.read_back(media.store(spark.createDataFrame([(data,), (data,)], "payload binary")))
    written = scratch.cut(media.interleave(pages), "elements")
    out = {r.page_id: r.elements for r in media.sequences(media.resolve(written, stored)).collect()}
    assert [(e.position, e.kind, e.text, e.payload_bytes) for e in out[1]] == [(0, "text", "a", None), (1, "media", None, 576), (2, "text", "b", None)]
    assert [(e.kind, e.payload_bytes) for e in out[2]] == [("media", None)] and 3 not in out


def test_empty_table(spark, tmp_path):
    util.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert op2_media_sequences(spark, str(tmp_path)).collect() == []
