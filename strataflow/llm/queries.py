"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import jaccard, langid, media, mixing, pieces, quality, scratch, secrets, sharding, suffixes, warc

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *(count(k) for k in secrets.KINDS), F.sha2(secrets.notation(base), 256).alias("base_sha256"), secrets.notation(F.col("secrets")).alias("spans")
    )


def op2_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    stored = scratch.cut(media.store(docs.select(media.payload(F.col("text")).alias("payload"))), "media", codec="zstd")
    elements = media.interleave(media.documents_as_pages(docs), "doc_id")
    # the result has digests of the texts, so these alone are written and shuffled
    elements = scratch.cut(elements.withColumn("text", F.sha2("text", 256)), "elements", codec="zstd")
    pages = media.sequences(media.resolve(elements, media.read_back(stored)), "doc_id")
    kind = lambda k: F.filter("elements", lambda e: e["kind"] == k)
    named = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
    return pages.withColumn("m", kind("media")[0]).select(
        "doc_id", F.col("m.content_bytes").alias("n_bytes"), *(F.col(f"m.{c}").alias(c) for c in named), F.size("elements").alias("n_elements"),
        F.transform(kind("text"), lambda e: e["text"]).alias("texts_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 8)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = scratch.cut(mixing.sized(docs), "sizes", files=scratch.tasks(docs))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_media_sequences, op3_jaccard_join, op4_jump_sharding, op5_quality_rules,
        op6_warc_revisits, op7_language_id, op8_suffix_dedup, op9_source_mixing, op10_sentencepiece,
    )
}
#: Only what SQL can express whole: hashes, models and digests of other engines leave the rest to brute-force tests.
ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') a from documents),
        s as (select doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')]
              else list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) end) g from w),
        c as (select doc_id, count(*) n from s group by 1),
        p as (select x.doc_id a, y.doc_id b, count(*) i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
        e as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
        r as (select doc_id d, doc_id o from documents union select e.b, r.o from r join e on e.a = r.d)
        select d.doc_id, coalesce(n, 0) n_shingles, o component_id from documents d left join c using (doc_id) join (select d, min(o) o from r group by 1) m on m.d = d.doc_id""",
    "op6_warc_revisits": """
        with p as (select page_id, coalesce(html, '') h from pages), q as (select page_id, strlen(h) n, sha256(h) s from p),
        f as (select s, min(page_id) f from q where n >= 100 group by 1)
        select page_id, n payload_bytes, q.s payload_digest, case when f is null or f = page_id then 'response' else 'revisit' end record_type,
        case when f <> page_id then f end refers_to from q left join f on q.s = f.s and n >= 100""",
}
