"""A corpus pipeline: five of the training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet to the shared folder and gives it, read again, to the next. Scan partitions that are far from full are read
together in a stage's last step, so that the next stage does not read very small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import jaccard, langid, mixing, pieces, scratch, secrets
from strataflow.llm.queries import TOKENIZER


def _packed(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.coalesce(scratch.tasks(docs, 1))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go."""
    return _packed(langid.known_language(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked ones."""
    return _packed(jaccard.keep_first(docs), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; all documents stay."""
    return _packed(secrets.redact_documents(docs), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out, so that sources meet their target weights."""
    sized = scratch.cut(mixing.sized(docs), "sizes", files=scratch.tasks(docs))
    cuts = scratch.cut(mixing.cuts(sized), "cuts", narrow=True)
    return _packed(mixing.apply_cuts(docs, cuts), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's piece ids."""
    return _packed(pieces.encode(docs, TOKENIZER), docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL expresses neither the language identification nor the encoding; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _written(spark, docs, sf_dir, name, stage)
    return docs


@scratch.tidy
def _written(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage) -> DataFrame:
    """A stage's rows, written; what the stage itself wrote to get there goes."""
    return scratch.cut(stage(spark, docs, sf_dir), name)
