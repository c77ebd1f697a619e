"""A corpus pipeline of five stages, each over what the stage before it kept: quality rules, near-duplicates, personal data, source weights, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, mixing, neardup, pii, quality
from marlstone.llm._common import Scratch
from marlstone.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep."""
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id."""
    return neardup.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars counted anew."""
    return pii.redact_documents(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of source weights takes it."""
    return mixing.mix_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the number of tokens and the digests of ids and decoded text of each document."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_pii),
    ("source mixing", mix_sources),
    ("byte pair encoding", encode_bpe),
]

#: SQL cannot express the personal-data field, the dependent rounding or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again, and then goes."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            kept = Scratch(spark)
            docs = kept.table(docs, f"stage{k}")
            if held:
                held.drop()
            held = kept
    return docs
