"""The corpus pipeline: toxic documents out, recurring lines out, one document per near-duplicate group, sources mixed, tokens.

Nulls in any column, empty and very long texts, ties, repeated rows, an empty table and further columns of any name are handled as the
operators' docstrings say: rows with null or empty texts are clean, lose no line, are near copies of each other and take no part in the
mix; further columns go through all stages but the last, which returns doc_id, n_tokens, ids and the digest of the decoded ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import bpe, line_dedup, mixing, near_copies, simhash_dedup, toxicity
from lexispark.llm.common import documents, remove, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op3's fingerprints, block keys, pivot tables and distances find its components; the exact similarity of sets checks them, and edited copies beyond its radius."""
    return simhash_dedup.keep_one(docs, near_copies.groups(docs, simhash_dedup.groups(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The stages learn, hash and encode in ways that SQL does not express; tests/llm holds each of them against plain code, and run() against the stages in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is written."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
