"""From raw documents to token digests: rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postulant.llm import bpe, minhash, mixing, pii, quality_rules
from postulant.llm.common import table, written


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", apply_rules),
    ("minhash near-dedup", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing to target weights", mix_to_targets),
    ("byte-level bpe", encode),
]

# Signatures, term statistics and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
