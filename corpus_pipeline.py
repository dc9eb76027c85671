"""Cleaning of a document corpus in five stages; each reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomrail.llm.byte_bpe import digest_documents
from loomrail.llm.common import new_folder
from loomrail.llm.language_id import in_known_language
from loomrail.llm.mixing import mixture
from loomrail.llm.simhash import keep_one
from loomrail.llm.suffix_dedup import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; the classifier is fitted on this stage's own input."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that stand anywhere else are cut out of the texts."""
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its target share of the words; rows repeat where a source is taken more than once."""
    return mixture(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded texts, a row for each row."""
    return digest_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The stages have hashes, suffix orders and trained models that SQL cannot express; tests hold each stage's operator, and the last rows of run(), against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
