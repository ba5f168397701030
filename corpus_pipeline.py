"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashlark.llm import lines, neardup, packing, quality, secrets
from cashlark.llm.common import table
from cashlark.sources.scratch import discard, made, scratch

WORDS = "word_bpe_49k.json"


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; every document stays."""
    return _counted(lines.dedup(docs).select(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced by a mask; every document stays."""
    return _counted(secrets.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", delete_repeated_lines),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: SQL cannot fit the classifier, rank suffixes or tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    What a stage wrote on its way is deleted when its own result is written, and
    that result when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        before = made()
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, [p for p in made() if p not in before and p != path] + list(last))
        docs, last = spark.read.parquet(path), (path,)
    return docs
