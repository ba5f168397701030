"""The registered query of each corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, capfilters, codes, divergence, licenses, lines, neardup, neighbours, packing, quality, repetition, secrets
from .common import table

WORDS = "word_bpe_49k.json"


def op1_suffix_array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document without later copies of runs of lines of 50 words or more.

    The limit of 50 words is a parameter of ``lines.dedup``; shorter runs stay.  A
    null text stays null, and a text of which nothing is left is empty.
    """
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, by inner product.

    Vectors that are null, zero, or hold null or non-finite components take no
    part; ties go to the smaller id; an empty table gives no rows.
    """
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_spherical_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of each vector among those of its label, at cosine 0.98.

    Rows without a label and vectors that are null, zero or not finite link with
    nothing and stay as their own component; repeated vectors link with each other.
    """
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page through an ARC record to a WARC record and back.

    A null payload is empty, and equal payloads of any length share one response.
    """
    return archives.round_trip(table(spark, sf_dir, "pages"))


def op5_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the decoded text; a null text is empty."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op6_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of each document; a null text has no words, and its places are null."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from the rows outside the held-out third; empty and null texts are scored too."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document; a null text is alone, equal texts are one."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens; a null or empty text is its end token."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document with those that one source alone carries; a null text has none."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_length_bucketed_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each source of a language to each other one, and its most over-used terms; null columns count as ''."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_member_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of each vector, its error and that of its label; null and non-finite vectors take no part."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated lines and n-grams cover of each document, and whether the rules keep it; a null text has no words."""
    return repetition.judged(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_suffix_array_lines,
        op2_adaptive_dimension_scan,
        op3_spherical_cap_filters,
        op4_legacy_archives,
        op5_forced_boundary_bpe,
        op6_rare_token_licenses,
        op7_rule_ensemble_quality,
        op8_order_minhash,
        op9_harmonic_packing,
        op10_ownership_secrets,
        op11_length_bucketed_divergence,
        op12_member_resident_lloyd,
        op13_repetition_coverage,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_length_bucketed_divergence": divergence.twin(),
        "op12_member_resident_lloyd": codes.twin(),
        "op13_repetition_coverage": repetition.twin(),
    }
