"""Differences between two large tables by checksums: only buckets of keys that differ are joined row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .joins import diff_read_models

LEAVES, FAN = 65_536, 64


def _leaf(keys: list[str], leaves: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def _row_hashes(keys: list[str], fields: list[str]) -> list[Column]:
    """Two hashes of a row; which columns are null is hashed too, as a null adds nothing to a hash."""
    known = [F.col(c).isNull() for c in fields]
    return [F.xxhash64(F.lit(seed), *[F.col(c) for c in [*keys, *fields]], *known) for seed in (1, 2)]


def leaf_sums(rows: DataFrame, keys: list[str], fields: list[str], leaves: int = LEAVES) -> DataFrame:
    """``leaf, n, x, s``: rows of each bucket of keys, and two checksums that do not depend on their order.

    These are what a table may store beside itself: at most ``leaves`` rows.
    """
    first, second = _row_hashes(keys, fields)
    return rows.groupBy(_leaf(keys, leaves).alias("leaf")).agg(
        F.count("*").alias("n"),
        F.bit_xor(first).alias("x"),
        F.sum(second.cast("decimal(38,0)")).alias("s"),
    )


def parents(sums: DataFrame, fan: int = FAN) -> DataFrame:
    """The level above: checksums of ``fan`` neighbouring buckets each."""
    return sums.groupBy(F.floor(F.col("leaf") / fan).cast("int").alias("leaf")).agg(
        F.sum("n").alias("n"),
        F.bit_xor("x").alias("x"),
        F.sum("s").alias("s"),
    )


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets of which the sums differ."""
    r = right.select("leaf", *[F.col(c).alias(f"r_{c}") for c in ("n", "x", "s")])
    same = F.lit(True)
    for c in ("n", "x", "s"):
        same &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return left.join(r, "leaf", "full_outer").where(~same).select("leaf")


def differing_leaves(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """As :func:`differing` over leaves, looking only below buckets of the level above that differ."""
    above = differing(parents(left, fan), parents(right, fan)).select(F.col("leaf").alias("above"))
    below = lambda sums: sums.join(above, F.floor(F.col("leaf") / fan).cast("int") == F.col("above"), "left_semi")
    return differing(below(left), below(right))


def diff(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    leaves: int = LEAVES,
    sums: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """As ``joins.diff_read_models``, which sees only rows of buckets that differ; equal sides are not joined at all.

    ``sums`` are the stored leaf sums of both sides, where they have been kept.
    """
    own = sums or (leaf_sums(left, keys, fields, leaves), leaf_sums(right, keys, fields, leaves))
    found = written(differing_leaves(*[written(s, "leaf-sums") for s in own]), "differing-leaves")
    if found.isEmpty():
        return diff_read_models(left.limit(0), right.limit(0), keys, fields)
    here = lambda rows: rows.withColumn("_leaf", _leaf(keys, leaves)).join(found.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").drop("_leaf")
    return diff_read_models(here(left), here(right), keys, fields)
