"""Bloom filters as tables of bitmaps: which keys may have been seen, in a few bytes per key.

A filter is one row, ``bucket`` and ``bitmap`` of 32,768 bits, per bucket that holds
any key; all bits of a key lie in one bucket.  So a filter is built, merged and
asked by joins and aggregates on buckets, and no task and no driver holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bucket, and how many a key sets; with 32 bits a key, some 6 of a million unseen keys are taken for seen.
BUCKET_BITS, HASHES, BITS_PER_KEY = 32_768, 8, 32


def buckets_for(keys: int) -> int:
    """How many buckets a filter of so many keys should have."""
    return max(1, -(-keys * BITS_PER_KEY // BUCKET_BITS))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), F.col(key)), F.lit(buckets)).alias("bucket")


def _bits(key: str) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(BUCKET_BITS)) for i in range(1, HASHES + 1)])


def build(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The filter of the known keys of a column."""
    known = keys.where(F.col(key).isNotNull()).select(_bucket(key, buckets), F.explode(_bits(key)).alias("bit"))
    return known.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merged(filters: DataFrame) -> DataFrame:
    """One filter of several with as many buckets."""
    return filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def maybe_seen(rows: DataFrame, key: str, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct keys of ``rows`` that a filter may hold; one that it holds is never missing."""
    asked = rows.select(key).where(F.col(key).isNotNull()).distinct().select(key, _bucket(key, buckets))
    byte = lambda bit: F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda bit: F.getbit(byte(bit), (bit % 8).cast("int")) == 1
    return asked.join(merged(filters), "bucket").where(F.forall(_bits(key), is_set)).select(key)
