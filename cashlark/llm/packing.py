"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are partitioned into classes: class ``k`` holds pieces of which ``k`` and
no more fit a sequence, and every full sequence of the class takes exactly ``k``.
Documents are first cut into whole sequences.  What is left of a document is then

- with ``whole=False`` cut into the largest sizes ``capacity // k`` that fit, so
  that a piece always fills its slot and a sequence is short by fewer than ``k``
  tokens: hardly any padding, several pieces a document;
- with ``whole=True`` one piece of the class of its length, so that no document
  of up to a sequence is cut, at the price of padding (a piece of class ``k`` can
  be little longer than ``capacity / (k + 1)``).

Workers number the pieces of each class on their own; one small table of counts
by worker and class turns these numbers into sequence ids and offsets, so no
piece meets another one.  What remains of each class, fewer pieces than one
sequence takes, is at most about ``capacity * log(capacity)`` pieces in all,
whatever the corpus; these are packed best-fit in one task.

Null and empty texts are one piece that holds only the end token.  Repeated rows
and null ids are packed like any others; other columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .bpe import encoded
from .common import arrow_batches, written


@lru_cache(1 << 14)
def cut_sizes(rest: int, capacity: int) -> tuple[int, ...]:
    """The class sizes that a remainder below ``capacity`` is cut into, largest first."""
    sizes = []
    while rest:
        k = capacity // rest
        size = capacity // k if capacity // k == rest else capacity // (k + 1)
        sizes.append(size)
        rest -= size
    return tuple(sizes)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_token: int, key: str, text: str, whole: bool = False) -> DataFrame:
    """Every piece with its class, its worker and its number among that worker's pieces of the class."""
    arrow_batches(docs.sparkSession)
    long = T.LongType()
    schema = T.StructType(
        [docs.schema[key], *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "fits", "worker", "nth"))]
    )

    def run(batches):
        counts, worker = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, out = [], []
            for row, ids in encoded(batch, text, tokenizer):
                ids = np.append(ids, end_token).astype("<u4")
                start, rest = 0, len(ids) % capacity
                ends = ((rest,) if rest else ()) if whole else cut_sizes(rest, capacity)
                for size in (*[capacity] * (len(ids) // capacity), *ends):
                    fits = capacity // size
                    rows.append(row)
                    out.append((start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids), fits, worker, counts[fits]))
                    counts[fits] += 1
                    start += size
            columns = np.array(out, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array(c) for c in columns)],
                schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)


def _best_fit(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "worker", "fits", "nth"], ascending=[False, True, True, True]).reset_index(drop=True)
        free: list[tuple[int, int]] = []  # room and number of each bin, least room first
        bins, offsets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        opened = 0
        for i, size in enumerate(rows["length"].tolist()):
            at = bisect_left(free, (size, -1))
            if at < len(free):
                room, b = free.pop(at)
            else:
                room, b, opened = capacity, opened, opened + 1
            bins[i], offsets[i] = b, capacity - room
            if room > size:
                insort(free, (room - size, b))
        return rows[["worker", "fits", "nth"]].assign(bin=bins, place=offsets)

    return pack


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_token: int = 2,
    key: str = "doc_id",
    text: str = "text",
    whole: bool = False,
) -> DataFrame:
    """One row per piece: its document, range and checksum, and its place in a sequence."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_token, key, text, whole), "pieces")
    by_worker = cut.groupBy("worker", "fits").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("fits").orderBy("worker").rowsBetween(W.unboundedPreceding, -1))
    by_worker = written(by_worker.select("worker", "fits", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    # A row for each class: as many as the capacity has reciprocal sizes.
    totals = sorted((r["fits"], r["n"]) for r in by_worker.groupBy("fits").agg(F.sum("n").alias("n")).collect())
    classes, first = [], 0
    for fits, n in totals:
        classes.append((fits, n // fits * fits, first))
        first += n // fits
    classes = spark.createDataFrame(classes, "fits long, in_full long, first long")
    placed = cut.join(
        by_worker.select("worker", "fits", "before").join(F.broadcast(classes), "fits"),
        ["worker", "fits"],
    ).withColumn("number", F.col("before") + F.col("nth"))
    in_full = placed.where("number < in_full").withColumn("sequence_id", F.expr("first + number div fits"))
    if whole:
        ahead = F.sum("length").over(W.partitionBy("sequence_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1))
        in_full = in_full.withColumn("offset", F.coalesce(ahead, F.lit(0)))
    else:
        in_full = in_full.withColumn("offset", F.expr("number % fits * length"))
    rest = placed.where("number >= in_full")
    tail = rest.select("worker", "fits", "length", "nth").groupBy().applyInPandas(
        _best_fit(capacity),
        "worker long, fits long, nth long, bin long, place long",
    )
    at_end = rest.join(tail, ["worker", "fits", "nth"]).withColumns({"sequence_id": F.col("bin") + first, "offset": F.col("place")})
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return in_full.select(columns).unionByName(at_end.select(columns))
