"""What the embedding operators share: which vectors take part, and groups of rows in a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Vectors that take part: not null or zero, all components known and finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def list_column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def groups(batches, key: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``, from batches in which they stand together."""
    waiting: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        changes = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            changes |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(edges, edges[1:]):
            own = tuple(c[a] for c in columns)
            if waiting and own != last:
                yield pa.concat_tables(waiting)
                waiting = []
            waiting.append(table.slice(a, b - a))
            last = own
    if waiting:
        yield pa.concat_tables(waiting)


def rotation(size: int, seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest length of the vectors; others cannot be compared with these."""
    found = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0
