"""Embedding near-dedup by spherical-cap filters from structured random product codes.

A fixed rotation splits each vector into PARTS parts, or more where there are very
many vectors; each part has its own small code of random unit vectors, and a filter direction takes one code vector
from each part.  A vector is list-decoded to the directions whose caps it lies
in: the cap's height is set for each vector so that it lies in CAPS of them.
Decoding looks only at combinations that can be among the CAPS best, so its
cost does not grow with the number of filters.  Vectors of one label that share
a filter are compared, and pairs with enough cosine are links.

Exact copies are one node with a weight.  Filters with many vectors are split
into blocks by a hash, and each pair of blocks is compared on its own.  A pair
that shares several filters belongs to the first of them.  A task gives out how
many rows each node links with, and of the links only those that join components.

Vectors that are null, zero or hold null or non-finite components, and rows
without a label, link with nothing; vectors of another length than the commonest
are compared among none.  Repeated rows count as copies; a null id never names a
component unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, written
from .graph import components
from .vectors import dimension, groups, list_column, matrix, rotation, usable

PARTS, CAPS = 3, 16
#: Filters per vector that the code is sized for, the vectors of a block, and the most code vectors of a part.
PER_FILTER, BLOCK, MOST_CODES = 24, 1024, 128
#: Pairs that are verified in one piece.
PAIRS = 8192


def caps(parts: int) -> int:
    """Filters of a vector: more where finer codes part near vectors more often."""
    return CAPS * (parts - PARTS + 1)


def code_shape(n: int) -> tuple[int, int]:
    """Parts and code vectors per part, so that a filter holds about PER_FILTER of ``n`` spread vectors; more vectors get more parts."""
    parts = PARTS
    while MOST_CODES**parts < n * caps(parts) / PER_FILTER:
        parts += 1
    return parts, max(8, int(np.ceil((n * caps(parts) / PER_FILTER) ** (1 / parts))))


def _codes(width: int, size: int, parts: int = PARTS) -> list[np.ndarray]:
    out = []
    for number, part in enumerate(np.array_split(np.arange(width), parts)):
        code = np.random.default_rng(1000 + number).standard_normal((size, max(1, len(part))))
        out.append(code / np.linalg.norm(code, axis=1, keepdims=True))
    return out


def _places(parts: int, depth: int, most: int) -> list[tuple[int, ...]]:
    """Places of the parts' best of which the product of their numbers, from 1, is at most ``most``."""
    if not parts:
        return [()]
    return [(i, *rest) for i in range(min(depth, most)) for rest in _places(parts - 1, depth, most // (i + 1))]


def decode(unit: np.ndarray, turn: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """For each row the filters with the largest inner products, ``caps`` of them, as numbers in ascending order."""
    size, most = len(codes[0]), caps(len(codes))
    depth = min(most, size)
    turned = unit @ turn
    order, best, at = [], [], 0
    for code in codes:
        part = turned[:, at : at + code.shape[1]]
        scores = part @ code[:, : part.shape[1]].T
        at += code.shape[1]
        top = np.argsort(-scores, axis=1, kind="stable")[:, :depth]
        order.append(top)
        best.append(np.take_along_axis(scores, top, 1))
    # The r-th best sum takes the i-th, j-th, k-th ... best of the parts with i * j * k * ... <= r.
    grid = np.array(_places(len(codes), depth, most))
    sums = sum(best[p][:, grid[:, p]] for p in range(len(codes)))
    chosen = np.argsort(-sums, axis=1, kind="stable")[:, :most]
    number = np.zeros(chosen.shape, np.int64)
    for p in range(len(codes)):
        number = number * size + np.take_along_axis(order[p], grid[chosen, p], 1)
    return np.sort(number, axis=1)


def _nodes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Distinct labelled vectors: node, weight (rows), first (smallest id)."""
    usable_rows = rows.where(usable(vector) & F.col(label).isNotNull())
    n = dimension(usable_rows, vector)
    same = usable_rows.where(F.size(vector) == n).groupBy(F.col(label).alias("label"), F.col(vector).alias("vector"))
    return written(
        same.agg(F.count("*").alias("weight"), F.min(key).alias("first")).withColumn("node", F.monotonically_increasing_id()),
        "vector-nodes",
    )


def _decoded(nodes: DataFrame, width: int, parts: int, size: int) -> DataFrame:
    schema = T.StructType([*nodes.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))])

    def run(batches):
        turn, codes = rotation(width, 11), _codes(width, size, parts)
        for batch in batches:
            values = matrix(batch.column("vector"))
            unit = values / np.linalg.norm(values, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(decode(unit, turn, codes), pa.int64())], schema.names)

    return nodes.mapInArrow(run, schema)


def _verified(values: np.ndarray, filters: np.ndarray, here: int, x: np.ndarray, y: np.ndarray, similar: float) -> np.ndarray:
    """Which pairs are links that belong to this filter, the first that both vectors have."""
    norm, keep = np.sqrt((values**2).sum(1)), np.zeros(len(x), bool)
    for at in range(0, len(x), PAIRS):
        i, j = x[at : at + PAIRS], y[at : at + PAIRS]
        shared = (filters[i][:, :, None] == filters[j][:, None, :]).any(2)
        first = filters[i, shared.argmax(1)] == here  # filters stand in ascending order
        keep[at : at + PAIRS] = first & ((values[i] * values[j]).sum(1) / (norm[i] * norm[j]) >= similar)
    return keep


def spanning_links(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Of links between ``n`` nodes, sorted by ``x``, as many as join their components."""
    root, found = np.arange(n), []
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
    for i, others in zip(x[starts] if len(x) else [], np.split(y, starts[1:])):
        apart = others[root[others] != root[i]]
        joined, first = np.unique(root[apart], return_index=True)
        found += [(int(i), int(j)) for j in apart[first]]
        root[np.isin(root, joined)] = root[i]
    return found


def _linked(similar: float):
    """Links within a block, or between two, of one filter and label: each node's number of linked rows, and links that join components."""
    schema = ["a", "b", "others"]

    def run(batches):
        for rows in groups(batches, ["label", "filter", "low", "high"]):
            if rows.num_rows < 2:
                continue
            node, weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
            block, here = rows.column("block").to_numpy(), rows.column("filter")[0].as_py()
            values, filters = matrix(rows.column("vector")), matrix(rows.column("filters")).astype(np.int64)
            unit = values / np.linalg.norm(values, axis=1, keepdims=True)
            low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            x, y = np.nonzero(unit[left] @ unit[right].T >= similar - 1e-9)
            x, y = left[x], right[y]
            keep = x < y if low == high else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            keep = _verified(values, filters, here, x, y, similar)
            x, y = x[keep], y[keep]
            others = np.zeros(len(node), np.int64)
            np.add.at(others, x, weight[y])
            np.add.at(others, y, weight[x])
            some, forest = np.flatnonzero(others), np.array(spanning_links(len(node), x, y), np.int64).reshape(-1, 2)
            a, b = np.r_[node[some], node[forest[:, 0]]], pa.array(np.r_[node[some], node[forest[:, 1]]])
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.r_[others[some], np.zeros(len(forest), np.int64)])], schema)

    return run


def links(nodes: DataFrame, similar: float) -> DataFrame:
    """``a, b, others``: rows with a = b add to the linked rows of a node; all other rows are links, enough of them to join each component.

    Every link is found and counted in one task, and none leaves it as a row
    that joins nothing.
    """
    spark = nodes.sparkSession
    arrow_batches(spark)
    head = nodes.select(F.size("vector").alias("n")).first()
    width = head["n"] if head else 1
    decoded = written(_decoded(nodes, width, *code_shape(nodes.count())), "decoded")
    in_filter = decoded.select("node", "label", F.explode("filters").alias("filter"))
    full = in_filter.groupBy("label", "filter").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    members = in_filter.join(full, ["label", "filter"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "node",
        "label",
        "filter",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    )
    rows = members.join(decoded.select("node", "weight", "vector", "filters"), "node")
    key = ["label", "filter", "low", "high"]
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    return written(rows.mapInArrow(_linked(similar), "a long, b long, others long"), "vector-links")


def near_duplicates(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    similar: float = 0.98,
) -> DataFrame:
    """Per row: its id, how many other vectors it links with, its component and whether it is the one kept."""
    nodes = _nodes(rows, key, vector, label)
    found = links(nodes, similar)
    degree = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    labels = components(found.where("a != b").select("a", "b"))
    known = nodes.join(degree, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "component").select(
        "label",
        "vector",
        (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "component_id",
    )
    known = written(known, "vector-classes").alias("k")
    all_rows = rows.select(key, F.when(usable(vector), F.col(vector)).alias("vector"), F.col(label).alias("label")).alias("r")
    joined = all_rows.join(known, (F.col("r.label") == F.col("k.label")) & (F.col("r.vector") == F.col("k.vector")), "left")
    component = F.coalesce("component_id", F.col(key))
    return joined.select(
        key,
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col(key).eqNullSafe(component).alias("kept"),
    )
