"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Largest inner product becomes least distance by one more coordinate that gives
all indexed vectors the same norm.  Vectors are rotated at random, so that the
first coordinates of a difference are a fair sample of all, and a scan takes its
vectors in blocks of columns.  For each query the lists are scanned one column
block after the other: the partial distance estimates the whole one, and a
hypothesis test abandons the candidates that would, with high confidence, lie
beyond the query's present k-th distance.

Lists are probed nearest first, in waves that end at the shares WAVES of all
lists.  Each wave takes the k-th distance found so far as its bound, and leaves
out the lists that cannot reach it: those of which the centre lies further away
than bound and radius together, which is exact.  The last wave takes all lists
that this leaves, so only the hypothesis test can lose a neighbour.  Queries that have found fewer
than k vectors search all other lists.

Neighbouring lists are scanned together, about SCAN vectors in a task, so a
query travels once to such a group of lists and not to each list; longer lists
are split by a hash.  Which lists a query asks is worked out in the task that
holds the query, from the centres and the bound, and leaves it as one row per
query and group of lists with the lists that count.  Centroids are fitted on a bounded sample (SAMPLE rows, by a
hash of the id); there are as many lists as the square root of the vectors, but
no more than rows in the sample.  Every usable vector is indexed.  Scores are
exact inner products of the original vectors in double precision.

Vectors that are null, zero or hold null or non-finite components, rows with a
null id, and vectors of another length than the commonest take no part.  Repeated
ids are candidates once per row, but never for a query of the same id; of
repeated query ids one row is asked.  Ties go to the smaller id; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_batches, written
from .vectors import dimension, groups, list_column, matrix, rotation, usable

SAMPLE, ROUNDS = 20_000, 8
#: Vectors and queries that one scan takes together, and queries of which the first columns are compared at once.
SCAN, QUERY_BLOCK, AT_ONCE = 16_384, 1024, 64
#: Distances between vectors and centres that are held at once.
CELLS = 1 << 22
#: Columns of a block, and how many standard deviations a candidate must lie beyond the bound.
COLUMNS, CONFIDENCE = 16, 1.3
#: Shares of the lists, nearest first, after which each wave ends; 0 is the nearest list alone, 1 leaves the end to the bound.
WAVES = (0.0, 0.15, 1.0)


def list_count(n: int) -> int:
    return max(1, round(np.sqrt(n)))


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from rows chosen at random; a list that loses all rows keeps its centre."""
    chosen = np.random.default_rng(5).permutation(len(sample))[:lists]
    centres = sample[chosen].copy()
    for _ in range(ROUNDS):
        squares = (centres**2).sum(1)
        own = np.concatenate([np.argmin(squares - 2 * rows @ centres.T, axis=1) for rows in blocks_of(sample, lists)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def blocks_of(rows: np.ndarray, columns: int) -> list[np.ndarray]:
    """Blocks of rows of which the distances to so many centres are held at once."""
    return np.array_split(rows, max(1, -(-len(rows) * columns // CELLS)))


def _lifted(values: np.ndarray, top: float | None) -> np.ndarray:
    """Vectors with one more coordinate: to norm ``top`` for indexed ones, zero for queries."""
    extra = np.zeros(len(values)) if top is None else np.sqrt(np.maximum(top**2 - (values**2).sum(1), 0))
    return np.column_stack([values, extra])


def _goes_on(partial: np.ndarray, done: int, width: int, bound: float) -> np.ndarray:
    """Which candidates the test keeps after ``done`` of ``width`` columns."""
    return partial * (width / done) <= bound * (1 + CONFIDENCE / np.sqrt(done)) ** 2


def scan(
    points: np.ndarray,
    first: np.ndarray,
    query: np.ndarray,
    candidates: np.ndarray,
    bound: float,
    k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that are not abandoned, with their distances; ``first`` has the distances by the first columns.

    ``points`` holds a rotated vector in each column.
    """
    width, done = len(points), min(COLUMNS, len(points))
    alive, partial = candidates, first[candidates]
    while True:
        if done == width:
            if len(alive) > k:
                bound = min(bound, np.partition(partial, k - 1)[k - 1])
            keep = partial <= bound * (1 + 1e-9) + 1e-12
            return alive[keep], partial[keep]
        if bound < np.inf:
            keep = _goes_on(partial, done, width, bound)
            alive, partial = alive[keep], partial[keep]
        end = min(width, done + COLUMNS)
        partial = partial + ((points[done:end, alive] - query[done:end, None]) ** 2).sum(0)
        done = end


def _scan(k: int):
    """Each query's best among the vectors of a group of lists, with exact scores and distances."""
    names = ["query_id", "vec_id", "score", "distance"]

    def run(batches):
        for rows in groups(batches, ["part", "query_block"]):
            asks = rows.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            ids, values, turned = rows.column("id").to_numpy(), matrix(rows.column("vector")), matrix(rows.column("turned"))
            lists, bounds = rows.column("lists").combine_chunks(), rows.column("bound").to_numpy()
            own_ids, own_values, points = ids[~asks], values[~asks], np.ascontiguousarray(turned[~asks].T)
            own_list = lists.filter(pa.array(~asks)).flatten().to_numpy()
            start = points[: min(COLUMNS, len(points))]
            squares, out = (start**2).sum(0), []
            for some in np.array_split(np.flatnonzero(asks), -(-asks.sum() // AT_ONCE)):
                q = turned[some][:, : len(start)]
                firsts = np.maximum((q**2).sum(1)[:, None] - 2 * q @ start + squares, 0)
                for first, at in zip(firsts, some):
                    candidates = np.flatnonzero(np.isin(own_list, lists[int(at)].values.to_numpy()) & (own_ids != ids[at]))
                    near, distance = scan(points, first, turned[at], candidates, bounds[at], k)
                    scores = own_values[near] @ values[at]
                    best = np.lexsort((own_ids[near], -scores))[:k]
                    out.append((np.full(len(best), ids[at]), own_ids[near[best]], scores[best], distance[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def scan_parts(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """For each list (number, vectors) its first part and the parts that it is split into; short lists share a part."""
    out, part, filled = [], 0, 0
    for number, n in sizes:
        if filled and filled + n > SCAN:
            part, filled = part + 1, 0
        own = max(1, -(-n // SCAN))
        out.append((number, part, own))
        filled += n
        if own > 1:
            part, filled = part + own, 0
    return out


def distances(turned: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """From each turned vector to each centre."""
    return np.sqrt(np.maximum((turned**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * turned @ centres.T, 0))


def _asked(centres: np.ndarray, parts: np.ndarray, radius: np.ndarray, low: int, high: int):
    """Per query and part the lists from place ``low`` to ``high`` that can still hold a nearer vector.

    ``parts`` has the first part of each list and how many parts it is split into.
    """

    def run(batches):
        for batch in batches:
            ids, bounds = batch.column("id").to_numpy(), batch.column("bound").to_numpy()
            turned, start = matrix(batch.column("turned")), 0
            for rows in blocks_of(turned, len(centres)):
                far = distances(rows, centres)
                order = np.argsort(far, axis=1, kind="stable")[:, low:high]
                own_ids, own_bounds = ids[start : start + len(rows)], bounds[start : start + len(rows)]
                reach = np.sqrt(own_bounds)[:, None] * (1 + 1e-9)
                query, place = np.nonzero(np.take_along_axis(far, order, 1) - radius[order] <= reach)
                start += len(rows)
                number = order[query, place]
                times = parts[number, 1]
                ends = np.cumsum(times)
                within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
                query, part, number = np.repeat(query, times), np.repeat(parts[number, 0], times) + within, np.repeat(number, times)
                sort = np.lexsort([number, part, query])
                query, part, number = query[sort], part[sort], number[sort]
                new = np.ones(len(query), bool)
                new[1:] = (query[1:] != query[:-1]) | (part[1:] != part[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(query)).astype(np.int32)), pa.array(number.astype(np.int32)))
                columns = [pa.array(own_ids[query[at]]), pa.array(part[at].astype(np.int32)), lists, pa.array(own_bounds[query[at]])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "lists", "bound"])

    return run


def _probe(index: DataFrame, queries: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Scan lists: ``wanted`` has a row (id, part, lists, bound) for each query and part."""
    wanted = written(wanted, "asked-lists")
    busy = wanted.groupBy("part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asking = wanted.join(busy, "part").join(queries, "id").withColumns(
        {"query_block": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "is_query": F.lit(True)}
    )
    stored = index.join(busy, "part").withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    stored = stored.withColumns({"lists": F.array("list"), "bound": F.lit(0.0), "is_query": F.lit(False)})
    columns = ["part", "query_block", "is_query", "id", "vector", "turned", "lists", "bound"]
    key = ["part", "query_block"]
    both = stored.select(columns).union(asking.select(columns)).repartition(*key).sortWithinPartitions(*key)
    return written(both.mapInArrow(_scan(k), "query_id long, vec_id long, score double, distance double"), "found")


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    waves: tuple[float, ...] = WAVES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` nearest found by inner product, ties to the smaller id."""
    spark = rows.sparkSession
    arrow_batches(spark)
    sound = rows.where(usable(vector) & F.col(key).isNotNull())
    n = dimension(sound, vector)
    sound = sound.where(F.size(vector) == n).select(
        F.col(key).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total, top = sound.agg(F.count("*"), F.max(norm)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    turn = rotation(n + 1, 3)
    # At most SAMPLE rows reach the driver.
    sample = np.array([r["vector"] for r in sound.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()], float)
    centres = centroids(_lifted(sample, top) @ turn, min(list_count(total), len(sample)))

    def assigned(queries: bool):
        """Turned vectors, those of the index with their nearest list and the distance to it."""

        def run(batches):
            for batch in batches:
                turned = _lifted(matrix(batch.column("vector")), None if queries else top) @ turn
                columns = [batch.column("id"), batch.column("vector"), list_column(turned, pa.float64())]
                if not queries:
                    own = [(far.argmin(axis=1), far.min(axis=1)) for far in (distances(rows, centres) for rows in blocks_of(turned, len(centres)))]
                    columns += [pa.array(np.concatenate([o for o, _ in own]).astype(np.int32)), pa.array(np.concatenate([f for _, f in own]))]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

        return run

    names = ["id", "vector", "turned", "list", "away"]
    doubles = T.ArrayType(T.DoubleType())
    fields = [T.StructField(name, kind) for name, kind in zip(names, [T.LongType(), doubles, doubles, T.IntegerType(), T.DoubleType()])]
    index = written(sound.select("id", "vector").mapInArrow(assigned(False), T.StructType(fields)), "lists")
    sizes = sorted(
        (r["list"], r["n"], r["radius"])
        for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    )
    # As many rows as there are lists, which SAMPLE bounds; lists without vectors are in no part.
    placed = scan_parts([(number, m) for number, m, _ in sizes])
    part_of, radius = np.zeros((len(centres), 2), np.int64), np.zeros(len(centres))
    for (number, first, own), (_, _, r) in zip(placed, sizes):
        part_of[number], radius[number] = (first, own), r
    parts = spark.createDataFrame(placed, "list int, first int, own int")
    split = F.col("first") + F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    index = written(index.join(F.broadcast(parts), "list").select("id", "vector", "turned", "list", split.alias("part")), "index")
    queries = written(
        sound.where("asks").dropDuplicates(["id"]).select("id", "vector").mapInArrow(assigned(True), T.StructType(fields[:3])),
        "queries",
    )

    def probed(found: DataFrame | None, low: int, high: int, which: DataFrame) -> DataFrame:
        """What the queries ask of the lists from place ``low`` to ``high``, by the k-th distance found so far."""
        bounded = which.select("id", "turned", F.lit(float("inf")).alias("bound"))
        if found is not None:
            nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance"))
            kth = found.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("distance").alias("kth"))
            bounded = bounded.join(kth, "id", "left").select("id", "turned", F.coalesce("kth", "bound").alias("bound"))
        return bounded.mapInArrow(_asked(centres, part_of, radius, low, high), "id long, part int, lists array<int>, bound double")

    found, low = None, 0
    for share in waves:
        high = min(len(centres), max(low + 1, int(np.ceil(len(centres) * share))))
        if high > low:
            more = _probe(index, queries, probed(found, low, high, queries), k)
            found, low = more if found is None else found.union(more), high
    if low < len(centres):
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
        short = written(queries.join(enough, "id", "left_anti"), "short-queries")
        if not short.isEmpty():  # their probed lists hold fewer than k vectors
            found = found.union(_probe(index, queries, probed(None, low, len(centres), short), k))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
