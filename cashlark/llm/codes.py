"""Vector code compression: product codes by a member-resident Lloyd iteration, in whole numbers.

Each vector is cut into ``parts`` equal parts; the parts of one position have a
codebook, which starts as those of the vectors with the smallest ids.  A first
scan assigns every part and shuffles the parts once, packed by (position, entry,
salt), to the tables of their owners; the salt bounds what one owner holds however
many parts an entry has.  From then on members stay where they are.  An owner
sums its residents where they lie; the next round looks for their nearest entry
again in place, sums those that stay, and gives out only the parts whose entry
has changed, which are the whole of the next shuffle.  These arrivals are a
generation of residents of their own.  No generation is rewritten: a member has
left exactly if a later round assigned it elsewhere, which its task recomputes
from the codebooks since.

The driver holds codebooks, ``entries`` rows of one vector's size, and the sums for them.  A scan
with the last codebooks writes the codes.

Components become floor(256 * x), and all sums and distances are exact in 64-bit
integers; a component too large for that is an error.  Vectors that are null or
empty, hold null or non-finite components, or have another length than the commonest take no
part; a length that does not divide into equal parts is an error.  Null ids sort
last, repeated ids by their vectors; repeated rows are rows of their own.  Null
labels are one label.  Columns other than the key, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, written
from .vectors import dimension, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts of one position that an owner holds, if all were of one entry.
RESIDENTS = 65_536
#: Distances that are held at once.
CELLS = 1 << 20

#: A pack of members of one entry; or, without members, the sums of some.
STATE = "position int, entry int, salt int, members binary, n long, sums array<long>"


def largest(width: int) -> int:
    """The largest absolute component for which no sum of squares over a vector can overflow."""
    return isqrt(((1 << 63) - 1) // width) // 2


def whole_parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as integers: (vector, position, component)."""
    values = np.floor(vectors * SCALE)
    if values.size and np.abs(values).max() > largest(vectors.shape[1]):
        raise OverflowError(f"a component exceeds {largest(vectors.shape[1]) // SCALE}, up to which distances are exact")
    return values.astype(np.int64).reshape(len(vectors), parts, -1)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``values`` the nearest of ``entries``, ties to the lower index, and the squared distance to it."""
    reach = int(np.abs(values).max(initial=0)) + int(np.abs(entries).max(initial=0))
    # Below 2^52 floating-point products of whole numbers are exact.
    exact = 2 * values.shape[1] * reach**2 < 1 << 52
    found = np.empty(len(values), np.int64)
    step = max(1, CELLS // len(entries))
    for a in range(0, len(values), step):
        rows = values[a : a + step]
        if exact:
            e = entries.astype(np.float64)
            gaps = (e**2).sum(axis=1) - 2 * (rows.astype(np.float64) @ e.T)
        else:
            gaps = np.stack([((rows - e) ** 2).sum(axis=1) for e in entries], axis=1)
        found[a : a + step] = gaps.argmin(axis=1)
    return found, ((values - entries[found]) ** 2).sum(axis=1)


class Sums:
    """Sums of members by position and entry."""

    def __init__(self, shape: tuple[int, int, int]):
        self.n, self.sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)

    def add(self, position: int, entry: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(entry, kind="stable")
        which, at, count = np.unique(entry[order], return_index=True, return_counts=True)
        if len(which):
            self.n[position, which] += count
            self.sums[position, which] += np.add.reduceat(values[order], at, axis=0)

    def batch(self) -> pa.RecordBatch:
        position, entry = np.nonzero(self.n)
        sums = self.sums[position, entry].tolist()
        return batch_of(position, entry, np.zeros(len(entry)), [None] * len(entry), self.n[position, entry], sums)


def batch_of(position, entry, salt, members, n, sums) -> pa.RecordBatch:
    numbers = [pa.array(np.asarray(x).astype(np.int32), pa.int32()) for x in (position, entry, salt)]
    rest = [pa.array(members, pa.binary()), pa.array(np.asarray(n, np.int64)), pa.array(sums, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*numbers, *rest], ["position", "entry", "salt", "members", "n", "sums"])


def packs(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Members packed by position, entry and salt."""
    order = np.lexsort([salt, entry, position])
    keys = np.column_stack([position, entry, salt])[order]
    values = values[order].astype("<i4")
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, int)
    ends = np.concatenate([at[1:], [len(keys)]]).astype(int) if len(at) else at
    members = [values[a:b].tobytes() for a, b in zip(at, ends)]
    return batch_of(*keys[at].T, members, ends - at, [None] * len(at))


def first_assignment(rows: DataFrame, vector: str, books: np.ndarray, salts: int) -> DataFrame:
    """Every part of every vector, packed by its nearest entry."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                values = whole_parts(matrix(batch.column(0)), parts)
                entry = np.stack([nearest(values[:, p], books[p])[0] for p in range(parts)], axis=1)
                position = np.tile(np.arange(parts), len(values))
                turn += 1
                yield packs(position, entry.reshape(-1), np.full(len(position), turn % salts), values.reshape(len(position), -1))

    return rows.select(vector).mapInArrow(run, STATE)


def residents_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each position of a batch of packs: position, entry, salt and values of each member."""
    position, entry, salt, n = (batch.column(c).to_numpy() for c in ("position", "entry", "salt", "n"))
    members = batch.column("members")
    for p in np.unique(position):
        which = np.flatnonzero(position == p)
        data = b"".join(members[i].as_py() for i in which.tolist())
        values = np.frombuffer(data, "<i4").reshape(-1, width).astype(np.int64)
        yield int(p), np.repeat(entry[which], n[which]), np.repeat(salt[which], n[which]), values


def resident_sums(members: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Sums of a generation that has just arrived: all its members are residents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shape)
        for batch in batches:
            for p, entry, _, values in residents_of(batch, shape[2]):
                sums.add(p, entry, values)
        yield sums.batch()

    return members.mapInArrow(run, STATE)


def stay_or_move(members: DataFrame, since: list[np.ndarray], books: np.ndarray) -> DataFrame:
    """Of a generation, packs of the members that change entry, and sums of those that stay.

    ``since`` holds the codebooks of the rounds since the generation arrived:
    a member that one of them assigned elsewhere has left already.
    """
    shape = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(shape)
        for batch in batches:
            for p, entry, salt, values in residents_of(batch, shape[2]):
                for earlier in since:
                    here = nearest(values, earlier[p])[0] == entry
                    entry, salt, values = entry[here], salt[here], values[here]
                now, _ = nearest(values, books[p])
                stays = now == entry
                sums.add(p, entry[stays], values[stays])
                moves = ~stays
                if moves.any():
                    yield packs(np.full(moves.sum(), p), now[moves], salt[moves], values[moves])
        yield sums.batch()

    return members.mapInArrow(run, STATE)


def settled(movers: DataFrame, tag: str) -> DataFrame:
    """Packs with their owners: the shuffle of a round."""
    return written(movers.where("members IS NOT NULL").repartition("position", "entry", "salt"), tag)


def updated(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Codebooks with each used entry at the floor of its members' mean."""
    size = books.shape[2]
    totals = sums.where("members IS NULL").groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    books = books.copy()
    for row in totals.collect():  # one row per entry of a codebook
        books[row["position"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return books


def train(rows: DataFrame, vector: str, books: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``books`` after ``rounds`` rounds of assignment and update over the ``n`` vectors of ``rows``."""
    if not rounds:
        return books
    salts = -(-n // RESIDENTS)
    members = settled(first_assignment(rows, vector, books, salts), "codes-members")
    generations: list[tuple[DataFrame, list[np.ndarray]]] = [(members, [])]
    books = updated(books, resident_sums(members, books.shape))
    for _ in range(rounds - 1):
        steps = [stay_or_move(m, since, books) for m, since in generations]
        step = steps[0]
        for other in steps[1:]:
            step = step.unionByName(other)
        step = written(step, "codes-step")
        arrived = settled(step, "codes-arrived")
        for _, since in generations:
            since.append(books)
        generations.append((arrived, []))
        books = updated(books, step.unionByName(resident_sums(arrived, books.shape)))
    return books


def encoded(rows: DataFrame, key: str, vector: str, label: str, books: np.ndarray) -> DataFrame:
    """key, label, code (two hex digits per part) and error of each vector."""
    arrow_batches(rows.sparkSession)
    schema = T.StructType([rows.schema[key], rows.schema[label], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = whole_parts(matrix(batch.column(2)), len(books)) if batch.num_rows else np.zeros((0, *books.shape[::2]), np.int64)
            found = [nearest(values[:, p], books[p]) for p in range(len(books))]
            entry = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            code = [e.tobytes().hex() for e in entry]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error.astype(np.int64))], schema.names)

    return rows.select(key, label, vector).mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per vector: key, code, error, label_error (of all vectors of its label) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part: at most 256 entries")
    spark = rows.sparkSession
    arrow_batches(spark)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.select(key, label, vector).where((F.size(vector) > 0) & F.coalesce(finite, F.lit(False)))
    width = dimension(sound, vector)
    if width % parts:
        raise ValueError(f"vectors of {width} components do not divide into {parts} equal parts")
    sound = sound.where(F.size(vector) == width)
    firsts = sound.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    if not firsts:
        return rows.select(key, F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).limit(0)
    start = whole_parts(np.array([r[0] for r in firsts], np.float64), parts).swapaxes(0, 1).copy()
    books = train(sound, vector, start, sound.count(), rounds)
    codes = written(encoded(sound, key, vector, label, books), "codes")
    of_label = codes.groupBy(F.col(label).alias("its_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, F.col(label).eqNullSafe(F.col("its_label")), "left").select(
        key,
        "code",
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def twin() -> str:
    """The result of :func:`compress` on ``embeddings`` as DuckDB SQL."""
    assign = lambda books: f"""SELECT rid, part, any_value(p.comps) AS comps, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.comps, {books}.comps)]) * {ENTRIES} + entry) AS best
  FROM p JOIN {books} USING (part) GROUP BY rid, part"""  # noqa: E731
    ctes = []
    for r in range(ROUNDS):
        ctes.append(f"a{r} AS ({assign(f'b{r}')})")
        ctes.append(f"m{r} AS (SELECT part, best % {ENTRIES} AS entry, unnest(comps) AS x, generate_subscripts(comps, 1) AS pos FROM a{r})")
        ctes.append(f"f{r} AS (SELECT part, entry, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM m{r} GROUP BY ALL)")
        ctes.append(f"n{r} AS (SELECT part, entry, list(x ORDER BY pos) AS comps FROM f{r} GROUP BY ALL)")
        ctes.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(n.comps, b.comps) AS comps FROM b{r} b LEFT JOIN n{r} n ON n.part = b.part AND n.entry = b.entry)")
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT rid, vec_id, part, c[part * (len(c) // {PARTS}) + 1 : (part + 1) * (len(c) // {PARTS})] AS comps FROM (SELECT rid, vec_id, c, unnest(range({PARTS})) AS part FROM v)),
b0 AS (SELECT part, entry, comps FROM (SELECT part, comps, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES}),
{", ".join(ctes)},
z AS ({assign(f"b{ROUNDS}")}),
s AS (SELECT sha256(string_agg(array_to_string(comps, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (SELECT rid, string_agg(format('{{:02x}}', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM z GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (rid), s"""
