"""Near-dedup by Order MinHash: sketches that keep the text order of sampled k-mers.

A text's k-mers are its runs of five words.  For sampling each is labelled with
how often it has occurred before.  For each of SLOTS random orders the PICKS
smallest k-mers are sampled and kept in text order; texts that agree in one of
the slots are candidates, and each of them is verified unless already in one
component.  Verification is a banded alignment of the two k-mer sequences: with
L aligned of n and m k-mers the similarity is L / (n + m - L), which is
sensitive to order, and pairs of at least 0.8 are links.  The band is as wide
as an alignment of that similarity can stray, so verification is exact.

Exact copies are one node, and no pair of one component needs to be looked at.
First the leader of each bucket is compared with all its members, which joins
groups of close copies by as many pairs as they have texts.  What is then left in
more than one component is compared in blocks: a task holds the k-mers of two
blocks of a bucket once, counts common k-mers of all pairs, aligns those pairs
that have enough of them and are still apart, and gives out only links that join
two components.  So every pair that shares a bucket is verified or already in one
component, and no pair is ever a row.  A group of different texts of which most
pairs share buckets without being links costs the square of its size in time, but
not in rows.

A pair of similarity 0.8 or more without repeated k-mers agrees in a slot with
probability L(L-1)(L-2) / (U(U-1)(U-2)), U = n + m - L, or more: it is a candidate
with a probability of at least 0.9997 at any size (least with 4 of 5 k-mers).
Repeated k-mers can be sampled in another order, which lowers this by an amount
that is not bounded here.

Texts of under five words are one k-mer.  Null texts are alone; texts without
words are copies only of equal texts.  Rows with a null key belong to classes,
but a class id is the smallest key that is not null (null if there is none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, digest128, written
from .graph import components
from .vectors import groups

WORDS, SIMILAR = 5, 0.8
SLOTS, PICKS = 16, 3
#: Texts, and k-mers of all of them, that a block of a bucket holds.
BLOCK, BLOCK_KMERS = 4096, 1 << 20
#: What tells tasks of verification apart.
TASK = ["slot", "value", "low", "high"]

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling of each value."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * _STEP)
_POWERS = _mixed(np.arange(101, 101 + WORDS, dtype=np.uint64) * _STEP) | np.uint64(1)


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers of a text in order."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(words, object), categorize=False)
    if len(words) < WORDS:
        grams = np.array([(hashed * _POWERS[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))])
    else:
        n = len(words) - WORDS + 1
        grams = sum((hashed[i : i + n] * _POWERS[i] for i in range(WORDS)), np.zeros(n, np.uint64))
    return _mixed(grams)


def labelled_kmers(grams: np.ndarray) -> np.ndarray:
    """The hashes of k-mers, each changed by the number of its earlier occurrences, so that all are distinct."""
    if not len(grams):
        return grams
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if not fresh.all():
        at = np.arange(len(grams))
        seen = np.empty(len(grams), np.uint64)
        seen[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
        grams = np.where(seen > 0, _mixed(grams + seen * _STEP), grams)
    return grams


def sketch(grams: np.ndarray) -> np.ndarray:
    """One 64-bit value per slot: the sampled k-mers in text order."""
    values = (grams[None, :] ^ _SEEDS[:, None]) * _MIX[0]
    values ^= values >> np.uint64(32)
    values *= _MIX[1]
    picks, rows = min(PICKS, len(grams)), np.arange(SLOTS)
    at = np.empty((SLOTS, picks), np.int64)
    for j in range(picks):
        at[:, j] = values.argmin(axis=1)
        values[rows, at[:, j]] = np.iinfo(np.uint64).max
    at.sort(axis=1)
    out = np.full(SLOTS, np.uint64(picks))
    for j in range(picks):
        out = _mixed(out * _STEP + grams[at[:, j]])
    return out.view(np.int64)


def aligned(a: list, b: list, band: int) -> int:
    """How many k-mers can be aligned in order, by paths at most ``band`` off the diagonal.

    Rows of the alignment are bits of one integer, a zero for each column where
    the count rises; the window of columns moves with the diagonal.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict = {}
    for j, gram in enumerate(b):
        places[gram] = places.get(gram, 0) | (1 << j)
    width = 2 * band + 1
    full = (1 << width) - 1
    # Bit t of the window in row i is column i - band + t.
    window, risen = full, 0
    for i, gram in enumerate(a):
        low = i - band
        if i:
            risen += low > 0 and not window & 1
            window = (window >> 1) | (1 << (width - 1))
        match = places.get(gram, 0)
        match = (match >> low if low >= 0 else match << -low) & full
        if match:
            hit = window & match
            window = ((window + hit) | (window & ~match)) & full
    low = len(a) - 1 - band
    for t in range(width):
        if 0 <= low + t < len(b) and not window >> t & 1:
            risen += 1
    return head + tail + risen


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two k-mer sequences if it is at least SIMILAR, else 0.

    Labels serve only to count common k-mers: one occurrence more or less early
    in a text changes the labels of all later ones, so k-mers are aligned without.
    """
    n, m = len(a), len(b)
    least = SIMILAR / (1 + SIMILAR) * (n + m)
    if min(n, m) < least - 1e-9 or len(np.intersect1d(labelled_kmers(a), labelled_kmers(b), assume_unique=True)) < least - 1e-9:
        return 0.0
    found = aligned(a.tolist(), b.tolist(), int(n + m - 2 * least) + 1)
    return found / (n + m - found) if found >= least - 1e-9 else 0.0


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct text: node, its hash, smallest key, copies, number of k-mers and sketch."""
    arrow_batches(docs.sparkSession)
    long = T.LongType()
    schema = T.StructType(
        [docs.schema[key], *(T.StructField(c, long) for c in ("d1", "d2", "size")), T.StructField("sketch", T.ArrayType(long))]
    )

    def run(batches):
        for batch in batches:
            found = [labelled_kmers(kmers(t)) for t in batch.column("t").to_pylist()]
            sketches = [sketch(g).tolist() if len(g) else [] for g in found]
            columns = [
                batch.column(key),
                batch.column("d1"),
                batch.column("d2"),
                pa.array([len(g) for g in found], pa.int64()),
                pa.array(sketches, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), *digest128(F.col(text))).mapInArrow(run, schema)
    same = rows.groupBy("d1", "d2").agg(
        F.min(key).alias("first"),
        F.count("*").alias("copies"),
        F.first("size").alias("size"),
        F.first("sketch").alias("sketch"),
    )
    return written(same.withColumn("node", F.monotonically_increasing_id()), "nodes")


def buckets(texts: DataFrame) -> DataFrame:
    """Members of every bucket of at least two texts: bucket (slot, value), node, size, sketch, and the members of all its buckets as weight."""
    each = texts.select("node", F.posexplode("sketch").alias("slot", "value"))
    shared = each.groupBy("slot", "value").agg(F.count("*").alias("n")).where("n > 1")
    members = each.join(shared, ["slot", "value"])
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    return members.drop("n").join(weights, "node").join(texts.select("node", "size", "sketch"), "node")


def candidate_grams(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``node, grams``: the k-mers in order of each wanted text (node, d1, d2, first), once."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("first"), F.col(text).alias("t"), *digest128(F.col(text))).alias("r")
    own = wanted.alias("w").join(
        rows,
        (F.col("w.d1") == F.col("r.d1")) & (F.col("w.d2") == F.col("r.d2")) & F.col("w.first").eqNullSafe(F.col("r.first")),
    )

    def run(batches):
        for batch in batches:
            grams = pa.array([kmers(t).view(np.int64) for t in batch.column("t").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), grams], ["node", "grams"])

    return written(own.select("node", "t").dropDuplicates(["node"]).mapInArrow(run, "node long, grams array<long>"), "grams")


def _shared_counts(one: np.ndarray, others: list[np.ndarray], mark: np.ndarray) -> np.ndarray:
    """How many of its k-mers each of ``others`` has in common with ``one``; ``mark`` is a zeroed table of all k-mers."""
    mark[one] = 1
    counts = np.add.reduceat(mark[np.concatenate(others)], np.cumsum([0, *map(len, others[:-1])]), dtype=np.int32)
    mark[one] = 0
    return counts


def new_links(
    node: np.ndarray,
    component: np.ndarray,
    block: np.ndarray,
    sketches: np.ndarray | None,
    slot: int,
    grams: list[np.ndarray],
) -> list[tuple[int, int]]:
    """Links between texts of the lower and the higher block that join components; pairs of one component are passed over.

    Pairs that first agree in another slot than ``slot`` belong to another
    bucket; without sketches every pair belongs here.  A pair is aligned only if
    the k-mers that both have, in any order, suffice for the similarity.
    """
    sizes = np.array([len(g) for g in grams])
    ids = np.unique(np.concatenate([labelled_kmers(g) for g in grams]), return_inverse=True)[1].astype(np.int32)
    ids = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(max(int(i.max()) for i in ids) + 1, np.int8)
    root, found = component.copy(), []
    low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    for i in low:
        near = high[high > i] if block[low[0]] == block[high[0]] else high
        near = near[(root[near] != root[i]) & (np.minimum(sizes[near], sizes[i]) >= SIMILAR * np.maximum(sizes[near], sizes[i]) - 1e-6)]
        if len(near) and sketches is not None:
            near = near[(sketches[near] == sketches[i]).argmax(axis=1) == slot]
        if not len(near):
            continue
        least = SIMILAR / (1 + SIMILAR) * (sizes[near] + sizes[i]) - 1e-9
        for j in near[_shared_counts(ids[i], [ids[j] for j in near], mark) >= least]:
            if root[j] != root[i] and similarity(grams[i], grams[j]):
                found.append((int(node[i]), int(node[j])))
                root[root == root[j]] = root[i]
    return found


def _verify(batches):
    for rows in groups(batches, TASK):
        block = rows.column("block").to_numpy()
        if rows.num_rows < 2 or rows.column("low")[0].as_py() not in block or rows.column("high")[0].as_py() not in block:
            continue
        flat = rows.column("grams").combine_chunks()
        grams = np.split(flat.flatten().to_numpy().view(np.uint64), np.cumsum(flat.value_lengths().to_numpy())[:-1])
        slot = rows.column("slot")[0].as_py()
        sketches = rows.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, SLOTS) if slot >= 0 else None
        found = new_links(rows.column("node").to_numpy(), rows.column("component").to_numpy(), block, sketches, slot, grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())],
            ["a", "b"],
        )


def verified(tasks: DataFrame, grams: DataFrame) -> DataFrame:
    """``a, b``: links that join components, from tasks of texts whose pairs are to be verified."""
    rows = tasks.join(grams, "node").select(*TASK, "block", "node", "component", "sketch", "grams")
    return written(rows.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(_verify, "a long, b long"), "links")


def leader_tasks(members: DataFrame) -> DataFrame:
    """Tasks of one leader and up to BLOCK texts that share a bucket with it.

    A bucket's leader is the text that shares buckets with most others.  Each
    pair of a leader and a text is in one task, however many buckets they share.
    """
    bucket = ["slot", "value"]
    leaders = members.groupBy(*bucket).agg(F.max(F.struct("weight", "node")).getField("node").alias("leader"))
    pairs = members.join(leaders, bucket).where("node != leader").select("leader", "node").distinct()
    pairs = written(pairs, "leader-pairs")
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    led = pairs.join(sizes, "leader").withColumn("high", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    led = led.select(F.col("leader").alias("value"), "high", F.col("high").alias("block"), "node")
    leading = sizes.select(
        F.col("leader").alias("value"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("high"),
        F.lit(-1).alias("block"),
        F.col("leader").alias("node"),
    )
    return led.union(leading).select(
        F.lit(-1).alias("slot"),
        "value",
        F.lit(-1).alias("low"),
        "high",
        "block",
        "node",
        F.col("node").alias("component"),
        F.lit(None).cast("array<long>").alias("sketch"),
    )


def block_tasks(members: DataFrame) -> DataFrame:
    """Tasks that hold every pair of texts of one bucket and different components: members (slot, value, node, size, sketch, component).

    Buckets of one component are done.  In the others the largest component is
    the major one; each block of minor members meets all blocks, and no two
    blocks of the major component meet.  Buckets that fit one block are one task.
    """
    bucket = ["slot", "value"]
    parts = members.groupBy(*bucket, "component").agg(F.count("*").alias("n"), F.sum("size").alias("k"))
    blocks = lambda n, k: F.ceil(F.greatest(n / BLOCK, k / BLOCK_KMERS)).cast("int")
    whole = parts.groupBy(*bucket).agg(
        F.max(F.struct("n", "component", "k")).alias("top"),
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
    ).where("n > top.n")
    whole = whole.select(*bucket, F.when(blocks(F.col("n"), F.col("k")) > 1, F.col("top.component")).alias("major"), "n", "k", "top")
    plan = whole.select(
        *bucket,
        "major",
        F.when(F.col("major").isNull(), 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("k") - F.col("top.k"))).alias("minors"),
        F.when(F.col("major").isNull(), 0).otherwise(blocks(F.col("top.n"), F.col("top.k"))).alias("majors"),
    )
    rows = members.join(plan, bucket).withColumn("is_major", F.coalesce(F.col("component") == F.col("major"), F.lit(False)))
    some = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("is_major"), F.col("minors") + some("majors")).otherwise(some("minors")))
    met = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return rows.select(
        *bucket,
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "node",
        "component",
        "sketch",
    )


def linked(docs: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``node, component`` of every text that links with another."""
    members = written(buckets(texts), "members")
    wanted = texts.join(members.select("node").distinct(), "node").select("node", "d1", "d2", "first")
    grams = candidate_grams(docs, wanted, key, text)
    found = verified(leader_tasks(members), grams)
    known = members.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = verified(block_tasks(written(known, "members")), grams)
    return components(found.union(rest))


def text_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``d1, d2, first, copies, class_id`` of every distinct text; ``first`` is its smallest key."""
    texts = nodes(docs, key, text)
    of_text = texts.join(linked(docs, texts, key, text), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = of_text.groupBy("component").agg(F.min("first").alias("class_id"))
    return written(of_text.join(of_class, "component").select("d1", "d2", "first", "copies", "class_id"), "text-classes")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, the class of its text (smallest key), how many rows copy its text, and whether it is kept.

    Of each class the row with the smallest key stays; rows that repeat both
    its key and its text are marked alike.
    """
    rows = docs.select(
        key,
        *digest128(F.col(text)),
        F.col(text).isNull().alias("no_text"),
    ).join(text_classes(docs, key, text).drop("first"), ["d1", "d2"], "left")
    own = F.when(F.col("no_text"), F.col(key)).otherwise(F.col("class_id"))
    return rows.select(
        key,
        own.alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.col("no_text") | F.col(key).eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one of each class, and all without text.

    Of rows that repeat both key and text one stays.
    """
    winners = text_classes(docs, key, text).where("first <=> class_id").select(F.col("class_id").alias("key_id"), "d1", "d2").alias("w")
    known = F.col(text).isNotNull()
    rows = docs.where(known).select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key_id"), *digest128(F.col(text)))
    # Repeated rows are one before they meet; a hot text is spread by its keys.
    rows = rows.groupBy("key_id", "d1", "d2").agg(F.first("row").alias("row")).alias("r")
    same = F.col("r.key_id").eqNullSafe(F.col("w.key_id")) & (F.col("r.d1") == F.col("w.d1")) & (F.col("r.d2") == F.col("w.d2"))
    return rows.join(winners, same, "left_semi").select("row.*").unionByName(docs.where(~known))
