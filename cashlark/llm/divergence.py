"""Source divergence audit: how far the words of each source of a language are from those of every other source.

Terms are counted in numpy, a block of texts at a time.  A term of up to 8 bytes
is packed into one uint64, one of up to 16 into two; each bucket is sorted by a
radix sort over 16-bit digits, with the group as a digit, and runs are counted.
Longer terms go to buckets by length, which are sorted as bytes.  A task merges
its blocks the same way and gives out one row per group and term while they fit
in ``HELD`` entries.  One shuffle by (language, term) then sums the groups'
counts and finds in how many texts of the language a term stands.

Sources are compared in tiles: a task holds up to ``TILE_TERMS`` terms of a
language for two tiles of about ``TILE_SOURCES`` sources, compares all sources of one
with all of the other, and gives out one sum per pair of sources.  No row per pair and term exists.

All arithmetic is exact, in 64-bit integers: a share is a long division in three
steps, so a group may hold up to 9 * 10^15 terms.

Null text, language and source count as ''.  A group whose texts have no terms
has a row for each other source; a language without kept terms gives values of
0.  Repeated rows are texts of their own.  A term of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .bpe import blocks
from .common import arrow_batches, text_of, written

LEAST_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
#: Entries of (group, term) that a task holds before it gives them out.
HELD = 1_000_000
TILE_TERMS, TILE_SOURCES = 2_048, 128

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
TERM = ["w1", "w2", "long_term"]


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by ``keys``, least important key first, by 16-bit digits; digits that do not vary are skipped."""
    order = np.arange(len(keys[0]))
    for key in keys:
        key = key.astype(np.uint64, copy=False)
        if not len(key):
            continue
        varying = int(np.bitwise_or.reduce(key ^ key[0]))
        for shift in range(0, 64, 16):
            if varying >> shift & 0xFFFF:
                digit = (key >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed_runs(keys: list[np.ndarray], n: np.ndarray, docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` with their sums of ``n`` and ``docs``."""
    if not len(n):
        return keys, n, docs
    order = radix_order(keys)
    keys = [k[order] for k in keys]
    first = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    at = np.flatnonzero(first)
    return [k[at] for k in keys], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)


def first_in_doc(keys: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``keys`` in sorted order, ones, and 1 where a term comes first in its text; rows must stand in the order of texts."""
    order = radix_order(keys)
    keys, doc = [k[order] for k in keys], doc[order]
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in [*keys, doc]])
    return keys, np.ones(len(doc), np.int64), new.astype(np.int64)


class Counter:
    """Counts of terms by group, in buckets by the length of the term."""

    def __init__(self):
        self.packed: dict[int, list] = {1: [], 2: []}
        self.long: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        self.size = 0

    def add(self, texts: list[str], group: np.ndarray) -> None:
        """Count the terms of a block of texts, each of a numbered group."""
        data = " ".join(texts).encode() + b" " * 16
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        sizes = pc.binary_length(pa.array(texts, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.concatenate([[False], _LETTER[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, length = edges[::2], edges[1::2] - edges[::2]
        doc = np.searchsorted(np.concatenate([[0], np.cumsum(sizes + 1)]), begin, "right") - 1
        words = np.ndarray(len(raw) - 7, ">u8", raw.tobytes(), strides=(1,))

        def packed(at, size):
            blank = ((8 - np.minimum(size, 8)) * 8).astype(np.uint64)
            return words[at].astype(np.uint64) >> blank << blank

        for n_words, which in ((1, length <= 8), (2, (length > 8) & (length <= 16))):
            at, size = begin[which], length[which]
            keys = [packed(at, size)] if n_words == 1 else [packed(at + 8, size - 8), packed(at, size)]
            keys, n, first = first_in_doc([*keys, group[doc[which]]], doc[which])
            found = summed_runs(keys, n, first)
            self.packed[n_words].append(found)
            self.size += len(found[1])
        long = np.flatnonzero(length > 16)
        for size in np.unique(length[long]).tolist():
            self._add_long(raw, begin, doc, group, long[length[long] == size], size)

    def _add_long(self, raw, begin, doc, group, which, size) -> None:
        """Count terms of one length, sorted as bytes."""
        terms = np.array([raw[a : a + size].tobytes() for a in begin[which]], f"S{size}")
        order = np.lexsort([doc[which], terms, group[doc[which]]])
        terms, docs, groups = terms[order], doc[which][order], group[doc[which]][order]
        other = np.concatenate([[True], (terms[1:] != terms[:-1]) | (groups[1:] != groups[:-1])])
        new_doc = other | np.concatenate([[True], docs[1:] != docs[:-1]])
        at = np.flatnonzero(other)
        n = np.diff(np.concatenate([at, [len(terms)]]))
        bucket = self.long.setdefault(size, {})
        before = len(bucket)
        for g, t, k, d in zip(groups[at].tolist(), terms[at].tolist(), n.tolist(), np.add.reduceat(new_doc.astype(np.int64), at).tolist()):
            total = bucket.setdefault((g, t), [0, 0])
            total[0] += k
            total[1] += d
        self.size += len(bucket) - before

    def merge(self) -> None:
        """Sum equal entries of the packed buckets."""
        for k, parts in self.packed.items():
            if len(parts) > 1:
                keys = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
                self.packed[k] = [summed_runs(keys, *(np.concatenate([p[i] for p in parts]) for i in (1, 2)))]
        self.size = sum(len(p[1]) for parts in self.packed.values() for p in parts) + sum(map(len, self.long.values()))

    def rows(self) -> Iterator[tuple]:
        """Arrays (group, w1, w2, long term, n, docs) of all entries."""
        self.merge()
        for k, parts in self.packed.items():
            for keys, n, docs in parts:
                w1, w2 = (keys[0], np.zeros(len(n), np.uint64)) if k == 1 else (keys[1], keys[0])
                yield keys[-1], w1.view(np.int64), w2.view(np.int64), None, n, docs
        for bucket in self.long.values():
            groups, terms = zip(*bucket)
            n, docs = (np.array(x, np.int64) for x in zip(*bucket.values()))
            zeros = np.zeros(len(n), np.int64)
            yield np.array(groups), zeros, zeros, [t.decode() for t in terms], n, docs


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, w1, w2, long_term, n, docs: counts of terms by group, several rows of one term where several tasks met it."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in ("lang", "source")]
        + [T.StructField(c, T.LongType()) for c in ("w1", "w2")]
        + [T.StructField("long_term", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("n", "docs")]
    )

    def given(counter: Counter, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        for group, w1, w2, long, n, seen in counter.rows():
            for a in range(0, len(n), 1 << 16):
                cut = slice(a, a + (1 << 16))
                which = pa.array(group[cut].astype(np.int64))
                keys = [pa.array([x[i] for x in names], pa.string()).take(which) for i in (0, 1)]
                terms = pa.array(long[cut], pa.string()) if long else pa.array([""] * len(which), pa.string())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(w1[cut]), pa.array(w2[cut]), terms, pa.array(n[cut]), pa.array(seen[cut])], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = Counter(), {}
        for batch in batches:
            langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
            group = np.array([known.setdefault(g, len(known)) for g in zip(langs, sources)], np.uint64)
            for a, b in blocks(texts):
                counter.add(texts[a:b], group[a:b])
                if counter.size > 2 * HELD:
                    counter.merge()
                    if counter.size > HELD:
                        yield from given(counter, list(known))
                        counter = Counter()
        yield from given(counter, list(known))

    return rows.mapInArrow(run, schema)


def term_of() -> Column:
    """The term that ``w1``, ``w2`` and ``long_term`` stand for."""
    digits = F.concat(F.hex("w1"), F.when(F.col("w2") == 0, "").otherwise(F.hex("w2")))
    packed = F.decode(F.unhex(F.regexp_replace(digits, "(00)+$", "")), "UTF-8")
    return F.when(F.col("long_term") == "", packed).otherwise(F.col("long_term"))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole), by a long division in three steps."""
    rest, out = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + quotient(rest, whole), rest % whole
    return out + 1


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b)


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """As :func:`share`."""
    rest, out = n + 1, np.zeros(np.broadcast(n, whole).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) summed over the columns, for each row of ``p`` against each of ``q``."""
    return np.stack([((row - q) ** 2 // q).sum(axis=1) for row in p]) if len(p) else np.zeros((0, len(q)), np.int64)


def compared(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
    """Sums of distances between the sources of two tiles over the terms of one block.

    ``cells`` holds a row per source (``n`` null) and one per source and term.
    Terms of the language that neither tile has are left to ``base``: both shares
    are then those of no occurrence, so the sum is of what differs from that.
    """
    lang, _, tile, other = (k.as_py() for k in key)
    n = cells.column("n")
    heads, cells = cells.filter(n.is_null()), cells.filter(n.is_valid())
    names = heads.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    tiles, whole = heads.column("tile").to_numpy(), heads.column("whole").to_numpy()
    terms_of_lang = heads.column("terms").to_numpy()
    keys = [
        cells.column("long_term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False),
        cells.column("w2").to_numpy().view(np.uint64),
        cells.column("w1").to_numpy().view(np.uint64),
    ]
    order = radix_order(keys)
    new = np.zeros(len(order), np.int64)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    term = np.empty(len(order), np.int64)
    term[order] = np.cumsum(new)
    counts = np.zeros((len(names), int(term.max()) + 1 if len(term) else 0), np.int64)
    sources = np.fromiter(map(place.__getitem__, cells.column("source").to_pylist()), np.int64, len(order))
    counts[sources, term] = cells.column("n").to_numpy()
    p, p0 = shares(counts, whole[:, None]), shares(np.zeros(len(names), np.int64), whole)
    out: dict[str, list] = {"source": [], "item": [], "differs": [], "base": []}
    for a, b in {(tile, other), (other, tile)}:
        left, right = np.flatnonzero(tiles == a), np.flatnonzero(tiles == b)
        base = (p0[left][:, None] - p0[right]) ** 2 // p0[right]
        differs = distances(p[left], p[right]) - base * counts.shape[1]
        i, j = np.nonzero(left[:, None] != right)
        out["source"] += [names[k] for k in left[i]]
        out["item"] += [names[k] for k in right[j]]
        out["differs"] += differs[i, j].tolist()
        out["base"] += (base[i, j] * terms_of_lang[left[i]]).tolist()
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
    return pa.Table.from_arrays([pa.array([lang] * len(out["item"]), pa.string()), *columns], ["lang", *out])


def pair_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of each source to each other one of its language."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    n_tiles = -(-most // TILE_SOURCES)
    tile = F.pmod(F.xxhash64("source"), F.lit(n_tiles)).cast("int").alias("tile")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / TILE_TERMS)).cast("int")
    known = groups.select("lang", "source", "whole", "terms", tile, n_blocks.alias("n_blocks"))
    block = F.pmod(F.xxhash64(*TERM), F.col("n_blocks")).cast("int").alias("block")
    nothing = F.lit(None).cast("long")
    heads = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    heads = heads.select("lang", "block", "source", "tile", "whole", "terms", nothing.alias("w1"), nothing.alias("w2"), F.lit(None).cast("string").alias("long_term"), nothing.alias("n"))
    cells = kept.join(known, ["lang", "source"]).select("lang", block, "source", "tile", nothing.alias("whole"), nothing.alias("terms"), *TERM, "n")
    rows = heads.unionByName(cells).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    rows = rows.withColumns({"a": F.least("tile", "o"), "b": F.greatest("tile", "o")}).drop("o")
    sums = rows.groupBy("lang", "block", "a", "b").applyInArrow(compared, "lang string, source string, item string, differs long, base long")
    return sums.groupBy("lang", "source", "item").agg((F.sum("differs") + F.max("base")).alias("value"))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources (part pair), and the terms that a source has more than its language (part term, at most ``top``)."""
    counts = term_counts(docs, lang, source, text).repartition("lang", *TERM)
    counts = counts.groupBy("lang", *TERM, "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", *TERM).orderBy("source")
    all_sources = of_term.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = counts.select(
        "lang",
        *TERM,
        "source",
        "n",
        F.sum("docs").over(all_sources).alias("lang_docs"),
        F.sum("n").over(all_sources).alias("lang_n"),
        (F.row_number().over(of_term) == 1).alias("first"),
    )
    kept = written(counts.where(F.col("lang_docs") >= least_docs).drop("lang_docs"), "divergence-terms")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    of_lang = kept.where("first").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("n_lang"))
    groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    # A language without kept terms has no shares; its divisor is not used.
    whole = lambda n: F.greatest(F.col(n) + F.col("terms"), F.lit(1))
    groups = written(groups.withColumns({"whole": whole("n_group"), "whole_lang": whole("n_lang")}), "divergence-groups")

    rank = lambda: F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    p, q = F.col("p"), F.col("q")
    terms = kept.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        *TERM,
        share(F.col("n"), F.col("whole")).alias("p"),
        share(F.col("lang_n"), F.col("whole_lang")).alias("q"),
    )
    terms = terms.where(p > q).select("lang", "source", term_of().alias("item"), quotient((p - q) * (p - q), q).alias("value"))
    terms = terms.withColumn("rank", rank()).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pair_distances(kept, groups).withColumn("rank", rank()).withColumn("part", F.lit("pair"))
    return pairs.select(columns).unionByName(terms.select(columns))


def twin() -> str:
    """The result of :func:`audit` on ``documents`` as DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share_of = lambda n, whole: f"1 + {SCALE} * ({n} + 1) // {whole}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n, {share_of("coalesce(c.n, 0)", "(s.n + v.v)")} AS p, {share_of("k.n", "(v.n + v.v)")} AS q
  FROM k JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}"""
