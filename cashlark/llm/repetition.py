"""Quality rules by repetition coverage: how much of a text stands inside repeated n-grams and lines.

One scan measures whole texts in numpy, a block of texts at a time.  Words are
numbered exactly, and rolling hashes of the numbers, for several n-gram lengths
from one prefix sum, find the windows of a text that occur in it twice or more.
An n-gram can only repeat where its beginning does, so each length looks only at
the windows that the one before left.  Equal hashes are compared word by word;
should two different windows ever share a hash, that block is compared exactly.
Overlapping windows cover a word once.  Nothing is shuffled.

The base rule counts every place of a repeated window of three words.  The
limits of the method count later copies only, as the first copy is not too much
of anything, and hold from ``LEAST_CHARS`` copied characters on: one sentence
said twice does not make a short text repetitive.

Words are what stands between blanks, ``[^\\x20\\x09-\\x0D]+``.  A null or empty
text has no words and fails the base rules; a null id is kept as it is, and
repeated rows are measured each on their own.  A text longer than a block is
measured alone, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import blocks
from .common import arrow_batches

#: Length of the windows of the base rule, then of the windows whose characters are measured.
BASE_WINDOW, LENGTHS = 3, (5, 6, 7, 8, 9, 10)
#: Largest share, in percent, of a text's word characters inside later copies of windows of each length.
MOST_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Largest share, in percent, of word characters in lines that repeat an earlier one, and of such lines.
MOST_LINE_CHARS, MOST_LINES = 20, 30
#: Fewest characters in copies from which these shares count.
LEAST_CHARS = 100
BASE_WORDS, BASE_PERCENT = 50, 50

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "dup_line_chars",
    "n_repeat_words",
    *[f"dup_chars_{n}" for n in LENGTHS],
]

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = values.astype(np.uint64) + np.uint64(_FACTOR)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of one sequence of word numbers, for any length."""

    def __init__(self, words: np.ndarray):
        powers = np.full(len(words) + 1, _INVERSE, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * np.cumprod(powers)[:-1])])
        factors = np.full(len(words) + 1, _FACTOR, np.uint64)
        factors[0] = 1
        self.scale = np.cumprod(factors)

    def of(self, starts: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[starts + n] - self.sums[starts]) * self.scale[starts]


def repeated_windows(words: np.ndarray, doc: np.ndarray, hashes: Rolling, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``starts`` whose window of ``n`` words lies in one text and occurs there twice or more, in order; and those that copy an earlier one."""
    starts = starts[starts + n <= len(words)]
    starts = starts[doc[starts] == doc[starts + n - 1]]
    if len(starts) < 2:
        return starts[:0], starts[:0]
    keys = hashes.of(starts, n) ^ mixed(doc[starts])
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    a, b = starts[order[:-1][same]], starts[order[1:][same]]
    equal = doc[a] == doc[b]
    for k in range(n):
        equal &= words[a + k] == words[b + k]
    if equal.all():
        return np.unique(np.concatenate([a, b])), np.sort(b)
    rows = np.column_stack([doc[starts], *(words[starts + k] for k in range(n))])
    _, first, back, count = np.unique(rows, axis=0, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(starts), bool)
    later[first] = False
    return starts[count[back.reshape(-1)] > 1], starts[later]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words at ``starts``."""
    edges = np.zeros(size + 1, np.int32)
    edges[starts] += 1
    edges[starts + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def measures(texts: list[str]) -> dict[str, np.ndarray]:
    """Every measure of each text of a block."""
    size = len(texts)
    column = pa.array(texts, pa.large_string())
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = ("\n".join(texts) + "\n").encode()
    raw = np.frombuffer(data, np.uint8)
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)])  # of each text; its end is a line end of its own
    per_doc = lambda doc, weights=None: np.bincount(doc, weights, size).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    doc = np.searchsorted(firsts, begin, "right") - 1
    chars = points[end] - points[begin]
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars)}
    out["n_symbols"] = per_doc(np.searchsorted(firsts, np.flatnonzero(_SYMBOL[raw]), "right") - 1)

    line_edges = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(line_edges) - 1, [None, pa.py_buffer(line_edges.astype(np.int64).tobytes()), pa.py_buffer(data)])
    until = np.searchsorted(begin, line_edges)
    worded = np.flatnonzero(until[1:] > until[:-1])
    codes = lines.take(pa.array(worded)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_doc = np.searchsorted(firsts, line_edges[worded], "right") - 1
    again = np.ones(len(worded), bool)
    again[np.unique(line_doc * (len(worded) + 1) + codes, return_index=True)[1]] = False
    up_to = np.concatenate([[0], np.cumsum(chars)])
    line_chars = up_to[until[worded + 1]] - up_to[until[worded]]
    out["n_lines"], out["n_dup_lines"] = per_doc(line_doc), per_doc(line_doc[again])
    out["dup_line_chars"] = per_doc(line_doc[again], line_chars[again])

    if len(begin):
        both = np.concatenate([edges, [len(raw)]]).astype(np.int64)  # words and what stands between them, in turn
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both.tobytes()), pa.py_buffer(data)])
        words = pieces.take(pa.array(np.arange(0, len(both) - 1, 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    else:
        words = np.zeros(0, np.int32)
    hashes, starts = Rolling(words), np.arange(len(words))
    for n in (BASE_WINDOW, *LENGTHS):
        starts, later = repeated_windows(words, doc, hashes, starts, n)
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_doc(doc[covered(starts, n, len(words))])
        else:
            under = covered(later, n, len(words))
            out[f"dup_chars_{n}"] = per_doc(doc[under], chars[under])
    return out


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None), with every measure of the whole text.

    Columns of ``docs`` that are named as a measure are replaced.
    """
    arrow_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    whole = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("whole_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            parts = [measures(texts[a:b]) for a, b in blocks(texts)]
            found = [pa.array(np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *found], schema.names)

    return whole.mapInArrow(run, schema)


def base_failed() -> Column:
    """Too few words, or over half of them in windows of three words that repeat."""
    return (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_PERCENT)


def passes() -> Column:
    """The base rules hold, and no length covers more characters than its limit."""
    verdict = ~base_failed()
    few = F.col("dup_line_chars") < LEAST_CHARS
    verdict &= few | (F.col("dup_line_chars") * 100 <= F.col("word_chars") * MOST_LINE_CHARS)
    verdict &= few | (F.col("n_dup_lines") * 100 <= F.col("n_lines") * MOST_LINES)
    for n, percent in MOST_PERCENT.items():
        copied = F.col(f"dup_chars_{n}")
        verdict &= (copied < LEAST_CHARS) | (copied * 100 <= F.col("word_chars") * percent)
    return verdict


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, every measure, whether the base rules fail, and whether it is kept."""
    return measure(docs, text, [key]).withColumn("base_failed", base_failed()).withColumn("kept", passes())


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text_of_row"))
    return measure(row, "text_of_row", ["row"]).where(passes()).select("row.*")


def twin() -> str:
    """The result of :func:`judged` on ``documents`` as DuckDB SQL."""
    lengths = (BASE_WINDOW, *LENGTHS)
    grams = ", ".join(f"CASE WHEN i + {n - 1} <= size THEN [{', '.join('w' if k == 0 else f'lead(w, {k}) OVER o' for k in range(n))}] END AS g{n}" for n in lengths)
    of = lambda n: "count(*) OVER (PARTITION BY rid, g3)" if n == BASE_WINDOW else f"row_number() OVER (PARTITION BY rid, g{n} ORDER BY i)"
    dups = ", ".join(f"g{n} IS NOT NULL AND {of(n)} > 1 AS r{n}" for n in lengths)
    under = ", ".join(f"bool_or(r{n}) OVER (PARTITION BY rid ORDER BY i ROWS {n - 1} PRECEDING) AS c{n}" for n in lengths)
    sums = ", ".join(f"sum(CASE WHEN c{n} THEN length(w) ELSE 0 END) AS dup_chars_{n}" for n in LENGTHS)
    whole = [m for m in MEASURES if m != "n_words"]
    limits = " AND ".join(f"(dup_chars_{n} < {LEAST_CHARS} OR dup_chars_{n} * 100 <= word_chars * {p})" for n, p in MOST_PERCENT.items())
    in_lines = f"dup_line_chars * 100 <= word_chars * {MOST_LINE_CHARS} AND n_dup_lines * 100 <= n_lines * {MOST_LINES}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS size FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT rid, i, w, {grams} FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w, {dups} FROM g),
c AS (SELECT rid, w, {under} FROM r),
per_word AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(CASE WHEN c{BASE_WINDOW} THEN 1 ELSE 0 END) AS n_repeat_words, {sums} FROM c GROUP BY rid),
l AS (SELECT rid, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT rid, string_split(t, chr(10)) AS ls FROM d)),
again AS (SELECT rid, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS later FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
per_line AS (SELECT rid, count(*) AS n_lines, sum(CASE WHEN later THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN later THEN chars ELSE 0 END) AS dup_line_chars FROM again GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, {", ".join(f"CAST(coalesce({m}, 0) AS BIGINT) AS {m}" for m in whole if m != "n_symbols")}
  FROM d LEFT JOIN per_word USING (rid) LEFT JOIN per_line USING (rid)),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND (dup_line_chars < {LEAST_CHARS} OR {in_lines}) AND {limits} AS kept FROM b"""
