"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Only lines that occur more than once can belong to a repeated run; all others,
like the ends of a text, separate runs.  Each stretch of repeated lines is a
sequence of ids.  Doubling rounds rank the suffixes of all sequences by their
first 1, 2, 4, ... lines until every suffix is alone or has ended; only suffixes
that still share a rank take part in a round.  The last ranks order the suffix
array.  Longest common prefixes of its neighbours come from the ranks of the
rounds, and from the intervals of common prefixes each suffix learns the longest
run of lines that an earlier place has too.  Where such a run has at least
``least_words`` words, the lines of the later place are deleted.

"Earlier" is the order of (key, hash of the text, line).  A null text stays
null, a null key sorts first, and rows that repeat both key and text share one
result.  Empty lines have no words and go only as part of a run.  A text of
which nothing is left is the empty text, and its row stays.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_batches, digest128, written

#: Suffixes that one task of the interval scan holds.
CHUNK = 8_192
#: Neighbouring chunks that a node of the tree of chunks holds.
FAN = 64
#: Next ranks that are ordered in one piece, as a power of two.
NEXT_BITS = 16
KEY = ["key_id", "d1", "d2"]
#: Rows below which a table on the way is not split over more tasks: to write a file takes as long as thousands of rows.
ROWS_A_FILE = 8_192


def _files(most: int) -> int:
    """How many files ``most`` rows are worth."""
    return max(1, ceil(most / ROWS_A_FILE))


def _stored(rows: DataFrame, most: int, tag: str) -> DataFrame:
    """``rows``, at most ``most``, written by no more tasks than they are worth; many rows by as many as they are dealt to."""
    return written(rows.coalesce(_files(most)), tag)


def numbered(rows: DataFrame, by: list[str], name: str, most: int) -> tuple[DataFrame, int]:
    """``rows``, at most ``most``, with their place, from 1, in the order of ``by``, which must tell all rows apart; and how many there are.

    Sorted range partitions count on from each other, so equal leading values
    need not meet in one task.  ``part_id`` is the partition of a row.
    """
    spark = rows.sparkSession
    width = min(int(spark.conf.get("spark.sql.shuffle.partitions")), _files(most))
    order = rows.repartitionByRange(width, *by).sortWithinPartitions(*by).withColumn("at_id", F.monotonically_increasing_id())
    order = written(order, "numbered").withColumn("part_id", F.shiftright("at_id", 33))
    before, total = [], 0
    # As many entries as there are partitions.
    for part, n in sorted((r["part_id"], r["count"]) for r in order.groupBy("part_id").count().collect()):
        before.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(before, "part_id long, base_id long"))
    order = order.join(base, "part_id").withColumn(name, F.col("base_id") + F.col("at_id").bitwiseAND((1 << 33) - 1) + 1)
    return order.drop("base_id", "at_id"), total


def first_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``d1, d2, first_key``: the smallest key of each distinct text."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key_id")).alias("k"),
        *digest128(F.col(text)),
    )
    return rows.groupBy("d1", "d2").agg(F.min("k").getField("key_id").alias("first_key"))


def repeated_lines(docs: DataFrame, firsts: DataFrame, key: str, text: str) -> DataFrame:
    """Every line that occurs in two places of different texts or twice in one: row (order of texts), i (line number), words, l1, l2 (hash), left (lines of its stretch from here on).

    Later copies of a whole text are left out: what they repeat is known.
    """
    texts = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("key_id"),
        *digest128(F.col(text)),
        F.posexplode(F.split(text, "\n")).alias("i", "line"),
    )
    lines = texts.select(*KEY, "i", F.regexp_count("line", F.lit(r"\S+")).alias("words"), *digest128(F.col("line"), "l")).alias("a")
    first = firsts.alias("f")
    lines = lines.join(
        first,
        (F.col("a.d1") == F.col("f.d1")) & (F.col("a.d2") == F.col("f.d2")) & F.col("a.key_id").eqNullSafe(F.col("f.first_key")),
        "left_semi",
    )
    lines = written(lines, "lines")
    # Written, as the join can split a frequent line only between plain shuffles.
    n = lines.count()
    often = _stored(lines.groupBy("l1", "l2").count().where("count > 1").select("l1", "l2"), n // 2, "frequent-lines")
    again = _stored(lines.join(often, ["l1", "l2"]).dropDuplicates(["d1", "d2", "i"]), n, "repeated-lines")
    n = again.count()
    rows, _ = numbered(again.select(*KEY).distinct(), KEY, "row", n)
    again = again.join(rows.select("d1", "d2", "row"), ["d1", "d2"])
    by_row = W.partitionBy("row").orderBy("i")
    again = again.withColumn("fresh", (F.col("i") - F.coalesce(F.lag("i").over(by_row), F.lit(-2)) != 1).cast("int"))
    again = again.withColumn("stretch", F.sum("fresh").over(by_row))
    again = again.withColumn("left", F.max("i").over(W.partitionBy("row", "stretch")) - F.col("i") + 1).drop("fresh", "stretch")
    return _stored(again, n, "stretches")


def first_ranks(lines: DataFrame, most: int) -> DataFrame:
    """Suffixes ranked by their first line: a rank is one more than the number of smaller suffixes."""
    order, _ = numbered(lines.select("l1", "l2", "row", "i", "words", "left"), ["l1", "l2", "row", "i"], "place", most)
    # A line that fills many partitions is looked up by partition, and meets in no task.
    parts = order.groupBy("l1", "l2", "part_id").agg(F.min("place").alias("first"))
    ranks = parts.withColumn("rank", F.min("first").over(W.partitionBy("l1", "l2"))).drop("first")
    return order.join(_stored(ranks, most, "first-ranks"), ["l1", "l2", "part_id"]).select("row", "i", "words", "left", "rank", F.array("rank").alias("levels"))


def doubled(suffixes: DataFrame, h: int, most: int) -> DataFrame | None:
    """``row, i, fresh`` of at most ``most`` suffixes: new ranks by 2h lines of the suffixes that shared a rank by h lines and go on; None if there are none.

    Within its group a suffix moves up by the number of suffixes whose next h
    lines are smaller.  These are counted from one row per distinct pair, first
    by blocks of next ranks and then within a block, so that no group of a
    frequent line is ordered in one piece.
    """
    now = suffixes.select("row", "i", "rank", "left")
    open_ranks = now.groupBy("rank").agg(
        F.count("*").alias("n"),
        F.max("left").alias("most"),
    ).where((F.col("n") > 1) & (F.col("most") > h)).select("rank")
    open_ranks = _stored(open_ranks, most // 2, "open-ranks")
    ahead = now.select("row", (F.col("i") - h).alias("i"), F.col("rank").alias("next"))
    active = now.join(open_ranks, "rank").join(ahead, ["row", "i"], "left")
    active = _stored(
        active.select("row", "i", "rank", F.when(F.col("left") > h, F.col("next")).otherwise(F.lit(0)).alias("next")),
        most,
        "active",
    )
    n_active = active.count()
    if not n_active:
        return None
    smaller = lambda *keys: F.coalesce(
        F.sum("n").over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0),
    )
    pairs = active.groupBy("rank", "next").agg(F.count("*").alias("n")).withColumn("block", F.shiftright("next", NEXT_BITS))
    inner = pairs.withColumn("inner", smaller("rank", "block", "next"))
    outer = pairs.groupBy("rank", "block").agg(F.sum("n").alias("n")).withColumn("outer", smaller("rank", "block")).drop("n")
    fresh = inner.join(outer, ["rank", "block"]).select("rank", "next", (F.col("rank") + F.col("outer") + F.col("inner")).alias("fresh"))
    return active.join(_stored(fresh, n_active, "fresh-ranks"), ["rank", "next"]).select("row", "i", "fresh")


def suffix_ranks(lines: DataFrame) -> DataFrame:
    """All suffixes: row, i, words, left, rank, and levels (their ranks by 1, 2, 4, ... lines)."""
    most = lines.count()
    now, h = _stored(first_ranks(lines, most), most, "suffixes"), 1
    while (changed := doubled(now, h, most)) is not None:
        now = now.join(changed, ["row", "i"], "left").withColumn("rank", F.coalesce("fresh", "rank"))
        now = _stored(now.select("row", "i", "words", "left", "rank", F.concat("levels", F.array("rank")).alias("levels")), most, "suffixes")
        h *= 2
    return now


def _equal_level(a: str, b: str, below: Column) -> Column:
    """The highest level under ``below`` at which two suffixes have one rank, -1 if none."""
    levels = F.filter(
        F.arrays_zip(
            F.slice(a, F.lit(1), F.greatest(below, F.lit(0))).alias("a"),
            F.slice(b, F.lit(1), F.greatest(below, F.lit(0))).alias("b"),
        ),
        lambda x: x["a"] == x["b"],
    )
    return F.coalesce(F.size(levels), F.lit(0)) - 1  # equal at a level means equal at all below


def suffix_array(ranks: DataFrame) -> DataFrame:
    """Suffixes in order: ``sa`` from 1, and ``lcp``, the lines that each shares with the one before."""
    most = ranks.count()
    order = numbered(ranks, ["rank", "row", "i"], "sa", most)[0].drop("part_id")
    past = order.select(
        (F.col("sa") + 1).alias("sa"),
        F.col("row").alias("p_row"),
        F.col("i").alias("p_i"),
        F.col("rank").alias("p_rank"),
        F.col("levels").alias("b"),
    )
    same = F.col("rank") == F.col("p_rank")
    pairs = order.join(past, "sa").withColumn("k", F.when(same, -1).otherwise(_equal_level("levels", "b", F.size("levels"))))
    step = F.when(F.col("k") >= 0, F.expr("shiftleft(1, k)")).otherwise(0)
    pairs = _stored(
        pairs.select("sa", "row", "i", "p_row", "p_i", "k", F.when(same, F.col("left")).otherwise(step).alias("lcp")),
        most,
        "neighbours",
    )
    done, open_pairs = pairs.where("k <= 0").select("sa", "lcp"), pairs.where("k > 0")
    while not open_pairs.isEmpty():
        one = ranks.select("row", F.col("i").alias("x"), F.col("levels").alias("a"))
        two = ranks.select(F.col("row").alias("p_row"), F.col("i").alias("y"), F.col("levels").alias("b"))
        ahead = open_pairs.withColumns({"x": F.col("i") + F.col("lcp"), "y": F.col("p_i") + F.col("lcp")})
        ahead = ahead.join(one, ["row", "x"], "left").join(two, ["p_row", "y"], "left").withColumn("k", _equal_level("a", "b", F.col("k")))
        ahead = _stored(ahead.select("sa", "row", "i", "p_row", "p_i", "k", (F.col("lcp") + step).alias("lcp")), open_pairs.count(), "neighbours")
        done = done.union(ahead.where("k <= 0").select("sa", "lcp"))
        open_pairs = ahead.where("k > 0")
    return order.join(done, "sa", "left").select("sa", "row", "i", "words", "left", F.coalesce("lcp", F.lit(0)).alias("lcp"))


def cut_back(stack: list, gap: int) -> None:
    """Common prefixes in a stack of (place, prefix) cannot be longer than ``gap`` any more."""
    place = None
    while stack and stack[-1][1] > gap:
        place = stack.pop()[0]
    if place is not None and gap and not (stack and stack[-1][1] == gap):
        stack.append((place, gap))


def add_place(stack: list, place: tuple, left: int) -> int:
    """Put a suffix on the stack; returns the longest prefix that an earlier place on it shares.

    Prefixes and places both grow from bottom to top: a place with a shorter
    prefix is of use only if it comes before all places with longer ones.
    """
    while stack and stack[-1][0] > place:
        stack.pop()
    best = stack[-1][1] if stack else 0
    stack.append((place, left))
    return best


def sweep(places: list, lefts: list, lcps: list, low: list, high: list) -> tuple[list[int], list, list]:
    """A chunk of the suffix array in both directions: the longest earlier prefix of each suffix, and the stacks at both ends."""
    best, up, down = [], list(low), list(high)
    for place, left, gap in zip(places, lefts, lcps):
        cut_back(up, gap)
        best.append(add_place(up, place, left))
    for n in range(len(places) - 1, -1, -1):
        best[n] = max(best[n], add_place(down, places[n], lefts[n]))
        cut_back(down, lcps[n])
    return best, up, down


def _columns(chunk: pd.DataFrame) -> tuple[list, list, list]:
    chunk = chunk.sort_values("sa")
    return list(zip(chunk["row"].tolist(), chunk["i"].tolist())), chunk["left"].tolist(), chunk["lcp"].tolist()


def _flat(stack: list) -> list:
    return [[row, i, prefix] for (row, i), prefix in stack]


def _stack(flat) -> list:
    return [((int(row), int(i)), int(prefix)) for row, i, prefix in flat]


def _ends(chunk: pd.DataFrame) -> pd.DataFrame:
    places, lefts, lcps = _columns(chunk)
    _, up, down = sweep(places, lefts, lcps, [], [])
    return pd.DataFrame({"chunk": chunk["chunk"].iloc[:1].to_numpy(), "least": [min(lcps)], "up": [_flat(up)], "down": [_flat(down)]})


def _meet(outer: list, least: int, own: list) -> list:
    """The stack behind a chunk: what lay before it, as far as common prefixes reach through, under its own."""
    stack = list(outer)
    cut_back(stack, least)
    first = own[0][0] if own else None
    while stack and first is not None and stack[-1][0] > first:
        stack.pop()
    return [*stack, *own]


def _merged(children: pd.DataFrame) -> pd.DataFrame:
    """The stacks at both ends of neighbouring chunks taken as one."""
    children = children.sort_values("chunk")
    leasts, up, down = children["least"].tolist(), [], []
    for least, own in zip(leasts, children["up"]):
        up = _meet(up, least, _stack(own))
    for least, own in zip(reversed(leasts), reversed(children["down"].tolist())):
        down = _meet(down, least, _stack(own))
    return pd.DataFrame({"chunk": children["parent"].iloc[:1].to_numpy(), "least": [min(leasts)], "up": [_flat(up)], "down": [_flat(down)]})


def _passed_on(children: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    """What lies before and behind each of some neighbouring chunks, from what lies around all of them."""
    children = children.sort_values("chunk")
    leasts, low, high = children["least"].tolist(), [], []
    stack = _stack(around["low"].iloc[0]) if len(around) else []
    for least, own in zip(leasts, children["up"]):
        low.append(_flat(stack))
        stack = _meet(stack, least, _stack(own))
    stack = _stack(around["high"].iloc[0]) if len(around) else []
    for least, own in zip(reversed(leasts), reversed(children["down"].tolist())):
        high.append(_flat(stack))
        stack = _meet(stack, least, _stack(own))
    return pd.DataFrame({"chunk": children["chunk"].to_numpy(), "low": low, "high": high[::-1]})


_ENDS = "chunk long, least long, up array<array<long>>, down array<array<long>>"
_AROUND = "chunk long, low array<array<long>>, high array<array<long>>"


def _all_around(ends: DataFrame, n: int) -> DataFrame:
    """``chunk, low, high``: the stacks before and behind each of ``n`` chunks, by a tree of FAN chunks a node."""
    levels = [_stored(ends, n * CHUNK, "chunk-ends")]
    while levels[-1].select("chunk").limit(2).count() > 1:
        parents = levels[-1].withColumn("parent", F.floor(F.col("chunk") / FAN).cast("long")).groupBy("parent")
        n = ceil(n / FAN)
        levels.append(_stored(parents.applyInPandas(_merged, _ENDS), n * CHUNK, "chunk-ends"))
    around = ends.sparkSession.createDataFrame([(0, [], [])], _AROUND)
    for children in reversed(levels[:-1]):
        children = children.withColumn("parent", F.floor(F.col("chunk") / FAN).cast("long"))
        children = children.groupBy("parent").cogroup(around.groupBy("chunk"))
        n *= FAN
        around = _stored(children.applyInPandas(_passed_on, _AROUND), n * CHUNK, "around-chunks")
    return around


def _finished(chunk: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
    places, lefts, lcps = _columns(chunk)
    best, _, _ = sweep(places, lefts, lcps, _stack(around["low"].iloc[0]), _stack(around["high"].iloc[0]))
    rows, lines = zip(*places)
    return pd.DataFrame({"row": rows, "i": lines, "shared": best})


def shared_runs(array: DataFrame, most: int) -> DataFrame:
    """``row, i, shared`` of at most ``most`` suffixes: the longest run of lines from there that an earlier place has too.

    Chunks of the suffix array are scanned on their own; an interval of common
    prefixes that crosses chunks is passed on by the stacks at their ends, which
    are no longer than the longest common prefix there.  Stacks are merged up a
    tree of chunks and passed down again, so no task or driver holds all of them.
    """
    arrow_batches(array.sparkSession)
    chunks = _stored(
        array.select(F.floor((F.col("sa") - 1) / CHUNK).cast("long").alias("chunk"), "sa", "row", "i", "left", "lcp"),
        most,
        "chunks",
    )
    around = _all_around(chunks.groupBy("chunk").applyInPandas(_ends, _ENDS), ceil(most / CHUNK))
    return chunks.groupBy("chunk").cogroup(around.groupBy("chunk")).applyInPandas(_finished, "row long, i long, shared long")


def _covered(least_words: int):
    def run(frames):
        for frame in frames:
            gone = []
            for lines in frame["lines"]:
                upto, total = {}, 0
                for line in lines:
                    upto[line["i"]] = (total, total := total + line["words"])
                out, end = [], -1
                for line in lines:
                    at, shared = line["i"], line["shared"]
                    if shared and upto[at + shared - 1][1] - upto[at][0] >= least_words:
                        end = max(end, at + shared - 1)
                    if at <= end:
                        out.append(at)
                gone.append(out)
            yield frame[["row"]].assign(gone=gone)

    return run


def later_copies(docs: DataFrame, firsts: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """``d1, d2, gone``: the line numbers to delete of each distinct text that repeats earlier runs."""
    lines = repeated_lines(docs, firsts, key, text)
    if lines.isEmpty():
        return lines.select("d1", "d2", F.array("i").alias("gone"))
    runs = shared_runs(suffix_array(suffix_ranks(lines)), lines.count())
    by_row = runs.join(lines.select("row", "i", "words"), ["row", "i"]).groupBy("row")
    by_row = by_row.agg(
        F.sort_array(F.collect_list(F.struct("i", "words", "shared"))).alias("lines"),
        F.max("shared").alias("most"),
    ).where("most > 0")
    gone = by_row.select("row", "lines").mapInPandas(_covered(least_words), "row long, gone array<int>").where(F.size("gone") > 0)
    return gone.join(lines.select("row", "d1", "d2").distinct(), "row").select("d1", "d2", "gone")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """All rows and columns of ``docs`` with later copies of runs deleted, and ``n_lines`` and ``n_deleted``.

    Of a whole text's copies only the first, found by key and text, keeps lines;
    a copy of fewer than ``least_words`` words holds no run that counts and stays.
    """
    firsts = _stored(first_copies(docs, key, text), docs.count(), "first-copies")
    gone = later_copies(docs, firsts, key, text, least_words)
    gone = _stored(firsts.join(gone, ["d1", "d2"], "left"), firsts.count(), "deleted-lines").alias("g")
    rows = docs.select(F.struct(*docs.columns).alias("doc_row"), F.col(key).alias("key_id"), *digest128(F.col(text))).alias("r")
    # Keys spread the copies of one text.
    same = F.col("r.key_id").eqNullSafe(F.col("g.first_key")) & (F.col("r.d1") == F.col("g.d1")) & (F.col("r.d2") == F.col("g.d2"))
    rows = rows.join(gone, same, "left").select("doc_row", "gone", F.col("g.d1").isNull().alias("later"))
    whole = F.col("doc_row")[text]
    lines = F.split(whole, "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    copied = F.coalesce(whole.isNotNull() & F.col("later") & (F.regexp_count(whole, F.lit(r"\S+")) >= least_words), F.lit(False))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_deleted = F.when(F.col("copied"), n_lines).otherwise(F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    kept_text = F.when(F.col("copied"), "").when(F.col("gone").isNull(), whole).otherwise(left)
    columns = [kept_text.alias(c) if c == text else F.col("doc_row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return rows.withColumn("copied", copied).select(*columns, n_lines.alias("n_lines"), n_deleted.alias("n_deleted"))
