"""Places of rows in an order, without sorting a frequent key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written


def _ranged(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Sorted range partitions over group and order, written once, with ``_part`` and the row's place there.

    Written, as ranges that a lost task samples anew could differ.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(width, group, *order).sortWithinPartitions(group, *order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_j``, their place in the group from 0, and ``_n``, the rows of the group; ``order`` must tell rows apart.

    Partitions are contiguous, so the counts of the partitions of a group, at most
    as many as there are partitions and groups, give where each of them begins.
    """
    placed = _ranged(rows, group, order)
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_own"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_own").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_n": F.sum("_own").over(W.partitionBy(group))})
    both = placed.join(parts.select(group, "_part", "_first", "_before", "_n"), [group, "_part"])
    return both.withColumn("_j", F.col("_before") + F.col("_at") - F.col("_first")).select(*rows.columns, "_j", "_n")


def discrete_percentile(rows: DataFrame, group: str, value: str, percent: int) -> DataFrame:
    """``group, value``: the smallest value that at least ``percent`` percent of a group's known values do not exceed.

    Values are counted, the counts lie in sorted range partitions, and the sums
    of these tell which partition holds the place; only that one is summed up
    value by value.  No task gathers the values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_k"))
    placed = _ranged(counts, group, [value])
    parts = placed.groupBy(group, "_part").agg(F.sum("_k").alias("_own"))
    up_to = F.sum("_own").over(W.partitionBy(group).orderBy("_part"))
    parts = parts.withColumns({"_up_to": up_to, "_n": F.sum("_own").over(W.partitionBy(group))})
    place = F.floor((F.col("_n") * percent + 99) / 100)
    here = parts.withColumn("_place", place).where(
        (F.col("_place") <= F.col("_up_to")) & (F.col("_place") > F.col("_up_to") - F.col("_own"))
    )
    held = placed.join(here.select(group, "_part", "_place", (F.col("_up_to") - F.col("_own")).alias("_before")), [group, "_part"])
    reached = F.col("_before") + F.sum("_k").over(W.partitionBy(group).orderBy(value))
    return held.withColumn("_reached", reached).where("_reached >= _place").groupBy(group).agg(F.min(value).alias(value))


def largest_gaps(rows: DataFrame, group: str, instant: str, width: str = "1 day") -> DataFrame:
    """``group, gap_micros``: the longest time between neighbouring instants of a group; null with one instant.

    Windows of ``width`` are sorted each on its own, and then one row of each, its
    first and last instant and the largest gap inside, stand in for it.
    """
    micros = F.unix_micros(F.col(instant).cast("timestamp"))
    timed = rows.where(F.col(instant).isNotNull()).select(
        group,
        micros.alias("_t"),
        F.window(F.col(instant).cast("timestamp"), width)["start"].alias("_w"),
    )
    inner = timed.withColumn("_gap", F.col("_t") - F.lag("_t").over(W.partitionBy(group, "_w").orderBy("_t")))
    windows = inner.groupBy(group, "_w").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_gap").alias("_gap"))
    between = F.col("_first") - F.lag("_last").over(W.partitionBy(group).orderBy("_w"))
    return windows.withColumn("_between", between).groupBy(group).agg(F.max(F.greatest("_gap", "_between")).alias("gap_micros"))
