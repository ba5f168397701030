"""Streaming ingestion and change application, with file sources and batch-wise state."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..operators.dedup import first_by


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fresh_events(stream: DataFrame, key: str = "id", stamp: str = "received_at", grace: str = "5 minutes", floor=None) -> DataFrame:
    """Events not seen before within the grace, none below the floor of the data."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp"))
    timed = timed if floor is None else timed.where(F.col(stamp) >= F.lit(floor))
    return timed.withWatermark(stamp, grace).dropDuplicatesWithinWatermark([key])


def incremental(
    stored: DataFrame,
    arrivals: DataFrame,
    floor: datetime,
    key: str = "id",
    stamp: str = "received_at",
    grace_seconds: int = 300,
) -> DataFrame:
    """Arrivals that a mirror lacks: read again from its newest instant less the grace, or from the floor if it is empty.

    Ids that are stored are never taken twice, however old they are; of repeated
    arrivals one is taken, the first by time.
    """
    top = stored.agg(F.max(stamp).alias("_top"))
    start = F.greatest(F.coalesce(F.col("_top") - F.make_interval(secs=F.lit(grace_seconds)), F.lit(floor)), F.lit(floor))
    late = arrivals.join(top, F.lit(True)).where(F.col(stamp) >= start).drop("_top")  # the right side is one row
    return first_by(late, [key], [F.col(stamp)]).join(stored.select(key), key, "left_anti").select(arrivals.columns)


def unseen(stream: DataFrame, key: str = "event_id", stamp: str = "ts", kept: str = "7 days") -> DataFrame:
    """Notifications by the first that carries each id; ids are remembered for the time that senders may repeat them."""
    return stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, kept).dropDuplicatesWithinWatermark([key])


def daily_totals(stream: DataFrame, stamp: str = "processed_at", late: str = "2 days", offset: str = "3 hours") -> DataFrame:
    """Cents and number of payments per gateway and local day, a day of UTC moved by ``offset``."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    grouped = timed.groupBy(F.window(stamp, "1 day", "1 day", offset).alias("w"), "gateway_raw").agg(
        F.sum("amount_cents").cast("long").alias("amount_cents"),
        F.count("*").alias("n"),
    )
    return grouped.select(F.to_date("w.start").alias("day"), "gateway_raw", "amount_cents", "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that has arrived, in micro-batches, then stop; the checkpoint makes restarts exact."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_changes(changes: DataFrame, problem) -> tuple[DataFrame, DataFrame]:
    """Valid changes and dead letters with their reason."""
    judged = changes.withColumn("reason", problem)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def last_change(changes: DataFrame, key: str = "record_id", order: str = "event_id") -> DataFrame:
    return first_by(changes, [key], [F.desc(order)])


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "record_id", order: str = "event_id") -> DataFrame:
    """The state after a batch: the last change of each record wins, and a deletion removes it."""
    last = last_change(changes, key, order)
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("operation <> 'DELETE'").select(*state.columns))


def repair_backlog(mirror: DataFrame, upstream: DataFrame, queued: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows to fetch for queued ids that the mirror lacks, and queued ids that have vanished upstream."""
    missing = queued.select(key).distinct().join(mirror.select(key), key, "left_anti")
    return upstream.join(missing, key, "left_semi"), missing.join(upstream.select(key), key, "left_anti")


def cycle_totals(cycles: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of successive cycles merged to one row."""
    return cycles.agg(
        *[S.zero(F.sum(c)).cast("long").alias(c) for c in counters],
        F.min("started_at").alias("first_started_at"),
        F.max("started_at").alias("last_started_at"),
    )
