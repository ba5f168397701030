"""Written tables: partitioned state, day snapshots, and window backfills."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checksums, state
from ..plans import orders


def write_events(events: DataFrame, path: str) -> None:
    """Raw events partitioned by the day they were received, so that scans of a window read its days only."""
    events.withColumn("received_day", F.to_date("received_at")).write.mode("append").partitionBy("received_day").parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source", "order_key"), F.lit(buckets)).cast("int")


def write_orders(rows: DataFrame, path: str, buckets: int) -> None:
    """The order table by a hash of its key: an order stays in its bucket when its date moves.

    Deleted orders stay as marks, so that no bucket is left without a file.
    """
    rows = rows.withColumns({"is_deleted": F.col("change") == "deleted", "bucket": _bucket(buckets)}).drop("change")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("not is_deleted").drop("is_deleted", "bucket")


def update_orders(
    events: DataFrame,
    resolutions: DataFrame,
    path: str,
    buckets: int,
    first_day: date,
    last_day: date,
    as_of: datetime | None = None,
) -> None:
    """Materialise days into a stored order table; only buckets that hold a touched order are read whole and rewritten."""
    spark = events.sparkSession
    keys = orders.touched(read_orders(spark, path), events, resolutions, first_day, last_day)
    # At most as many numbers as there are buckets.
    hit = sorted(r["bucket"] for r in keys.select(_bucket(buckets).alias("bucket")).distinct().collect())
    current = spark.read.parquet(path).where(F.col("bucket").isin(hit) & ~F.col("is_deleted")).drop("is_deleted", "bucket")
    write_orders(
        orders.materialize(current, events, resolutions, first_day, last_day, as_of).where(_bucket(buckets).isin(hit)),
        path,
        buckets,
    )


def snapshot_day(entries: DataFrame, day: date, zone: str, path: str) -> None:
    """All entries of one local day; a day that is written again is replaced, other days stay."""
    rows = entries.where(S.local_day(F.col("occurred_at"), zone) == F.lit(day)).withColumn("day", F.lit(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_snapshot(spark: SparkSession, day: date, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("day") == F.lit(day)).drop("day")


def backfill_window(
    mirror: DataFrame,
    upstream: DataFrame,
    start: datetime,
    end: datetime,
    floor: datetime,
    content: list[str],
) -> DataFrame:
    """The mirror with upstream's events of a half-open window merged in; a start below the floor is refused."""
    if start < floor:
        raise ValueError(f"the window starts at {start}, below the floor of the data at {floor}")
    return state.upsert_raw_events(mirror, in_window(upstream, start, end), content)


def in_window(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return events.where((F.col("received_at") >= F.lit(start)) & (F.col("received_at") < F.lit(end)))


def window_differences(mirror: DataFrame, upstream: DataFrame, start: datetime, end: datetime, content: list[str]) -> DataFrame:
    """Events of a window that only one side has, or whose content differs; equal sides are told by checksums, without a join of rows."""
    return checksums.diff(in_window(upstream, start, end), in_window(mirror, start, end), ["id"], content)


def window_counts(mirror: DataFrame, upstream: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Events of the window on both sides by source: the check before and after a backfill."""
    sides = [
        in_window(rows, start, end).select("source", F.lit(side).alias("side"))
        for side, rows in (("mirror", mirror), ("upstream", upstream))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy("source").agg(
        F.count_if(F.col("side") == "mirror").alias("mirrored"),
        F.count_if(F.col("side") == "upstream").alias("upstream"),
    )
    return counts.withColumn("missing", F.col("upstream") - F.col("mirrored"))
