"""A mirror of raw events that grows for years, and takes each event once.

Under a path: ``events/received_day=/batch=/``, ``marks/batch=/`` with how far each
batch has come, and ``known/batch=/`` with a Bloom filter of its ids.  A batch
reads again from the newest mark less a grace, looks for its ids in the days
around its own, and asks the filters for the rest; only if they may hold an id are older days
read, for those ids alone.  So a usual batch reads a few days, however long the mirror is.
Filters of finished batches are merged by :meth:`Mirror.compact` now and then.

A batch that is run again replaces what it wrote and does not see it, so a
crash between a write and the stream's commit repeats the batch with the same result.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bloom
from ..operators.dedup import first_by
from ..sources.scratch import discard, temporary, written

MARK = "newest timestamp, batch long"
FILTER = "bucket long, bitmap binary, batch long"


class Mirror:
    """The mirror at ``path`` of events of ``schema`` with an id and the instant of their receipt."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        floor: datetime,
        key: str = "id",
        stamp: str = "received_at",
        grace_seconds: int = 300,
        days_around: int = 3,
        expected: int = 100_000_000,
    ):
        """``floor`` is the first instant of the data.

        Ids are looked for in ``days_around`` days before a batch's first event.
        The filters are sized for ``expected`` ids; more are found as well, only
        more slowly.
        """
        self.spark, self.path, self.schema, self.floor = spark, path, schema, floor
        self.key, self.stamp, self.grace_seconds, self.days_around = key, stamp, grace_seconds, days_around
        self.buckets = bloom.buckets_for(expected)
        if not self._exists():
            for part, of in (("events", self._event_schema()), ("marks", MARK), ("known", FILTER)):
                spark.createDataFrame([], of).write.mode("ignore").parquet(f"{path}/{part}")

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/known")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _event_schema(self) -> T.StructType:
        return T.StructType([*self.schema, T.StructField("received_day", T.DateType()), T.StructField("batch", T.LongType())])

    def stored(self) -> DataFrame:
        """All events with their day and batch."""
        return self.spark.read.schema(self._event_schema()).parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        return self.stored().select(*self.schema.names)

    def start(self, batch_id: int) -> datetime:
        """From where a batch reads: the newest mark of other batches less the grace, never below the floor."""
        marks = self.spark.read.schema(MARK).parquet(f"{self.path}/marks").where(F.col("batch") != batch_id)
        newest = marks.agg(F.max("newest")).first()[0]
        return max(self.floor, newest - timedelta(seconds=self.grace_seconds)) if newest else self.floor

    def near(self, batch_id: int, first_day) -> DataFrame:
        """Ids of other batches in the days around: a scan of these partitions."""
        rows = self.stored().where(
            (F.col("batch") != batch_id) & (F.col("received_day") >= F.lit(first_day - timedelta(days=self.days_around)))
        )
        return rows.select(self.key)

    def take(self, arrivals: DataFrame, batch_id: int) -> None:
        """Store what of ``arrivals`` is new; of repeated ids the first by time."""
        with temporary(self.spark):
            self._take(arrivals, batch_id)

    def _take(self, arrivals: DataFrame, batch_id: int) -> None:
        late = arrivals.where(F.col(self.stamp) >= F.lit(self.start(batch_id)))
        late = written(first_by(late, [self.key], [F.col(self.stamp)]).withColumn("received_day", F.to_date(self.stamp)), "arrivals")
        first_day = late.agg(F.min("received_day")).first()[0]
        fresh = late
        if first_day is not None:
            rest = written(late.join(self.near(batch_id, first_day), self.key, "left_anti"), "arrivals-rest")
            filters = self.spark.read.schema(FILTER).parquet(f"{self.path}/known").where(F.col("batch") != batch_id)
            maybe = written(bloom.maybe_seen(rest, self.key, filters, self.buckets), "maybe-seen")
            fresh = rest
            if not maybe.isEmpty():
                older = self.stored().where(
                    (F.col("batch") != batch_id) & (F.col("received_day") < F.lit(first_day - timedelta(days=self.days_around)))
                )
                fresh = rest.join(older.select(self.key).join(maybe, self.key, "left_semi"), self.key, "left_anti")
        self._put(fresh.select(*self.schema.names, "received_day"), "events", batch_id, ["received_day"])
        added = self.stored().where(F.col("batch") == batch_id)
        self._put(bloom.build(added, self.key, self.buckets), "known", batch_id)
        self._put(late.agg(F.max(self.stamp).alias("newest")), "marks", batch_id)

    def compact(self, before: int) -> None:
        """Merge the filters of the batches before one that will not run again; a filter that is merged twice is the same."""
        rows = self.spark.read.schema(FILTER).parquet(f"{self.path}/known").where(F.col("batch") < before)
        batches = [r["batch"] for r in rows.select("batch").distinct().collect() if r["batch"] >= 0]  # as many as batches since the last time
        with temporary(self.spark):
            self._put(written(bloom.merged(rows), "merged-filters"), "known", -1)
        discard(self.spark, [f"{self.path}/known/batch={b}" for b in batches])

    def _put(self, rows: DataFrame, part: str, batch_id: int, by: list[str] | None = None) -> None:
        """Store rows of a batch instead of those that it stored before."""
        cells = [*(by or []), "batch"]
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        rows = rows.hint("rebalance", *by) if by else rows  # few files a day, and a large day split over tasks
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cells).parquet(f"{self.path}/{part}")
