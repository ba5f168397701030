"""Change events applied to records, with rejected ones tried again by later batches.

Under a path: ``records/batch=/`` holds what each batch changed, newest change
last, and ``queue/batch=/`` what became of changes that were rejected.  A batch
takes its own changes and those of the queue that are due.  Valid ones are
applied unless the record has a newer change; rejected ones wait with a growing
delay and are dead after the last attempt.  A batch that is run again replaces
what it wrote and reads only what the batches before it did, at the same time of its clock.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import RETRY_SECONDS
from ..operators.dedup import first_by
from ..plans.health import retry_schedule
from ..sources.scratch import temporary, written


class ChangeFeed:
    """A sink of micro-batches of changes ``event_id, operation, record_id, payload`` and more columns.

    ``judge`` adds ``reason`` to changes, null for valid ones; it may join tables
    that grow, which is how a rejected change heals.  ``clock`` gives the time of
    a batch by its id.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        judge: Callable[[DataFrame, int], DataFrame],
        clock: Callable[[int], datetime],
        delays: list[int] = RETRY_SECONDS,
    ):
        self.spark, self.path, self.schema, self.judge, self.clock, self.delays = spark, path, schema, judge, clock, delays
        batch = T.StructField("batch", T.LongType())
        extra = T.StructType.fromDDL("reason string, attempts int, state string, next_attempt_at timestamp")
        self.queue_schema, self.record_schema = T.StructType([*schema, *extra, batch]), T.StructType([*schema, batch])
        for part, of in (("records", self.record_schema), ("queue", self.queue_schema)):
            spark.createDataFrame([], of).write.mode("append").parquet(f"{path}/{part}")

    def _read(self, part: str, schema: T.StructType, before: int | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def queue(self, before: int | None = None) -> DataFrame:
        """The last state of every change that was ever rejected: waiting, healed or dead."""
        return first_by(self._read("queue", self.queue_schema, before), ["event_id"], [F.desc("batch")])

    def changed(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The last applied change of each record, or of those of ``of``, deletions too."""
        rows = self._read("records", self.record_schema, before)
        rows = rows if of is None else rows.join(of.select("record_id").distinct(), "record_id", "left_semi")
        return first_by(rows, ["record_id"], [F.desc("event_id"), F.desc("batch")])

    def records(self) -> DataFrame:
        return self.changed().where("operation <> 'DELETE'").drop("batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        with temporary(self.spark):
            self._take(batch, batch_id)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        now = F.lit(self.clock(batch_id)).cast("timestamp")
        waiting = self.queue(batch_id).where(
            (F.col("state") == "waiting") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
        )
        own = batch.select(*self.schema.names).withColumn("attempts", F.lit(0))
        tried = first_by(own.unionByName(waiting.select(*own.columns)), ["event_id"], [F.desc("attempts")])
        judged = written(self.judge(tried, batch_id), "judged-changes")
        good, bad = judged.where("reason IS NULL"), judged.where("reason IS NOT NULL")
        last = first_by(good, ["record_id"], [F.desc("event_id")])
        applied = self.changed(batch_id, good).select("record_id", F.col("event_id").alias("applied_id"))
        newer = last.join(applied, "record_id", "left").where("applied_id IS NULL OR event_id > applied_id")
        self._put(newer.select(*self.schema.names), "records", batch_id)
        failed = retry_schedule(bad.withColumn("attempts", F.col("attempts") + 1), now, self.delays)
        failed = failed.withColumn("state", F.when(F.col("outcome") == "dead_letter", "dead").otherwise("waiting"))
        healed = good.where("attempts > 0").withColumns({"state": F.lit("healed"), "next_attempt_at": F.lit(None).cast("timestamp")})
        columns = [c for c in self.queue_schema.names if c != "batch"]
        self._put(failed.select(columns).unionByName(healed.select(columns)), "queue", batch_id)

    def _put(self, rows: DataFrame, part: str, batch_id: int) -> None:
        """Store rows of a batch instead of those that it stored before."""
        rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{part}")
