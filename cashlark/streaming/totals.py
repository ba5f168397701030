"""Running day totals of payments: a stateful aggregation in update mode with an upserting sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_by
from .ingest import daily_totals, run_once

TOTAL = "day date, gateway_raw string, amount_cents long, n long, batch long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of each day and gateway."""
    rows = spark.read.schema(TOTAL).parquet(path)
    return first_by(rows, ["day", "gateway_raw"], [F.desc("batch")]).drop("batch")


def upsert(path: str):
    """A sink that stores what a batch emits; days that are emitted again take their newest total, and a batch that is run again replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return sink


def keep_totals(legs: DataFrame, path: str, checkpoint: str, late: str = "2 days") -> None:
    """Bring the stored totals up to all payments that have arrived; payments later than ``late`` behind the newest are dropped."""
    spark = legs.sparkSession
    spark.createDataFrame([], TOTAL).write.mode("append").parquet(path)
    run_once(daily_totals(legs, late=late), upsert(path), checkpoint, "update")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """The newest totals as a table of their own, under the first batch's id, from which a new stream may go on."""
    read(spark, path).withColumn("batch", F.lit(-1).cast("long")).write.partitionBy("batch").parquet(into)
