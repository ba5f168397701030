"""The order table kept by a stream of events and resolutions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.values import HUB, STOREFRONT
from ..operators.dedup import first_by, order_key
from ..sources.order_store import OrderStore
from ..sources.scratch import temporary, written
from .ingest import run_once, source


def touches(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Keys of orders that new events or new resolutions concern."""
    told = events.where(F.col("source").isin(STOREFRONT, HUB) & F.col("payload_json").isNotNull()).select(
        "source",
        order_key().alias("order_key"),
    )
    resolved = resolutions.select(F.lit(STOREFRONT).alias("source"), F.col("external_order_id").alias("order_key"))
    return told.union(resolved)


class OrderSink:
    """Materialises the orders that a micro-batch touches; a batch that is run again gives the same table.

    The version of a batch is its id, and a batch reads the table as it was
    before its version.  Events and resolutions are read from where they have
    landed, all of the touched orders' whatever their date, so late ones count.
    Of several resolutions of an order the newest holds.
    """

    def __init__(self, events: DataFrame, resolutions: DataFrame, store: OrderStore, as_of: datetime | None = None):
        self.events, self.resolutions, self.store, self.as_of = events, resolutions, store, as_of

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        keys = batch.where("order_key IS NOT NULL").distinct()
        newest = first_by(
            self.resolutions,
            ["external_order_id"],
            [F.desc_nulls_last("resolved_at"), F.desc_nulls_last("processed_at"), F.col("gateway_raw")],
        )
        with temporary(batch.sparkSession):
            self.store.update_keys(self.events, newest, written(keys, "touched"), batch_id + 1, self.as_of)


def keep_orders(
    spark: SparkSession,
    events_path: str,
    events_schema: StructType,
    resolutions_path: str,
    resolutions_schema: StructType,
    store: OrderStore,
    checkpoint: str,
    files_per_batch: int = 64,
    as_of: datetime | None = None,
) -> None:
    """Bring the stored table up to all events and resolutions that have landed; a restart goes on where the last run ended."""
    landed = lambda where, schema: spark.read.schema(schema).parquet(where)
    stream = touches(
        source(spark, events_path, events_schema, files_per_batch),
        source(spark, resolutions_path, resolutions_schema, files_per_batch),
    )
    run_once(stream, OrderSink(landed(events_path, events_schema), landed(resolutions_path, resolutions_schema), store, as_of), checkpoint)
