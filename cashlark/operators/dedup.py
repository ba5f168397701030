"""One row per order from many events, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import numbered


def first_by(rows: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key; the window's limit runs before the shuffle as well."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def order_key() -> Column:
    return F.coalesce("external_order_id", "id")


#: Columns of the source and order that :func:`keyed` events are told apart by, in the order of the keys of order rows, so that both lie alike.
EVENT_KEYS = ["_source_key", "_order_key"]


def keyed(events: DataFrame) -> DataFrame:
    """Events with their keys as columns, so that later joins on them find the rows where the dedup left them."""
    if set(EVENT_KEYS) <= set(events.columns):
        return events
    return events.withColumns({"_order_key": order_key(), "_source_key": F.coalesce("source", F.lit(""))})


def dedup_keyed(events: DataFrame, paid: Column, recency: Column) -> DataFrame:
    """Per order and source: paid before unpaid, then the newest (null last), then the greatest id."""
    return first_by(events, EVENT_KEYS, [paid.desc(), recency.desc_nulls_last(), F.desc("id")])


def dedup_events(events: DataFrame, paid: Column, recency: Column) -> DataFrame:
    return dedup_keyed(keyed(events), paid, recency).drop(*EVENT_KEYS)


def canonical_orders(events: DataFrame, recency: Column | None = None, unknown: str = "sem_status") -> DataFrame:
    """Per order the event that is paid, else the newest by the mirror's time or else by receipt (null last), then the greatest id.

    ``status`` is the lower-case financial status, ``unknown`` where there is none.
    """
    rows = events.withColumn("status", F.lower(F.coalesce("financial_status", F.lit(unknown))))
    recency = F.coalesce("mirror_updated_at", "received_at") if recency is None else recency
    return first_by(rows, ["external_order_id"], [(F.col("status") == "paid").desc(), recency.desc_nulls_last(), F.desc("id")])


def latest_paid(events: DataFrame) -> DataFrame:
    return first_by(events.where("status = 'paid'"), ["external_order_id"], [F.desc_nulls_last("received_at"), F.desc("id")])


def stratified_sample(rows: DataFrame, stratum: str, order: str, k: int) -> DataFrame:
    """Per stratum ``k`` rows at even steps of the order; all rows of a stratum with at most ``k``."""
    placed = numbered(rows, stratum, [order])
    # Row j is taken if it is floor(i * n / k) for some i.
    i = F.ceil(F.col("_j") * k / F.col("_n"))
    taken = (F.col("_n") <= k) | ((i < k) & (F.floor(i * F.col("_n") / k) == F.col("_j")))
    return placed.where(taken).drop("_n", "_j")
