"""The parity diagnosis of storefront orders: what the mirror holds, how payments are credited, and on which day.

Events have ``id, source, external_order_id, event_type, financial_status,
total_cents, has_payload, created_at`` (of the order), ``received_at,
mirror_updated_at`` and ``processed_at``; resolutions have one row per order with
its dominant gateway, that gateway's cents, all cents and the time of the payment.
Money without an amount counts as zero.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import STOREFRONT
from ..operators.aggregates import sum_if, total, with_shares
from ..operators.dedup import canonical_orders

#: The zone in which the diagnosis counts days.
ZONE = "America/Bahia"
ORDER = "external_order_id"
ratio = lambda a, b, digits: F.round(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0)), digits)


def with_payload(events: DataFrame) -> DataFrame:
    """Storefront events of an order with a payload."""
    return events.where((F.col("source") == STOREFRONT) & F.col("has_payload") & F.col(ORDER).isNotNull())


def of_window(events: DataFrame, received_from: datetime, created_from: datetime, created_to: datetime) -> DataFrame:
    """Events with a payload, received from an instant on, of orders created in a half-open window."""
    created = (F.col("created_at") >= F.lit(created_from)) & (F.col("created_at") < F.lit(created_to))
    return with_payload(events).where((F.col("received_at") >= F.lit(received_from)) & created)


def amplification_by_day(events: DataFrame, as_of: datetime, days: int = 40, zone: str = ZONE) -> DataFrame:
    """Per local day on which orders were created, and received in the last days: orders, events, and events per order."""
    recent = with_payload(events).where(F.col("received_at") >= F.lit(as_of) - F.make_interval(days=F.lit(days)))
    return _amplified(recent, S.local_day(F.col("created_at"), zone).alias("day"))


def amplification_by_type(events: DataFrame, received_from: datetime) -> DataFrame:
    """Per type of event received from an instant on, payload or not."""
    rows = events.where((F.col("source") == STOREFRONT) & (F.col("received_at") >= F.lit(received_from)))
    return _amplified(rows, F.col("event_type"))


def _amplified(rows: DataFrame, key: Column) -> DataFrame:
    counts = rows.groupBy(key).agg(F.countDistinct(ORDER).alias("orders"), F.count("*").alias("events"))
    return counts.withColumn("events_per_order", F.round(F.col("events") / F.nullif(F.col("orders"), F.lit(0)), 2))


def status_mix(canonical: DataFrame) -> DataFrame:
    """Canonical orders by status, with shares of their number and money."""
    grouped = canonical.groupBy(F.col("status").alias("financial_status")).agg(
        F.count("*").alias("orders"),
        total("total_cents").alias("total_cents"),
    )
    shares = with_shares(grouped, orders_percent="orders", money_percent="total_cents")
    return shares.withColumns({c: F.round(c, 2) for c in ("orders_percent", "money_percent")})


def statuses_of_any_event(events: DataFrame) -> DataFrame:
    """Orders with each status on any of their events, so that one order can count under several."""
    return events.groupBy(F.lower("financial_status").alias("financial_status")).agg(F.countDistinct(ORDER).alias("orders"))


def paid_and_resolved(canonical: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Canonical paid orders with the resolution that names their gateway."""
    return canonical.where("status = 'paid'").join(resolutions.where("gateway_raw IS NOT NULL").drop("total_cents"), ORDER)


def misattribution(resolved: DataFrame) -> DataFrame:
    """Money that is credited to dominant gateways but that others took: one row."""
    wrong = F.col("total_amount_cents") - F.col("dominant_amount_cents")
    sums = resolved.agg(
        F.count("*").alias("orders"),
        total("total_cents").alias("order_cents"),
        total("total_amount_cents").alias("transaction_cents"),
        total("dominant_amount_cents").alias("dominant_cents"),
        total(wrong).alias("misattributed_cents"),
        F.count_if(wrong != 0).alias("split_orders"),
    )
    return sums.withColumn("misattributed_percent", ratio("misattributed_cents", "transaction_cents", 3))


def gateway_inflation(resolved: DataFrame) -> DataFrame:
    """Per gateway, over the orders it won: what it is credited with, what it took of them, and by how much that is too high."""
    sums = resolved.groupBy("gateway_raw").agg(
        F.count("*").alias("orders"),
        total("total_amount_cents").alias("credited_cents"),
        total("dominant_amount_cents").alias("own_cents"),
    )
    sums = sums.withColumn("excess_cents", F.col("credited_cents") - F.col("own_cents"))
    return sums.withColumn("inflation_percent", ratio("excess_cents", "own_cents", 2))


def value_parity(resolved: DataFrame, tolerance: int = 1) -> DataFrame:
    """Paid orders by whether the order's total is what its transactions add up to."""
    difference = F.col("total_cents") - F.col("total_amount_cents")
    kind = F.when(F.abs(difference) <= tolerance, "equal").when(difference > 0, "above").otherwise("below")
    return resolved.groupBy(kind.alias("parity")).agg(
        F.count("*").alias("orders"),
        total("total_cents").alias("order_cents"),
        total("total_amount_cents").alias("transaction_cents"),
        total(difference).alias("difference_cents"),
    )


def date_basis(canonical: DataFrame, resolutions: DataFrame, zone: str = ZONE) -> DataFrame:
    """Paid orders by whether their payment is dated, and on the day they were created; orders without resolution are undated."""
    dates = resolutions.select(ORDER, F.col("processed_at").alias("paid_at"))
    made, paid = S.local_day(F.col("created_at"), zone), S.local_day(F.col("paid_at"), zone)
    basis = F.when(F.col("paid_at").isNull(), "undated").when(paid == made, "same_day").otherwise("other_day")
    rows = canonical.where("status = 'paid'").join(dates, ORDER, "left")
    grouped = rows.groupBy(basis.alias("basis")).agg(F.count("*").alias("orders"), total("total_cents").alias("total_cents"))
    return with_shares(grouped, money_percent="total_cents").withColumn("money_percent", F.round("money_percent", 3))


def mirror_maxima(events: DataFrame) -> DataFrame:
    """How far the mirror of the storefront has come: one row."""
    names = {"received_at": "max_received_at", "mirror_updated_at": "max_mirror_updated_at", "created_at": "max_order_created_at"}
    return events.where(F.col("source") == STOREFRONT).agg(*[F.max(c).alias(name) for c, name in names.items()])


def received_by_day(events: DataFrame, received_from: datetime, zone: str = ZONE) -> DataFrame:
    """Per local day of receipt: events, orders, and the oldest and newest order among them."""
    rows = events.where((F.col("source") == STOREFRONT) & (F.col("received_at") >= F.lit(received_from)))
    return rows.groupBy(S.local_day(F.col("received_at"), zone).alias("day")).agg(
        F.count("*").alias("n"),
        F.countDistinct(ORDER).alias("orders"),
        F.min("created_at").alias("oldest_order"),
        F.max("created_at").alias("newest_order"),
    )


def beyond(upstream: DataFrame, mark: datetime) -> DataFrame:
    """Upstream's storefront events from a watermark on, by receipt or else by processing."""
    return upstream.where((F.col("source") == STOREFRONT) & (F.coalesce("received_at", "processed_at") >= F.lit(mark)))


def backlog_by_day(upstream: DataFrame, mark: datetime, zone: str = ZONE) -> DataFrame:
    """Per local day what the mirror still has to take."""
    day = S.local_day(F.coalesce("received_at", "processed_at"), zone).alias("day")
    return beyond(upstream, mark).groupBy(day).agg(F.count("*").alias("n"), F.countDistinct(ORDER).alias("orders"))


def backlog_money_by_status(upstream: DataFrame, mark: datetime) -> DataFrame:
    """Orders and money that the mirror still has to take, by status ('' for none); here recency is receipt alone, none last."""
    canonical = canonical_orders(with_payload(beyond(upstream, mark)), F.col("received_at"), unknown="")
    return canonical.groupBy(F.col("status").alias("financial_status")).agg(
        F.count("*").alias("orders"),
        sum_if(F.lit(True), "total_cents").alias("total_cents"),
    )
