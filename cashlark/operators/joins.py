"""Joins between events, orders, ledgers and external truth; all are equi-joins on order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import STOREFRONT
from .dedup import EVENT_KEYS, keyed

ORDER = "external_order_id"


def events_with_resolution(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Events with the resolved gateway of their order, for the storefront only."""
    r = resolutions.select(
        F.col(ORDER).alias("_order"),
        F.col("gateway_raw").alias("resolved_gateway_raw"),
        F.col("processed_at").alias("resolved_transaction_processed_at"),
    )
    return events.join(r, (F.col(ORDER) == F.col("_order")) & (F.col("source") == STOREFRONT), "left").drop("_order")


def keyed_events_with_resolution(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """As :func:`events_with_resolution` for events with ``dedup.EVENT_KEYS``, joined on these, so that they are not shuffled again."""
    r = resolutions.select(
        F.col(ORDER).alias("_order"),
        F.when(F.col(ORDER).isNotNull(), STOREFRONT).alias("_shop"),  # no constant, as that would be no key of the join
        F.col("gateway_raw").alias("resolved_gateway_raw"),
        F.col("processed_at").alias("resolved_transaction_processed_at"),
    )
    own = (F.col("_order_key") == F.col("_order")) & (F.col("_source_key") == F.col("_shop")) & F.col(ORDER).isNotNull()
    return events.join(r, own, "left").drop("_order", "_shop")


def events_for_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """All events of the orders in ``keys`` (source, order_key), whatever their date.

    They come with ``dedup.EVENT_KEYS``, on which they are joined, so that a dedup does not shuffle them again.
    """
    own = keys.select(F.col("source").alias("_source_key"), F.col("order_key").alias("_order_key"))
    return keyed(events).where("source IS NOT NULL").join(own, EVENT_KEYS, "left_semi")


def stale_resolution(orders: DataFrame, resolutions: DataFrame, limit: int) -> DataFrame:
    """Orders materialised before their resolution, oldest resolution first."""
    r = resolutions.select(ORDER, "resolved_at")
    return orders.join(r, ORDER).where("resolved_at > materialized_at").orderBy("resolved_at", ORDER).limit(limit)


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def ledger_vs_tender(tenders: DataFrame, ledger: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per order with tenders, tender minus ledger without store credit, where they differ."""
    comparable = ledger.where(
        S.classify_payment(F.col("gateway_raw")) != "store_credit"
    ).groupBy(ORDER).agg(F.sum("amount_cents").cast("long").alias("ledger_cents"))
    both = tenders.join(comparable, ORDER, "left").withColumn("ledger_cents", S.zero(F.col("ledger_cents")))
    return both.withColumn("delta_cents", F.col("tender_cents") - F.col("ledger_cents")).where(F.abs("delta_cents") > tolerance)


def diff_read_models(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose rows differ: only on one side, or the names of the fields that differ."""
    l = left.select(*keys, F.lit(True).alias("_l"), *[F.col(f).alias(f"l_{f}") for f in fields])
    r = right.select(*keys, F.lit(True).alias("_r"), *[F.col(f).alias(f"r_{f}") for f in fields])
    names = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right").when(F.size(names) > 0, "different")
    both = l.join(r, keys, "full_outer").withColumns({"difference": kind, "fields": F.when(kind == "different", F.array_join(names, ","))})
    return both.where("difference is not null").select(*keys, "difference", "fields")


def explain_difference(legs: DataFrame, orders: DataFrame, events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per order of a window, what payments outside say less what the order table says, with its cause.

    Outside are the ``legs`` processed in the half-open window; the system's side
    are the storefront's orders dated in it.  An order that has legs in the window
    but is dated elsewhere counts nothing there.
    """
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    t = legs.where(inside("processed_at")).groupBy(ORDER).agg(F.sum("amount_cents").cast("long").alias("external_cents"))
    own = orders.where(F.col("source") == STOREFRONT).select(ORDER, "amount_cents", inside("occurred_at").alias("dated_inside"))
    seen = events.where(F.col("source") == STOREFRONT).select(ORDER).distinct().withColumn("mirrored", F.lit(True))
    both = t.join(own, ORDER, "full_outer").where("external_cents IS NOT NULL OR dated_inside").join(seen, ORDER, "left")
    system = F.when(F.coalesce("dated_inside", F.lit(False)), S.zero(F.col("amount_cents"))).otherwise(0)
    cause = (
        F.when(F.col("external_cents").isNull(), "system_only")
        .when(F.col("mirrored").isNull(), "absent_from_mirror")
        .when(F.col("dated_inside").isNull(), "not_materialized")
        .when(~F.col("dated_inside"), "different_date")
        .otherwise("leg_outside_window")
    )
    found = both.select(ORDER, (S.zero(F.col("external_cents")) - system).cast("long").alias("difference_cents"), cause.alias("cause"))
    return found.where("difference_cents <> 0")


def difference_by_cause(found: DataFrame, legs: DataFrame, orders: DataFrame, start: Column, end: Column) -> DataFrame:
    """Explained differences by cause, and as ``residual`` what the whole difference leaves unexplained, which is zero."""
    money = lambda rows, c, sign: rows.where((F.col(c) >= start) & (F.col(c) < end)).agg((F.coalesce(F.sum("amount_cents"), F.lit(0)) * sign).alias("cents"))
    causes = found.groupBy("cause").agg(F.count("*").alias("n"), F.sum("difference_cents").cast("long").alias("difference_cents"))
    parts = money(legs, "processed_at", 1).union(money(orders.where(F.col("source") == STOREFRONT), "occurred_at", -1))
    whole = parts.union(found.agg((F.coalesce(F.sum("difference_cents"), F.lit(0)) * -1).alias("cents")))
    residual = whole.agg(
        F.lit("residual").alias("cause"),
        F.lit(0).cast("long").alias("n"),
        F.sum("cents").cast("long").alias("difference_cents"),
    )
    return causes.unionByName(residual)


def orders_missing_split(events: DataFrame, resolutions: DataFrame, split: DataFrame) -> DataFrame:
    """Orders of the storefront without a split, unless their resolution says that none can be had."""
    orders = events.where(F.col("source") == STOREFRONT).select(ORDER).distinct()
    known = resolutions.select(ORDER, F.col("gateway_raw").alias("_gateway"), F.lit(True).alias("_resolved"))
    left = orders.join(split.select(ORDER).distinct(), ORDER, "left_anti").join(known, ORDER, "left")
    return left.where(~(F.col("_resolved").isNotNull() & F.col("_gateway").isNull())).select(ORDER)


def parity_counts(**tables: DataFrame) -> DataFrame:
    """Row counts of tables side by side, and how far each is from the first."""
    counts = None
    for place, (name, rows) in enumerate(tables.items()):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(place).alias("place"), F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    first = counts.where("place = 0").select(F.col("n").alias("_first"))
    joined = counts.join(first, F.lit(True))  # the right side is one row
    return joined.select(
        "table_name",
        "n",
        (F.col("n") - F.col("_first")).alias("difference"),
        F.when(F.col("n") < F.col("_first"), "missing_rows").when(F.col("n") > F.col("_first"), "extra_rows").alias("problem"),
    )
