"""Payment resolution: which gateway took an order's money, and the ledger of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import state


def resolution_candidates(events: DataFrame, resolutions: DataFrame, limit: int | None = None) -> DataFrame:
    """Paid orders never resolved or changed since; newest first if limited."""
    paid = events.where("status = 'paid' and source = 'shopify'").groupBy("external_order_id").agg(
        F.max(F.coalesce("mirror_updated_at", "received_at")).alias("updated_at")
    )
    r = resolutions.select("external_order_id", "resolved_at")
    due = paid.join(r, "external_order_id", "left").where(
        "resolved_at is null or updated_at > resolved_at"
    ).select("external_order_id", "updated_at")
    return due if limit is None else due.orderBy(F.desc("updated_at"), "external_order_id").limit(limit)


def resolve(orders: DataFrame, legs: DataFrame) -> DataFrame:
    """Per order its dominant gateway and totals; an order without a usable leg has none and zero."""
    split = A.gateway_split(legs.join(orders.select("external_order_id").distinct(), "external_order_id", "left_semi"))
    won = A.dominant_gateway(split)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return orders.select("external_order_id").distinct().join(won, "external_order_id", "left").select(
        "external_order_id",
        "gateway_raw",
        zero("dominant_amount_cents"),
        zero("total_amount_cents"),
        "processed_at",
    )


def resolve_into(ledger: DataFrame, orders: DataFrame, legs: DataFrame, clear_empty: bool = False) -> DataFrame:
    """The ledger with the orders' legs replaced by their split."""
    split = A.gateway_split(legs.join(orders.select("external_order_id").distinct(), "external_order_id", "left_semi"))
    return state.replace_legs(ledger, split, orders, clear_empty=clear_empty)


def derived_legs(resolutions: DataFrame, ledger: DataFrame) -> DataFrame:
    """One leg for each resolved order of a single gateway that the ledger lacks."""
    single = resolutions.where("gateway_raw is not null and dominant_amount_cents = total_amount_cents and total_amount_cents > 0")
    return single.join(ledger.select("external_order_id").distinct(), "external_order_id", "left_anti").select(
        "external_order_id",
        "gateway_raw",
        F.col("total_amount_cents").alias("amount_cents"),
        F.lit(1).cast("long").alias("transaction_count"),
        "processed_at",
    )
