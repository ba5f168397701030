"""Predicates, coverage and validity rules."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import HUB, PAYMENT_METHODS, STOREFRONT

# States and sources of entries that count, and sources of orders.
ENTRY_STATES, ENTRY_SOURCES = ["approved", "applied"], ["manual", "import"]
ORDER_SOURCES = [STOREFRONT, HUB, "integration", "webhook"]


def all_of(*tests: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def marketplace_is(value: str, marketplace: str = "marketplace", source: str = "source") -> Column:
    """Whether a row is of a marketplace, which may be given by label or key; a value that names none, as 'todos', takes all rows."""
    target = S.marketplace_token(F.lit(value))
    own = (S.marketplace_token(F.col(marketplace)) == target) | (S.marketplace_token(F.col(source)) == target)
    return target.isNull() | F.coalesce(own, F.lit(False))


def payment_is(method: str, normalized: str = "payment_method_normalized", raw: str = "payment_method_raw") -> Column:
    """Exact on a valid method, else by the tokens of the raw text."""
    return F.when(F.col(normalized).isin(PAYMENT_METHODS), F.col(normalized) == method).otherwise(S.names_method(F.col(raw), method))


def search(term: str, column: str = "search_text") -> Column:
    return F.coalesce(F.col(column).contains(term.strip().lower()), F.lit(False))


def transactions(
    rows: DataFrame,
    *,
    type=None,
    source=None,
    sources=None,
    status=None,
    marketplace=None,
    category=None,
    payment=None,
    start=None,
    end=None,
    term=None,
) -> DataFrame:
    """Ten optional conditions; the period is half-open."""
    eq = lambda c, v: None if v is None else F.col(c) == F.lit(v)
    return rows.where(
        all_of(
            eq("type", type),
            eq("source", source),
            None if not sources else F.col("source").isin(list(sources)),
            eq("status", status),
            None if marketplace is None else marketplace_is(marketplace),
            eq("category_id", category),
            None if payment is None else payment_is(payment),
            None if start is None else F.col("occurred_at") >= F.lit(start),
            None if end is None else F.col("occurred_at") < F.lit(end),
            None if term is None else search(term),
        )
    )


def cannot_contribute(type=None, source=None, sources=None, category=None) -> bool:
    """Whether conditions alone rule out every order: orders are income, uncategorised, and of known sources."""
    foreign = source not in (None, *ORDER_SOURCES) or (bool(sources) and not set(sources) & set(ORDER_SOURCES))
    return type not in (None, "income") or category is not None or foreign


def orders_for(rows: DataFrame, **conditions) -> DataFrame:
    """Orders under conditions; if these rule out every order, nothing is read."""
    ruled_out = cannot_contribute(**{k: conditions.get(k) for k in ("type", "source", "sources", "category")})
    return rows.where(F.lit(False)) if ruled_out else transactions(rows, **conditions)


def entries(rows: DataFrame, start=None, end=None, category=None, type=None) -> DataFrame:
    """Manual and imported entries that count: not deleted, approved or applied."""
    live = F.col("deleted_at").isNull() if "deleted_at" in rows.columns else F.lit(True)
    return transactions(
        rows.where(live & F.col("source").isin(ENTRY_SOURCES) & F.col("status").isin(ENTRY_STATES)),
        start=start,
        end=end,
        category=category,
        type=type,
    )


def coverage(periods: DataFrame, floor: datetime) -> DataFrame:
    """Periods ``start, end`` clipped at the floor of the data: full, partial or none, and whether they may be compared.

    A period without a start asks for all there is, which is full from the floor
    on; one that ends before the floor has neither start nor end.
    """
    start, end, least = F.col("start"), F.col("end"), F.lit(floor)
    status = F.when(start.isNull(), "full").when(F.coalesce(end < least, F.lit(False)), "none").when(start < least, "partial").otherwise(
        "full"
    )
    none = status == "none"
    clipped = {"clipped_start": F.when(~none, F.greatest(start, least)), "clipped_end": F.when(~none, end)}
    return periods.withColumns({"coverage": status, **clipped, "comparable": status == "full"})


def floor_partition(events: DataFrame, floor: datetime, *stamps: str) -> DataFrame:
    """How many events are eligible, below the floor, or without a date."""
    stamp = F.coalesce(*stamps)
    kind = F.when(stamp.isNull(), "undated").when(stamp < F.lit(floor), "below_floor").otherwise("eligible")
    return events.groupBy(kind.alias("floor_class")).agg(F.count("*").alias("n"))


def change_problem(tables: list[str]) -> Column:
    """What is wrong with a change event, null if nothing."""
    return (
        F.when(S.clean(F.col("record_id").cast("string")).isNull(), "missing_record_id")
        .when(~F.coalesce(F.col("operation").isin("INSERT", "UPDATE", "DELETE"), F.lit(False)), "unknown_operation")
        .when(F.col("operation").isin("INSERT", "UPDATE") & F.col("payload").isNull(), "missing_payload")
        .when(~F.coalesce(F.col("table_name").isin(tables), F.lit(False)), "unsupported_table")
    )


def notification_status(topics: list[str], required: list[str], seen: DataFrame, rows: DataFrame) -> DataFrame:
    """Notifications as processed, skipped (seen or of another topic) or failed (fields missing)."""
    known = seen.select(F.col("event_id").alias("_seen")).distinct()
    missing = reduce(lambda a, b: a | b, [S.clean(F.col(c).cast("string")).isNull() for c in required])
    status = F.when(F.col("_seen").isNotNull() | ~F.col("topic").isin(topics), "skipped").when(missing, "failed").otherwise("processed")
    return rows.join(known, F.col("event_id") == F.col("_seen"), "left").withColumn("notification_status", status).drop("_seen")


def entry_violations(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Entries with the category rule that they break: required, must match in direction, forbidden for transfers."""
    known = categories.select(F.col("id").alias("category_id"), F.col("direction"))
    rule = (
        F.when((F.col("type") == "transfer") & F.col("category_id").isNotNull(), "category_forbidden")
        .when((F.col("type") != "transfer") & F.col("category_id").isNull(), "category_required")
        .when((F.col("type") != "transfer") & F.col("direction").isNull(), "category_unknown")
        .when((F.col("type") != "transfer") & (F.col("direction") != F.col("type")), "direction_mismatch")
    )
    return rows.join(known, "category_id", "left").withColumn("violation", rule)
