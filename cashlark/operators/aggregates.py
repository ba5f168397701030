"""Aggregates over orders, entries, ledgers and events. Sums of cents are exact, so their order does not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions.values import NO_GATEWAY, PAID_KINDS, STOREFRONT
from .ranks import discrete_percentile, largest_gaps


def total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def sum_if(test: Column, column: str | Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col(column) if isinstance(column, str) else column)), F.lit(0)).cast("long")


def by_source_method_type(rows: DataFrame) -> DataFrame:
    bucket = S.source_bucket(F.nullif(F.col("marketplace"), F.lit("")), F.col("external_source"), F.col("source"))
    return rows.groupBy(bucket.alias("source_bucket"), "payment_method", "type").agg(
        total("amount_cents").alias("total_cents"),
        F.count("*").alias("n"),
    )


def breakdown(rows: DataFrame) -> DataFrame:
    """Discount, shipping, and tax with fees; the last is 0 if either has no value at all."""
    return rows.agg(
        total("discount_cents").alias("discount_cents"),
        total("shipping_cents").alias("shipping_cents"),
        F.coalesce(F.sum("tax_cents") + F.sum("fee_cents"), F.lit(0)).cast("long").alias("tax_fee_cents"),
    )


def source_totals(grouped: DataFrame) -> DataFrame:
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    return grouped.groupBy("source_bucket").agg(
        sum_if(income, "total_cents").alias("gross_cents"),
        sum_if(expense, "total_cents").alias("expense_cents"),
        sum_if(income | expense, "n").alias("n"),
    )


def method_totals(grouped: DataFrame) -> DataFrame:
    method = F.coalesce("payment_method", F.lit("other"))
    return grouped.where("type = 'income'").groupBy(method.alias("payment_method")).agg(
        total("total_cents").alias("gross_cents"),
        total("n").alias("n"),
    )


def gateway_split(legs: DataFrame) -> DataFrame:
    """Per order and gateway the successful paying legs: cents, number and latest instant."""
    paying = legs.where((F.col("status") == "success") & F.col("kind").isin(PAID_KINDS))
    return paying.groupBy("external_order_id", "gateway_raw").agg(
        F.sum("amount_cents").cast("long").alias("amount_cents"),
        F.count("*").alias("transaction_count"),
        F.max("processed_at").alias("processed_at"),
    )


def dominant_gateway(split: DataFrame) -> DataFrame:
    """Per order the gateway with the most cents; ties go by the method's precedence, then by name."""
    order = F.struct(
        (-F.col("amount_cents")).alias("less"),
        S.method_rank(F.col("gateway_raw")).alias("rank"),
        "gateway_raw",
        "amount_cents",
        "processed_at",
    )
    won = split.withColumn("_order", order).groupBy("external_order_id").agg(
        F.min("_order").alias("w"),
        F.sum("amount_cents").cast("long").alias("total_amount_cents"),
    )
    return won.select(
        "external_order_id",
        F.col("w.gateway_raw").alias("gateway_raw"),
        F.col("w.amount_cents").alias("dominant_amount_cents"),
        "total_amount_cents",
        F.col("w.processed_at").alias("processed_at"),
    )


def gateway_payments(ledger: DataFrame, start: Column, end: Column, zone: str) -> DataFrame:
    """Per gateway its cents and legs in a half-open window, and the local days of the window that have any payment."""
    inside = ledger.where((F.col("processed_at") >= start) & (F.col("processed_at") < end))
    days = inside.select(F.countDistinct(S.local_day(F.col("processed_at"), zone)).alias("covered_days"))
    per_gateway = inside.groupBy("gateway_raw").agg(
        total("amount_cents").alias("amount_cents"),
        total("transaction_count").alias("transaction_count"),
    )
    return per_gateway.join(days, F.lit(True), "left")  # the right side is one row


def ledger_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("gateway_raw").agg(
        total("amount_cents").alias("amount_cents"),
        total("transaction_count").alias("transaction_count"),
        F.countDistinct("external_order_id").alias("orders"),
    )


def tender_totals(tenders: DataFrame) -> DataFrame:
    """Per order the sum of its positive tenders, tests left out; negative ones are only counted."""
    real = tenders.where(~F.col("test"))
    return real.groupBy("external_order_id").agg(
        sum_if(F.col("amount_cents") > 0, "amount_cents").alias("tender_cents"),
        F.count_if(F.col("amount_cents") < 0).alias("negative_entries"),
        F.count_if(F.col("amount_cents") > 0).alias("positive_entries"),
    ).where("positive_entries > 0").drop("positive_entries")


def entries_by_type(entries: DataFrame) -> DataFrame:
    return entries.groupBy("type").agg(total("amount_cents").alias("total_cents"), F.count("*").alias("n"))


def entries_totals(entries: DataFrame) -> DataFrame:
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    sums = entries.agg(
        sum_if(income, "amount_cents").alias("income_cents"),
        sum_if(expense, "amount_cents").alias("expense_cents"),
        F.count_if(income).alias("income_n"),
        F.count_if(expense).alias("expense_n"),
        F.count_if(F.col("type") == "transfer").alias("transfer_n"),
    )
    return sums.withColumn("balance_cents", F.col("income_cents") - F.col("expense_cents"))


def entries_by_category(entries: DataFrame, categories: DataFrame) -> DataFrame:
    """Per type and category its cents, number and share of the type, with a name for missing and for no category."""
    sums = entries.groupBy("type", "category_id").agg(total("amount_cents").alias("total_cents"), F.count("*").alias("n"))
    share = F.col("total_cents") / F.nullif(F.sum("total_cents").over(W.partitionBy("type")), F.lit(0)) * 100
    named = sums.withColumn("share_percent", share).join(categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
    return named.withColumn(
        "name",
        F.when(F.col("category_id").isNull(), "Sem categoria").otherwise(F.coalesce("name", F.lit("Categoria removida"))),
    )


def materialized_lag(orders: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("materialized_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    return orders.agg(
        F.max("materialized_at").alias("max_materialized_at"),
        F.max("occurred_at").alias("max_occurred_at"),
        F.count_if(recent).alias("recent"),
    )


def pipeline_by_day(orders: DataFrame, ledger: DataFrame, resolutions: DataFrame, zone: str) -> DataFrame:
    """Per local day of an order: orders, last materialisation, and orders without ledger or resolution."""
    has = lambda t, name: t.select("external_order_id").distinct().withColumn(name, F.lit(True))
    flagged = orders.join(has(ledger, "in_ledger"), "external_order_id", "left").join(
        has(resolutions, "resolved"),
        "external_order_id",
        "left",
    )
    return flagged.groupBy(S.local_day(F.col("occurred_at"), zone).alias("day")).agg(
        F.count("*").alias("orders"),
        F.max("materialized_at").alias("last_materialized_at"),
        F.count_if(F.col("in_ledger").isNull()).alias("without_ledger"),
        F.count_if(F.col("resolved").isNull()).alias("without_resolution"),
    )


def job_run_report(runs: DataFrame, as_of: Column | None, per_day: Column, days: int) -> DataFrame:
    """Per job over the last days, or over all runs, said to span them, if ``as_of`` is None: runs by outcome and trigger, durations of good runs, largest gap between starts, schedule coverage.

    Runs without a known trigger are manual; the 95th percentile is the discrete one.
    """
    if as_of is not None:
        runs = runs.where(F.col("started_at") >= as_of - F.make_interval(days=F.lit(days)))
    scheduled = F.coalesce(F.col("request_id").startswith("cf-cron-"), F.lit(False))
    ok = F.col("status") == "ok"
    report = runs.groupBy("job_name").agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("stuck"),
        F.count_if(scheduled).alias("scheduled"),
        F.count_if(~scheduled).alias("manual"),
        F.round(F.avg(F.when(ok, F.col("duration_ms")))).cast("long").alias("avg_ms"),
        F.max(F.when(ok, F.col("duration_ms"))).alias("peak_ms"),
        F.max("started_at").alias("last_started_at"),
    )
    high = discrete_percentile(runs.where(ok).select("job_name", "duration_ms"), "job_name", "duration_ms", 95)
    gaps = largest_gaps(runs, "job_name", "started_at").select(
        "job_name",
        F.round(F.col("gap_micros") / 60e6).cast("long").alias("largest_gap_minutes"),
    )
    report = report.join(high.withColumnRenamed("duration_ms", "p95_ms"), "job_name", "left").join(gaps, "job_name", "left")
    return report.withColumn("coverage_percent", F.round(F.col("scheduled") / (per_day * days) * 100, 6))


def with_shares(grouped: DataFrame, **shares: str) -> DataFrame:
    """Percentages of grand totals; the totals are one row of sums."""
    sums = grouped.agg(*[F.sum(c).alias(f"_{name}") for name, c in shares.items()])
    joined = grouped.join(sums, F.lit(True))  # the right side is one row
    return joined.withColumns(
        {name: F.col(c) / F.nullif(F.col(f"_{name}"), F.lit(0)) * 100 for name, c in shares.items()}
    ).drop(*[f"_{name}" for name in shares])


def transactions_by_gateway(legs: DataFrame) -> DataFrame:
    """Per gateway the successful gross, refunds, net, legs and orders."""
    ok = legs.where("status = 'success'")
    paying, back = F.col("kind").isin(PAID_KINDS), F.col("kind") == "refund"
    sums = ok.groupBy("gateway_raw").agg(
        sum_if(paying, "amount_cents").alias("gross_cents"),
        sum_if(back, "amount_cents").alias("refund_cents"),
        F.count("*").alias("legs"),
        F.countDistinct("external_order_id").alias("orders"),
    )
    return sums.withColumn("net_cents", F.col("gross_cents") - F.col("refund_cents"))


def counts_by_state(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """Counts of every known state, zero where there is none."""
    known = rows.sparkSession.createDataFrame([(s,) for s in states], f"{state} string")
    return known.join(rows.groupBy(state).agg(F.count("*").alias("n")), state, "left").select(state, F.coalesce("n", F.lit(0)).alias("n"))


def business_baseline(rows: DataFrame, as_of: Column, **tables: DataFrame) -> DataFrame:
    """One row: totals of entries, those of the last 30 days, and the rows of other tables by name."""
    income, recent = F.col("type") == "income", F.col("occurred_at") >= as_of - F.expr("INTERVAL 30 DAYS")
    found = rows.agg(
        F.count("*").alias("n"),
        sum_if(income, "amount_cents").alias("income_cents"),
        sum_if(~income, "amount_cents").alias("outcome_cents"),
        (sum_if(income, "amount_cents") - sum_if(~income, "amount_cents")).alias("balance_cents"),
        F.count_if(recent).alias("last_30_days"),
        sum_if(income & recent, "amount_cents").alias("last_30_days_income_cents"),
        sum_if(~income & recent, "amount_cents").alias("last_30_days_outcome_cents"),
    )
    for name, other in tables.items():
        found = found.join(other.agg(F.count("*").alias(f"total_{name}")), F.lit(True))  # both sides are one row
    return found


def ledger_pulse(resolutions: DataFrame) -> DataFrame:
    """How far the ledger of payments has come: the newest resolution and the newest payment."""
    return resolutions.agg(F.max("resolved_at").alias("last_resolved_at"), F.max("processed_at").alias("last_processed_at"))


def without(orders: DataFrame, others: DataFrame) -> DataFrame:
    """Orders of which another table knows nothing."""
    return orders.join(others.select("external_order_id"), "external_order_id", "left_anti")


def primary_gateways(latest: DataFrame) -> DataFrame:
    """By the first gateway that the latest paid event of an order names: orders, payments, items, and orders that name several.

    ``latest`` has one row per order with its parsed payload ``p``.
    """
    p = F.col("p")
    names = F.coalesce(p["payment_gateway_names"], F.array().cast("array<string>"))
    rows = latest.select(
        F.coalesce(F.nullif(F.get(names, F.lit(0)), F.lit("")), F.lit(NO_GATEWAY)).alias("gateway"),
        S.money_locale(p["total_price"]).alias("paid_cents"),
        S.money_locale(p["total_line_items_price"]).alias("items_cents"),
        (F.size(names) > 1).alias("is_split"),
    )
    return rows.groupBy("gateway").agg(
        F.count("*").alias("orders"),
        total("paid_cents").alias("gross_cents"),
        total("items_cents").alias("items_cents"),
        F.count_if("is_split").alias("split_orders"),
    )


def storefront(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("source") == STOREFRONT)
