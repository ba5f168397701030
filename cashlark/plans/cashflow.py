"""Cash-flow answers: totals of a period and the one before, by source, method and category."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import STOREFRONT
from ..operators import aggregates as A
from ..operators import filters

#: Days back to the first and the last day of a preset.
PRESETS = {"today": (0, 0), "yesterday": (1, 1), "d7": (6, 0), "d30": (29, 0), "d60": (59, 0), "d90": (89, 0)}


def period_range(
    as_of: datetime,
    preset: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    days: int = 30,
    zone: str | None = None,
) -> tuple[datetime, datetime]:
    """Half-open days: explicit dates before a preset before the last ``days`` days.

    One date alone means that day.  With a ``zone``, ``as_of`` is an instant of
    UTC, and so are the two edges, at which calendar days of the zone begin.
    """
    local = as_of.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)) if zone else as_of
    today = datetime(local.year, local.month, local.day)
    if start or end:
        first, last = start or end, end or start
    else:
        if preset and preset not in PRESETS:
            raise ValueError(f"unknown preset: {preset}")
        back, until = PRESETS[preset] if preset else (max(days - 1, 0), 0)
        first, last = today - timedelta(days=back), today - timedelta(days=until)
    edges = first, last + timedelta(days=1)
    if not zone:
        return edges
    return tuple(e.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None) for e in edges)


def previous_period(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    return start - (end - start), start


def tagged(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of the period and of the one before, in one pass."""
    before, _ = previous_period(start, end)
    inside = rows.where((F.col("occurred_at") >= F.lit(before)) & (F.col("occurred_at") < F.lit(end)))
    return inside.withColumn("period", F.when(F.col("occurred_at") >= F.lit(start), "current").otherwise("previous"))


def unified(orders: DataFrame, entries: DataFrame) -> DataFrame:
    """Orders and entries as one set of transactions."""
    return orders.unionByName(entries, allowMissingColumns=True)


def summary(rows: DataFrame, start: datetime, end: datetime, floor: datetime | None = None) -> DataFrame:
    """Totals by period, source and method; the period before only if the data covers it wholly."""
    before, _ = previous_period(start, end)
    both = tagged(rows, start, end)
    if floor and before < floor:
        both = both.where("period = 'current'")
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    return both.groupBy("period", F.col("source_bucket"), F.coalesce("payment_method", F.lit("other")).alias("payment_method")).agg(
        A.sum_if(income, "amount_cents").alias("income_cents"),
        A.sum_if(expense, "amount_cents").alias("expense_cents"),
        A.total("discount_cents").alias("discount_cents"),
        A.total("shipping_cents").alias("shipping_cents"),
        F.coalesce(F.sum("tax_cents") + F.sum("fee_cents"), F.lit(0)).cast("long").alias("tax_fee_cents"),
        F.count("*").alias("n"),
    )


def by_source(summed: DataFrame) -> DataFrame:
    """Income by source in both periods, with the change in percent."""
    pick = lambda p: A.sum_if(F.col("period") == p, "income_cents")
    sums = summed.groupBy("source_bucket").agg(pick("current").alias("current_cents"), pick("previous").alias("previous_cents"))
    return sums.withColumn("delta_percent", S.delta_percent(F.col("current_cents"), F.col("previous_cents")))


def compared(summed: DataFrame) -> DataFrame:
    """One row: totals of the period beside those of the one before, null where that was not covered, with the change of income in percent."""
    fields = ["income_cents", "expense_cents", "discount_cents", "shipping_cents", "tax_fee_cents", "n"]
    now, then = F.col("period") == "current", F.col("period") == "previous"
    sums = [F.coalesce(F.sum(F.when(now, F.col(c))), F.lit(0)).cast("long").alias(f"current_{c}") for c in fields]
    sums += [F.sum(F.when(then, F.col(c))).cast("long").alias(f"previous_{c}") for c in fields]
    return summed.agg(*sums).withColumn(
        "income_delta_percent",
        S.delta_percent(F.col("current_income_cents"), F.col("previous_income_cents")),
    )


def period_totals(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Totals of both periods from entries: income, expense, discount, shipping, tax with fees."""
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    return tagged(rows, start, end).groupBy("period").agg(
        A.sum_if(income, "amount_cents").alias("income_cents"),
        A.sum_if(expense, "amount_cents").alias("expense_cents"),
        A.total("discount_cents").alias("discount_cents"),
        A.total("shipping_cents").alias("shipping_cents"),
        F.coalesce(F.sum("tax_cents") + F.sum("fee_cents"), F.lit(0)).cast("long").alias("tax_fee_cents"),
        F.count("*").alias("n"),
    )


def marketplace_net(sources: DataFrame) -> DataFrame:
    """Gross minus expense of each source that has income."""
    return sources.where("gross_cents > 0").select(
        S.origin_label(F.col("source_bucket")).alias("label"),
        "source_bucket",
        "gross_cents",
        (F.col("gross_cents") - F.col("expense_cents")).alias("net_cents"),
    )


def payments_basis(orders: DataFrame, ledger: DataFrame, start: datetime, end: datetime, zone: str) -> DataFrame:
    """Income by method of the storefront: by its payments where these cover every day of the period, else by its orders."""
    days = (end - start).days
    paid = A.gateway_payments(ledger, F.lit(start), F.lit(end), zone)
    by_payment = paid.groupBy(S.classify_payment(F.col("gateway_raw")).alias("payment_method"), "covered_days").agg(
        A.total("amount_cents").alias("gross_cents"),
        A.total("transaction_count").alias("n"),
    )
    inside = orders.where(
        (F.col("source") == STOREFRONT) & (F.col("type") == "income") & (F.col("occurred_at") >= F.lit(start)) & (
            F.col("occurred_at") < F.lit(end)
        )
    )
    by_order = inside.groupBy("payment_method").agg(A.total("amount_cents").alias("gross_cents"), F.count("*").alias("n"))
    covered = paid.agg((F.coalesce(F.max("covered_days"), F.lit(0)) >= days).alias("covered"))
    both = by_payment.drop("covered_days").withColumn("basis", F.lit("payments")).unionByName(by_order.withColumn("basis", F.lit("orders")))
    return both.join(covered, F.lit(True)).where(F.col("covered") == (F.col("basis") == "payments")).drop("covered")  # the right side is one row


def summary_by_payments(
    rows: DataFrame,
    ledger: DataFrame,
    start: datetime,
    end: datetime,
    zone: str,
    floor: datetime | None = None,
    method: str | None = None,
) -> DataFrame:
    """Totals by period, source and method, where the ledger takes the place of the storefront's orders in each period that it covers day by day.

    Income and number of storefront orders then come from payments, in a source
    of their own; discount, shipping, taxes and fees still come from the orders.
    ``method`` also limits the payments, as the caller has limited ``rows``.
    """
    before, _ = previous_period(start, end)
    both = tagged(rows, start, end)
    legs = tagged(ledger.withColumnRenamed("processed_at", "occurred_at"), start, end)
    if floor and before < floor:
        both, legs = both.where("period = 'current'"), legs.where("period = 'current'")
    days = F.countDistinct(S.local_day(F.col("occurred_at"), zone))
    covered = legs.groupBy("period").agg((days >= (end - start).days).alias("covered")).where("covered")  # at most two rows
    both = both.join(covered, "period", "left")
    swapped = F.coalesce(F.col("covered") & (F.col("external_source") == STOREFRONT) & (F.col("type") == "income"), F.lit(False))
    money = ["discount_cents", "shipping_cents", "tax_cents", "fee_cents"]
    own = both.select(
        "period",
        "type",
        "source_bucket",
        F.coalesce("payment_method", F.lit("other")).alias("payment_method"),
        F.when(swapped, 0).otherwise(F.col("amount_cents")).alias("amount_cents"),
        *[S.zero(F.col(c)).alias(c) for c in money],
        F.when(swapped, 0).otherwise(1).alias("n"),
    )
    paid = legs.join(covered, "period").withColumn("payment_method", S.classify_payment(F.col("gateway_raw")))
    paid = paid if method is None else paid.where(F.col("payment_method") == method)
    bucket = S.marketplace_label(F.lit(None).cast("string"), F.lit(STOREFRONT))
    paid = paid.select(
        "period",
        F.lit("income").alias("type"),
        bucket.alias("source_bucket"),
        "payment_method",
        "amount_cents",
        *[F.lit(0).cast("long").alias(c) for c in money],
        F.col("transaction_count").alias("n"),
    )
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    return own.unionByName(paid).groupBy("period", "source_bucket", "payment_method").agg(
        A.sum_if(income, "amount_cents").alias("income_cents"),
        A.sum_if(expense, "amount_cents").alias("expense_cents"),
        A.total("discount_cents").alias("discount_cents"),
        A.total("shipping_cents").alias("shipping_cents"),
        A.total(F.col("tax_cents") + F.col("fee_cents")).alias("tax_fee_cents"),
        A.total("n").alias("n"),
    )


def entries_summary(entries: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Totals of entries that count in both periods; no row for a period without any."""
    income, expense = F.col("type") == "income", F.col("type") == "expense"
    return tagged(filters.entries(entries), start, end).groupBy("period").agg(
        A.sum_if(income, "amount_cents").alias("income_cents"), A.sum_if(expense, "amount_cents").alias("expense_cents"), (
            A.sum_if(income, "amount_cents") - A.sum_if(expense, "amount_cents")
        ).alias("balance_cents"), F.count_if(F.col("type") == "transfer").alias("transfers")
    )


def entries_compared(entries: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row: the period's totals of entries beside those of the one before, which are null where it has no entry at all."""
    sums = entries_summary(entries, start, end)
    fields = ["income_cents", "expense_cents", "balance_cents", "transfers"]
    of = lambda period, c: F.sum(F.when(F.col("period") == period, F.col(c))).cast("long")
    return sums.agg(
        *[F.coalesce(of("current", c), F.lit(0)).cast("long").alias(f"current_{c}") for c in fields],
        *[of("previous", c).alias(f"previous_{c}") for c in fields],
    )


def parity(live: DataFrame, stored: DataFrame, cases: dict[str, Column], fields: list[str], start: datetime, end: datetime) -> DataFrame:
    """Two ways to the same orders under each filter: rows of either, and orders that only one has or whose fields differ.

    Both sides are read once, whatever the number of cases.
    """
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in cases.items()]))

    def side(rows: DataFrame) -> DataFrame:
        inside = rows.where((F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end)))
        row = F.struct(*[F.col(f) for f in fields]).alias("row")
        return inside.select(F.explode(names).alias("filter_case"), "source", "order_key", row)

    keys = ["filter_case", "source", "order_key"]
    both = side(live).withColumnRenamed("row", "a").join(side(stored).withColumnRenamed("row", "b"), keys, "full_outer")
    return both.groupBy("filter_case").agg(
        F.count("a").alias("live_rows"),
        F.count("b").alias("stored_rows"),
        F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differences"),
    )


# Headings of an export in their order, and the mark that opens its file.
EXPORT_HEADINGS = ["Marketplace", "Numero do pedido", "Data", "Forma de pagamento", "Entrega", "Descontos", "Taxas", "Valor"]
BYTE_ORDER_MARK = "\ufeff"


def export_rows(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Eight text columns of an order export: dates as day/month/year of the zone, money with two decimals, taxes with fees."""
    money = lambda cents: F.call_function("format_number", S.zero(cents) / 100, F.lit("0.00"))
    return rows.select(
        F.coalesce("marketplace", "external_source", F.lit("—")).alias("marketplace"),
        S.shown_order_number(F.col("order_number"), F.col("description")).alias("order_number"),
        F.date_format(F.from_utc_timestamp("occurred_at", zone), "dd/MM/yyyy").alias("date"),
        S.payment_label(F.col("payment_method_raw"), F.col("payment_method_normalized")).alias("payment_method"),
        money(F.col("shipping_cents")).alias("shipping"),
        money(F.col("discount_cents")).alias("discounts"),
        money(S.zero(F.col("tax_cents")) + S.zero(F.col("fee_cents"))).alias("fees"),
        money(F.col("amount_cents")).alias("amount"),
    )


def csv_line(columns: list[Column]) -> Column:
    """Values between semicolons; quoted only where one holds a semicolon, a quote or a line end."""
    quoted = [
        F.when(c.rlike(r'[";\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        for c in columns
    ]
    return F.concat_ws(";", *quoted)


def export_lines(rows: DataFrame) -> DataFrame:
    """``line``: each row of an export as text, without the headings."""
    return rows.select(csv_line([F.col(c) for c in rows.columns]).alias("line"))


def write_export(rows: DataFrame, path: str, single: bool = False) -> None:
    """An export as text files without headings, or as one file that opens with the mark and the headings.

    The single file is written by one task, for exports that people open.
    """
    lines = export_lines(rows)
    if single:
        head = rows.sparkSession.createDataFrame([(BYTE_ORDER_MARK + ";".join(EXPORT_HEADINGS),)], "line string")
        lines = head.union(lines).coalesce(1)
    lines.write.text(path)
