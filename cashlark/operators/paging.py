"""Top rows and pages, always in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W



def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the total number of rows beside it, from a count of its own rather than a window over all rows."""
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.join(rows.agg(F.count("*").alias("total")), F.lit(True))  # the right side is one row


def after(rows: DataFrame, keys: list[tuple[str, bool]], last: list) -> DataFrame:
    """Rows behind the last one of a page in an order of (column, descending); no offset is counted off."""
    test, same = F.lit(False), F.lit(True)
    for (column, descending), value in zip(keys, last):
        c, v = F.col(column), F.lit(value)
        test = test | (same & ((c < v) if descending else (c > v)))
        same = same & (c == v)
    return rows.where(test)


def orders_order() -> list[Column]:
    return [F.desc("occurred_at"), F.col("source"), F.col("order_key")]


def newest_per_job(runs: DataFrame, per_day: Column) -> DataFrame:
    """The newest runs of each job, twice those expected in a day and four more."""
    w = W.partitionBy("job_name").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 2 * per_day + 4)


def open_by_size(rows: DataFrame, states: list[str], limit: int) -> DataFrame:
    return rows.where(F.col("status").isin(states)).orderBy(F.abs("delta_cents").desc(), "external_order_id").limit(limit)


def retry_queue(rows: DataFrame, states: list[str], as_of: Column, most_attempts: int, limit: int) -> DataFrame:
    """Open rows that are due, largest first, with the number of all that are."""
    due = rows.where(
        F.col("status").isin(states) & (F.col("attempts") < most_attempts) & (
            F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= as_of)
        )
    )
    return page(due, [F.abs("delta_cents").desc(), F.col("external_order_id")], limit).withColumnRenamed("total", "eligible")


def pending_changes(rows: DataFrame, as_of: Column, most_retries: int, limit: int) -> DataFrame:
    """Queued changes that are due and may be tried again, most retried first; rows that only ask to fetch are not changes."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)
    rows = rows.where((F.col("operation") != "FETCH") & (F.col("retries") < most_retries) & due)
    return rows.orderBy(F.desc("retries"), "id").limit(limit)


def incremental(rows: DataFrame, sort_at: str, key: str, watermark: tuple) -> DataFrame:
    """Rows behind a watermark (instant, id)."""
    return after(rows, [(sort_at, False), (key, False)], list(watermark))
