"""Reconciliation: divergences between ledger and tenders, their life cycle, and verification."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import CLOSED_STATES, OPEN_STATES, RETRY_DAYS
from ..operators import aggregates as A
from ..operators import joins, state
from ..sources.scratch import written

ORDER = "external_order_id"


def detect(tenders: DataFrame, ledger: DataFrame, first: Column, end: Column, zone: str, tolerance: int = 1) -> DataFrame:
    """Orders with a tender on one of the days whose whole tenders differ from their ledger, on the last of their days."""
    inside = tenders.where(~F.col("test") & (F.col("processed_at") >= first) & (F.col("processed_at") < end))
    days = inside.groupBy(ORDER).agg(F.max(S.local_day(F.col("processed_at"), zone)).alias("day"))
    whole = A.tender_totals(tenders.join(days, ORDER, "left_semi"))
    return joins.ledger_vs_tender(whole, ledger, tolerance).join(days, ORDER).select(
        ORDER,
        "day",
        "tender_cents",
        "ledger_cents",
        "delta_cents",
    )


def detect_stored(
    tenders: DataFrame,
    spans: DataFrame,
    ledger: DataFrame,
    first: date,
    last: date,
    zone: str,
    tolerance: int = 1,
) -> DataFrame:
    """As :func:`detect` over local days, from tenders stored by ``processed_month`` (its first day, of UTC), of which only some months are read.

    ``spans`` has the first and last month of each order's tenders
    (:func:`tender_spans`); those of the candidates are what their whole
    tenders can lie on, so nothing outside is missed.
    """
    start, end = (S.day_start(F.lit(d), zone) for d in (first, last + timedelta(days=1)))
    # A local day lies within the UTC days around it.
    month = lambda day: F.lit(day.replace(day=1))
    near = F.col("processed_month").between(month(first - timedelta(days=1)), month(last + timedelta(days=1)))
    stamp = F.col("processed_at").cast("timestamp")
    inside = tenders.where(near & ~F.col("test") & (stamp >= start) & (stamp < end))
    days = written(inside.groupBy(ORDER).agg(F.max(S.local_day(F.col("processed_at"), zone)).alias("day")), "candidate-days")
    held = days.join(spans, ORDER).select(F.explode(F.sequence("first_month", "last_month", F.expr("INTERVAL 1 MONTH"))).alias("m")).distinct()
    read = [r["m"] for r in held.collect()]  # as many as the data has months
    whole = A.tender_totals(tenders.where(F.col("processed_month").isin(read)).join(days, ORDER, "left_semi"))
    return joins.ledger_vs_tender(whole, ledger, tolerance).join(days, ORDER).select(
        ORDER,
        "day",
        "tender_cents",
        "ledger_cents",
        "delta_cents",
    )


def tender_spans(tenders: DataFrame) -> DataFrame:
    """The first and last month of each order's tenders, kept beside the tenders and widened as they land."""
    return tenders.groupBy(ORDER).agg(F.min("processed_month").alias("first_month"), F.max("processed_month").alias("last_month"))


def widened(spans: DataFrame, arrived: DataFrame) -> DataFrame:
    """Spans after more tenders have landed."""
    both = spans.unionByName(tender_spans(arrived))
    return both.groupBy(ORDER).agg(F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"))


def record(current: DataFrame, detected: DataFrame, as_of: Column) -> DataFrame:
    """The divergence table after a detection: closed rows come back as persistent, an accepted delta stays accepted."""
    fresh = detected.select(
        ORDER,
        "day",
        "tender_cents",
        F.col("ledger_cents").alias("ledger_cents_before"),
        "delta_cents",
        F.lit("pendente").alias("status"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp_ntz").alias("next_attempt_at"),
        F.lit(1).alias("occurrences"),
        as_of.alias("last_checked_at"),
    )
    accepted = (F.col("o_status") == "aceito") & (F.col("o_delta_cents") == F.col("n_delta_cents"))
    closed = F.col("o_status").isin(CLOSED_STATES)
    settle = {
        "status": F.when(accepted, "aceito").when(closed, "persistente").otherwise("pendente"),
        "attempts": F.when(accepted, F.col("o_attempts")).when(closed, 0).otherwise(F.col("o_attempts")),
        "next_attempt_at": F.when(accepted | closed, None).otherwise(F.col("o_next_attempt_at")),
        "occurrences": F.col("o_occurrences") + 1,
    }
    return state.merge(current.select(fresh.columns), fresh, [ORDER], lambda o, n: F.lit(True), settle)


def recheck_open(current: DataFrame, tenders: DataFrame, ledger: DataFrame) -> DataFrame:
    """Open rows measured again by fresh tenders, else by the stored ones; small differences are closed."""
    rows = current.where(F.col("status").isin(OPEN_STATES))
    fresh = tenders.select(ORDER, F.col("tender_cents").alias("_fresh"))
    own = ledger.where(
        S.classify_payment(F.col("gateway_raw")) != "store_credit"
    ).groupBy(ORDER).agg(F.sum("amount_cents").cast("long").alias("_ledger"))
    both = rows.join(fresh, ORDER, "left").join(own, ORDER, "left")
    delta = F.coalesce("_fresh", "tender_cents") - S.zero(F.col("_ledger"))
    return both.withColumns({"delta_cents": delta, "ledger_cents_after": S.zero(F.col("_ledger"))}).withColumn(
        "status",
        F.when(F.abs("delta_cents") <= 1, "corrigido").otherwise(F.col("status")),
    ).drop("_fresh", "_ledger")


def retry_outcome(queue: DataFrame, as_of: Column, still: Column) -> DataFrame:
    """After another attempt: corrected, due again after 1, 2, 4 or 8 days, or given up."""
    made = F.col("attempts") + 1
    days = reduce(lambda c, kv: c.when(made == kv[0], kv[1]), enumerate(RETRY_DAYS, 1), F.when(F.lit(False), None))
    again = as_of + F.make_interval(days=days)
    status = F.when(~still, "corrigido").when(days.isNull(), "sem_correcao").when(
        F.col("status") == "persistente",
        "persistente",
    ).otherwise("pendente")
    return queue.withColumns({"status": status, "next_attempt_at": F.when(still & days.isNotNull(), again), "attempts": made})


def review(current: DataFrame, decisions: DataFrame, most_attempts: int = len(RETRY_DAYS) + 1) -> DataFrame:
    """Human decisions on open rows: accept with who and why, or queue again with one attempt left."""
    d = decisions.select(ORDER, "action", "reviewer", "note")
    rows = current.join(d, ORDER, "left")
    acts = F.col("status").isin(OPEN_STATES) & F.col("action").isNotNull()
    accept, requeue = acts & (F.col("action") == "accept"), acts & (F.col("action") == "requeue")
    return rows.withColumns(
        {
            "attempts": F.when(requeue, F.least("attempts", F.lit(most_attempts - 1))).otherwise(F.col("attempts")),
            "next_attempt_at": F.when(accept | requeue, None).otherwise(F.col("next_attempt_at")),
            "reviewed_by": F.when(accept, F.col("reviewer")),
            "review_note": F.when(accept, F.col("note")),
            "status": F.when(accept, "aceito").otherwise(F.col("status")),
        }
    ).drop("action", "reviewer", "note")


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many divergences stand where, and their drift."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("*").alias("detected"),
        is_("corrigido").alias("corrected"),
        F.count_if(F.col("status").isin(OPEN_STATES)).alias("still_open"),
        is_("sem_correcao").alias("exhausted"),
        is_("aceito").alias("accepted"),
        A.total(F.abs("delta_cents")).alias("drift_cents"),
    )


def run_summary(detected: DataFrame, eligible: DataFrame, attempted: DataFrame, rechecked: DataFrame) -> DataFrame:
    """One row on a round of corrections: what was detected and closed, queued, tried with which outcome, and put off.

    ``attempted`` are the rows of the queue that were tried, with ``outcome``:
    corrected, diverging, failed or exhausted; ``eligible`` are all that were due.
    """
    is_ = lambda s: F.count_if(F.col("outcome") == s)
    parts = [
        detected.agg(F.count("*").alias("detected"), A.total(F.abs("delta_cents")).alias("drift_cents")),
        rechecked.agg(F.count_if(F.col("status") == "corrigido").alias("reconferred")),
        eligible.agg(F.count("*").alias("queued")),
        attempted.agg(
            is_("corrected").alias("corrected"),
            is_("diverging").alias("still_diverging"),
            is_("failed").alias("failed"),
            is_("exhausted").alias("exhausted"),
            F.count("*").alias("_tried"),
        ),
    ]
    both = reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # each is one row
    return both.withColumn("deferred", F.greatest(F.col("queued") - F.col("_tried"), F.lit(0))).drop("_tried")


def metrics(system: DataFrame, ledger: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per method the system's income beside the ledger's: difference, percent and whether it diverges."""
    own = ledger.groupBy(
        S.classify_payment(F.col("gateway_raw")).alias("payment_method")
    ).agg(A.total("amount_cents").alias("ledger_cents"))
    both = system.join(own, "payment_method", "full_outer").select(
        "payment_method",
        S.zero(F.col("gross_cents")).alias("system_cents"),
        S.zero(F.col("ledger_cents")).alias("ledger_cents"),
    )
    difference = F.col("system_cents") - F.col("ledger_cents")
    return both.withColumns(
        {
            "difference_cents": difference,
            "difference_percent": S.difference_percent(F.col("system_cents"), F.col("ledger_cents")),
            "diverges": F.abs(difference) > tolerance,
        }
    )


def ledger_vs_tender_day(
    tenders: DataFrame,
    inside: DataFrame,
    ledger: DataFrame,
    first: Column,
    end: Column,
    tolerance: int = 1,
) -> DataFrame:
    """One row on a window: orders compared with their tenders, those that differ, their drift, and what tenders cannot see.

    ``inside`` are the ledger's legs of the window; store credit among them never has a tender.
    """
    candidates = tenders.where(~F.col("test") & (F.col("processed_at") >= first) & (F.col("processed_at") < end)).select(ORDER).distinct()
    whole = A.tender_totals(tenders.join(candidates, ORDER, "left_semi"))
    apart = joins.ledger_vs_tender(whole, ledger, tolerance)
    alone = inside.select(ORDER).distinct().join(whole.select(ORDER), ORDER, "left_anti")
    credit = S.classify_payment(F.col("gateway_raw")) == "store_credit"
    parts = [
        whole.agg(F.count("*").alias("compared_orders"), A.total("negative_entries").alias("negative_entries")),
        apart.agg(F.count("*").alias("divergent_orders"), A.total(F.abs("delta_cents")).alias("drift_cents")),
        alone.agg(F.count("*").alias("orders_only_in_ledger")),
        inside.agg(A.sum_if(credit, "amount_cents").alias("blind_spot_cents")),
    ]
    return reduce(lambda a, b: a.join(b, F.lit(True)), parts)  # each is one row


def verification_report(
    system: DataFrame,
    tenders: DataFrame,
    ledger: DataFrame,
    first: Column,
    end: Column,
    by_payments: bool = False,
    tolerance: int = 1,
) -> DataFrame:
    """All metrics of a window: gross, count, each method, and the ledger beside the tenders.

    ``system`` has the storefront's ``payment_method, gross_cents, n``.  The count
    is of payments if the answer stands on these, else of orders, and has no
    tolerance.  ``ledger_vs_tender`` shows compared orders, the store credit that
    tenders cannot see, and the drift.
    """
    inside = ledger.where((F.col("processed_at") >= first) & (F.col("processed_at") < end))
    row = lambda name, a, b, d, percent, diverges: [
        name.alias("metric"),
        a.cast("long").alias("system_value"),
        b.cast("long").alias("other_value"),
        d.cast("long").alias("difference"),
        percent.cast("double").alias("difference_percent"),
        diverges.alias("diverges"),
    ]
    beside = lambda name, a, b, most: row(name, a, b, a - b, S.difference_percent(a, b), F.abs(a - b) > most)
    theirs = inside.agg(
        A.total("amount_cents").alias("other_gross"),
        A.total("transaction_count").alias("legs"),
        F.countDistinct(ORDER).alias("orders"),
    )
    both = system.agg(A.total("gross_cents").alias("gross"), A.total("n").alias("count")).join(theirs, F.lit(True))  # both are one row
    count = F.col("legs") if by_payments else F.col("orders")
    per_method = metrics(system, inside, tolerance)
    drift = F.col("drift_cents")
    compared = ledger_vs_tender_day(tenders, inside, ledger, first, end, tolerance)
    parts = [
        both.select(*beside(F.lit("gross"), F.col("gross"), F.col("other_gross"), tolerance)),
        both.select(*beside(F.lit("count"), F.col("count"), count, 0)),
        per_method.select(*beside(F.concat(F.lit("method:"), "payment_method"), F.col("system_cents"), F.col("ledger_cents"), tolerance)),
        compared.select(*row(F.lit("ledger_vs_tender"), F.col("compared_orders"), F.col("blind_spot_cents"), drift, F.lit(None), drift > tolerance)),
    ]
    return reduce(DataFrame.unionByName, parts)


def maturity(days: DataFrame, zone: str) -> DataFrame:
    """A day is mature if nothing is unresolved or without ledger and the orders were materialised after it ended."""
    end = S.day_start(F.date_add("day", 1), zone)
    after = F.coalesce(F.col("last_materialized_at").cast("timestamp") >= end, F.lit(False))
    return days.withColumns(
        {"materialized_after": after, "is_mature": (F.col("without_resolution") == 0) & (F.col("without_ledger") == 0) & after}
    )


# The shape in which runs store their report.
_MATURITY = "struct<isMature:boolean,unresolvedOrders:bigint,ordersWithoutLedger:bigint,materializedAfterWindow:boolean>"
RUN_RESULT = f"report struct<metrics:array<struct<label:string,diverges:boolean>>,maturity:{_MATURITY}>"


def pending_reasons(maturity: Column) -> Column:
    """What keeps a day from being final, in order, joined by commas."""
    unresolved, ledger = maturity["unresolvedOrders"], maturity["ordersWithoutLedger"]
    reasons = [
        F.when(unresolved.isNull(), "resolucao_ilegivel").when(unresolved > 0, "sem_resolucao"),
        F.when(ledger.isNull(), "ledger_ilegivel").when(ledger > 0, "sem_ledger"),
        F.when(~F.coalesce(maturity["materializedAfterWindow"], F.lit(False)), "materializacao_antiga"),
    ]
    return F.when(maturity.isNull(), "sem_maturidade").otherwise(F.concat_ws(",", *reasons))


def verdict(runs: DataFrame, days: DataFrame) -> DataFrame:
    """The newest verification run of each of the ``days``: none, failed, unreadable, provisional, diverging or confirmed.

    A result without a report is unreadable; a metric counts as diverging only
    with a label.  ``pending`` names what a provisional day waits for; ``alert`` is raised for
    metrics that diverge, and only informs while the day is not mature.
    """
    from ..operators.dedup import first_by

    last = first_by(runs, ["day"], [F.desc("started_at"), F.desc("id")]).withColumn("r", F.from_json("result", RUN_RESULT)["report"])
    last = days.select("day").distinct().join(last, "day", "left")
    diverges = F.coalesce(
        F.exists("r.metrics", lambda m: F.coalesce(m["diverges"] & S.clean(m["label"]).isNotNull(), F.lit(False))),
        F.lit(False),
    )
    mature = F.coalesce(F.col("r.maturity.isMature"), F.lit(False))
    value = (
        F.when(F.col("id").isNull(), "sem_registro")
        .when(F.col("status") == "failed", "falhou")
        .when(F.col("r").isNull(), "formato_desconhecido")
        .when(~mature, "provisoria")
        .when(diverges, "divergente")
        .otherwise("conferido")
    )
    readable = ~F.col("verdict").isin("sem_registro", "falhou", "formato_desconhecido")
    alert = F.when(~readable | ~diverges, "none").when(~mature, "informational").otherwise("divergence")
    pending = F.when(F.col("verdict") == "provisoria", pending_reasons(F.col("r.maturity"))).otherwise("")
    return last.withColumn("verdict", value).withColumns({"alert": alert, "pending": pending}).select("day", "verdict", "alert", "pending")
