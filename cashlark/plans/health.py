"""Job health, freshness and retention, from run histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import RUN_WINDOW_MINUTES, SCHEDULED_PREFIX, STUCK_FACTOR

# Verdicts from worst to best, with their severity.
SEVERITIES = {
    "falhou": "crit",
    "travado": "crit",
    "atrasado": "crit",
    "poucas_execucoes": "warn",
    "falhas_recentes": "warn",
    "sem_registro": "unknown",
    "rodando": "ok",
    "ok": "ok",
}
RANKS = {"crit": 3, "warn": 2, "unknown": 1, "ok": 0}


def _picked(column: Column, values: dict) -> Column:
    chosen = F.when(F.lit(False), None)
    for key, value in values.items():
        chosen = chosen.when(column == key, value)
    return chosen


def job_health(runs: DataFrame, expectations: DataFrame, as_of: Column) -> DataFrame:
    """One verdict per expected job from its scheduled runs.

    ``expectations``: job_name, stale_minutes, per_day, max_seconds.  ``detail``
    says what is wrong with a job that is critical.
    """
    age = F.greatest(
        F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000),
        F.lit(0),
    )
    own = runs.where(F.coalesce(F.col("request_id").startswith(SCHEDULED_PREFIX), F.lit(False)) & F.col("started_at").isNotNull())
    own = own.join(expectations, "job_name").withColumn("age", age)
    limit = F.ceil(F.col("max_seconds") * STUCK_FACTOR / 60)
    own = own.withColumn("dead", (F.col("status") == "failed") | ((F.col("status") == "running") & (F.col("age") > limit)))
    inside = F.col("age") <= RUN_WINDOW_MINUTES
    message = F.col("error_message") if "error_message" in runs.columns else F.lit(None).cast("string")
    newest = F.max_by(F.struct("status", "age", "dead", message.alias("message")), F.struct("started_at", "id"))
    facts = own.groupBy("job_name").agg(
        newest.alias("last"),
        F.count_if(inside).alias("runs_in_window"),
        F.count_if(inside & F.col("dead")).alias("failures"),
    )
    # The newest run is judged on its own.
    of_last = F.when((F.col("last.age") <= RUN_WINDOW_MINUTES) & F.col("last.dead"), 1).otherwise(0)
    facts = facts.withColumn("recent_failures", F.col("failures") - of_last)
    both = expectations.join(facts, "job_name", "left")
    verdict = (
        F.when(F.col("last").isNull(), "sem_registro")
        .when(F.col("last.status") == "failed", "falhou")
        .when(F.col("last.dead"), "travado")
        .when(F.col("last.age") > F.col("stale_minutes"), "atrasado")
        .when(F.col("runs_in_window") < F.col("per_day"), "poucas_execucoes")
        .when(F.col("recent_failures") > 0, "falhas_recentes")
        .when(F.col("last.status") == "running", "rodando")
        .otherwise("ok")
    )
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("runs_in_window", "recent_failures")}
    return both.withColumn("verdict", verdict).select(
        "job_name",
        "verdict",
        _picked(F.col("verdict"), SEVERITIES).alias("severity"),
        F.col("last.age").alias("minutes_since_last"),
        *[c.alias(n) for n, c in counts.items()],
        _detail().alias("detail"),
    )


def short_age(minutes: Column) -> Column:
    """Minutes, hours below two days, or days."""
    hours = F.floor(minutes / 60)
    small = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(
        hours < 48,
        F.concat(hours.cast("string"), F.lit(" h")),
    )
    return F.coalesce(small, F.concat(F.floor(hours / 24).cast("string"), F.lit(" d")))


def _detail() -> Column:
    """The words for a critical verdict; fixed texts."""
    age, text = short_age(F.col("last.age")), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    reason = F.coalesce(F.concat(F.lit(": "), F.nullif(F.col("last.message"), F.lit(""))), F.lit(""))
    end = F.col("max_seconds").cast("string")
    return (
        F.when(F.col("verdict") == "falhou", text("última execução falhou há ", age, reason))
        .when(
            F.col("verdict") == "travado",
            text("começou há ", age, " e não terminou; a rota é encerrada em ", end, " s, então a execução morreu sem registrar o fim"),
        )
        .when(F.col("verdict") == "atrasado", text("última execução há ", age, "; tolerância de ", short_age(F.col("stale_minutes"))))
    )


def pipeline_health(jobs: DataFrame, expectations: DataFrame | None = None) -> DataFrame:
    """One row: the worst severity, the jobs with problems from worst on, those that are critical, and the text of an alert on these.

    Jobs of one severity stand in the order of ``expectations`` (job_name,
    position, label), or by name without them.  Without critical jobs there is
    no alert.
    """
    rank = _picked(F.col("severity"), RANKS)
    if expectations is not None:
        jobs = jobs.join(expectations.select("job_name", "position", "label"), "job_name")
    place = F.col("position") if expectations is not None else F.lit(0)
    label = F.col("label") if expectations is not None else F.col("job_name")
    told = F.when(F.col("severity") == "crit", F.concat(label, F.lit(" — "), F.col("detail")))
    # One entry per expected job.
    problems = F.sort_array(
        F.collect_list(F.when(rank > 0, F.struct((-rank).alias("r"), place.alias("place"), "job_name", told.alias("told"))))
    )
    found = jobs.agg(F.max(rank).alias("worst"), problems.alias("problems"), F.count_if(F.col("severity") == "crit").alias("critical"))
    critical = F.array_join(F.filter(F.transform("problems", lambda p: p["told"]), lambda x: x.isNotNull()), "; ")
    return found.select(
        _picked(F.col("worst"), {v: k for k, v in RANKS.items()}).alias("severity"),
        F.array_join(F.transform("problems", lambda p: p["job_name"]), ",").alias("problems"),
        "critical",
        F.when(F.col("critical") > 0, F.concat(F.lit("Pipeline com problema: "), critical)).alias("alert"),
    )


def freshness(periods: DataFrame, lag: DataFrame, as_of: Column) -> DataFrame:
    """Whether each period's orders are all there yet, and whether totals can be shown."""
    both = periods.join(lag, F.lit(True), "left")  # the right side is one row
    through = F.col("max_occurred_at")
    status = (
        F.when(through.isNull() | F.col("start").isNull() | F.col("end").isNull(), "unknown")
        .when(F.col("end") <= through, "fresh")
        .when(F.col("start") > through, "not_yet")
        .when((F.col("end") <= as_of) & (F.col("max_materialized_at") >= F.col("end")), "fresh")
        .when(F.col("end") <= as_of, "incomplete")
        .otherwise("trailing")
    )
    return both.withColumn("freshness", status).withColumn(
        "can_show_totals",
        F.col("freshness") != "not_yet",
    ).select("start", "end", "freshness", "can_show_totals")


def mark_stale(runs: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    old = F.col("status").isin("queued", "running") & (F.col("started_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def without_expired_files(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Export jobs without the files of completed ones that have expired; the jobs themselves stay."""
    expired = (F.col("status") == "completed") & (F.col("expires_at") <= as_of) & F.col("file_data").isNotNull()
    gone = F.coalesce(expired, F.lit(False))
    return jobs.withColumns({c: F.when(~gone, F.col(c)) for c in ("file_data", "file_name", "mime_type", "file_size_bytes")})


def retained(rows: DataFrame, stamp: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(stamp) >= as_of - F.make_interval(days=F.lit(days)))


def sweep_status(cycles: DataFrame, queue: DataFrame, cursors: DataFrame, as_of: Column) -> DataFrame:
    """One row: the last cycle, good cycles of a day, repairs that wait, how far the audit's lap is, and whether two laps prove completeness.

    A cycle that ended at its deadline counts as good.  ``cursors``: pass,
    next_block, lap_end_block, lap_number.
    """
    good = F.col("status").isin("ok", "deadline") & (F.col("started_at") > as_of - F.expr("INTERVAL 24 HOURS"))
    found = cycles.agg(
        F.max("started_at").alias("last_cycle_at"),
        F.count_if(good).alias("ok_24h"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    audit = cursors.where(F.col("pass") == "audit")
    share = F.round(F.col("next_block") / F.nullif(F.col("lap_end_block"), F.lit(0)) * 100, 1)
    audit = audit.agg(F.max(share).alias("audit_percent"), F.coalesce(F.max("lap_number") >= 2, F.lit(False)).alias("is_complete"))
    # All three are one row.
    return found.join(queue.agg(F.count("*").alias("pending_repairs")), F.lit(True)).join(audit, F.lit(True))


def retry_schedule(rows: DataFrame, as_of: Column, delays: list[int]) -> DataFrame:
    """Failed changes by attempts made: due again after a growing delay, or dead after the last."""
    delay = F.element_at(F.array(*map(F.lit, delays)), F.least(F.col("attempts") + 1, F.lit(len(delays))).cast("int"))
    dead = F.col("attempts") >= len(delays)
    return rows.withColumns(
        {"outcome": F.when(dead, "dead_letter").otherwise("retry"), "next_attempt_at": F.when(~dead, as_of + F.make_interval(secs=delay))}
    )
