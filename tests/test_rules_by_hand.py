"""Rules on hand-made rows at their edges, where an easier rule would give something else."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cashlark.operators import aggregates, filters, joins, paging
from cashlark.operators.dedup import canonical_orders
from cashlark.plans import cashflow, diagnosis, health, imports, reconcile

AT = lambda day, hour=12: datetime(2024, 1, day, hour)
STORE = "id string, source string, external_order_id string, event_type string, financial_status string, total_cents long, has_payload boolean, created_at timestamp, received_at timestamp, mirror_updated_at timestamp, processed_at timestamp"
RESOLVED = "external_order_id string, gateway_raw string, dominant_amount_cents long, total_amount_cents long, processed_at timestamp"


def events(spark, *rows):
    base = {
        "source": "shopify",
        "event_type": "e",
        "financial_status": "paid",
        "total_cents": 100,
        "has_payload": True,
        "created_at": AT(5),
        "received_at": AT(5),
        "mirror_updated_at": None,
        "processed_at": None,
    }
    names = [f.split()[0] for f in STORE.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], STORE)


def rows_of(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_canonical_events_are_paid_then_newest_by_the_mirror(spark):
    found = canonical_orders(
        events(
            spark,
            {"id": "1", "external_order_id": "a", "financial_status": "pending", "received_at": AT(9)},
            {"id": "2", "external_order_id": "a", "financial_status": None, "received_at": AT(3), "mirror_updated_at": AT(10)},
            {"id": "3", "external_order_id": "b", "financial_status": "Paid", "received_at": AT(1)},
            {"id": "4", "external_order_id": "b", "financial_status": "voided", "received_at": AT(20)},
        )
    )
    assert rows_of(found, "id", "status") == {("2", "sem_status"), ("3", "paid")}


def test_inflation_is_over_orders_that_a_gateway_won(spark):
    canonical = canonical_orders(
        events(
            spark,
            *({"id": o, "external_order_id": o, "total_cents": 100} for o in "123"),
            {"id": "4", "external_order_id": "4", "financial_status": "pending"},
        )
    )
    spr = [("1", "pix", 60, 100, AT(5)), ("2", "card", 100, 100, AT(5)), ("3", None, 100, 100, AT(5)), ("4", "pix", 1, 100, AT(5))]
    resolved = diagnosis.paid_and_resolved(canonical, spark.createDataFrame(spr, RESOLVED))
    assert rows_of(diagnosis.gateway_inflation(resolved), "gateway_raw", "orders", "excess_cents", "inflation_percent") == {
        ("pix", 1, 40, 66.67),
        ("card", 1, 0, 0.0),
    }
    assert rows_of(diagnosis.misattribution(resolved), "orders", "transaction_cents", "misattributed_cents", "split_orders", "misattributed_percent") == {
        (2, 200, 40, 1, 20.0),
    }
    assert rows_of(diagnosis.value_parity(resolved), "parity", "orders") == {("equal", 2)}


def test_date_basis_keeps_undated_orders(spark):
    made = [("1", AT(5, 1)), ("2", AT(5, 1)), ("3", AT(5)), ("4", AT(5))]
    canonical = canonical_orders(events(spark, *({"id": o, "external_order_id": o, "created_at": at} for o, at in made)))
    # 01:00 UTC is the day before in the zone.
    spr = [("1", "pix", 1, 1, AT(4, 20)), ("2", "pix", 1, 1, AT(5, 12)), ("3", "pix", 1, 1, None)]
    found = diagnosis.date_basis(canonical, spark.createDataFrame(spr, RESOLVED))
    assert rows_of(found, "basis", "orders", "money_percent") == {("same_day", 1, 25.0), ("other_day", 1, 25.0), ("undated", 2, 50.0)}


def test_backlog_counts_from_its_edge_on_and_falls_back(spark):
    rows = events(
        spark,
        {"id": "1", "external_order_id": "a", "received_at": AT(10)},
        {"id": "2", "external_order_id": "a", "received_at": None, "processed_at": AT(11)},
        {"id": "3", "external_order_id": "b", "received_at": AT(9), "processed_at": AT(20)},
        {"id": "4", "external_order_id": "c", "source": "anymarket", "received_at": AT(12)},
        {"id": "5", "external_order_id": "d", "financial_status": None, "received_at": AT(12), "has_payload": True, "total_cents": None},
    )
    assert rows_of(diagnosis.backlog_by_day(rows, AT(10)), "n", "orders") == {(1, 1)} and diagnosis.backlog_by_day(rows, AT(10)).count() == 3
    assert rows_of(diagnosis.backlog_money_by_status(rows, AT(10)), "financial_status", "orders", "total_cents") == {
        ("paid", 1, 100),
        ("", 1, 0),
    }
    assert rows_of(diagnosis.received_by_day(rows, AT(10)), "n", "oldest_order") == {(1, AT(5))}


def test_peak_and_percentile_are_of_good_runs_of_the_last_days(spark):
    runs = [("j", AT(20 + i % 9, i % 24), "ok", 10 + i, "cf-cron-1") for i in range(40)] + [
        ("j", AT(21), "failed", 999, None),
        ("j", AT(22), "running", None, "x"),
        ("j", AT(2), "ok", 5000, "cf-cron-2"),
    ]
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(runs)],
        "id long, job_name string, started_at timestamp, status string, duration_ms long, request_id string",
    )
    (row,) = aggregates.job_run_report(frame, F.lit(AT(30)), F.lit(2), 20).collect()
    assert (row["runs"], row["ok"], row["peak_ms"], row["p95_ms"], row["manual"], row["stuck"]) == (42, 40, 49, 47, 2, 1)


@pytest.mark.parametrize(
    "value, found",
    [("Mercado Livre", ["1"]), ("mercadolivre", ["1"]), ("todos", ["1", "2", "3"]), (" ", ["1", "2", "3"]), ("shopify", ["2"])],
)
def test_marketplaces_as_users_give_them(spark, value, found):
    rows = spark.createDataFrame(
        [("1", "Mercado Livre", "anymarket"), ("2", None, "shopify"), ("3", None, None)],
        "id string, marketplace string, source string",
    )
    assert sorted(r["id"] for r in rows.where(filters.marketplace_is(value)).collect()) == found


def test_conditions_that_rule_orders_out():
    assert filters.cannot_contribute(source="manual") and filters.cannot_contribute(source="elsewhere") and filters.cannot_contribute(
        sources=["manual", "import"]
    )
    assert not filters.cannot_contribute(sources=[]) and not filters.cannot_contribute(sources=["manual", "webhook"]) and not filters.cannot_contribute(
        type="income"
    )


def test_coverage_at_its_edges(spark):
    floor = AT(10)
    periods = [(1, AT(5), AT(10)), (2, None, AT(3)), (3, AT(5), AT(9)), (4, AT(10), None), (5, AT(5), None)]
    found = filters.coverage(spark.createDataFrame(periods, "id int, start timestamp, end timestamp"), floor)
    want = {
        (1, "partial", floor, AT(10)),
        (2, "full", floor, AT(3)),
        (3, "none", None, None),
        (4, "full", floor, None),
        (5, "partial", floor, None),
    }
    assert rows_of(found, "id", "coverage", "clipped_start", "clipped_end") == want


def test_one_date_means_that_day():
    now, day = datetime(2024, 8, 10, 1), datetime(2024, 8, 5)
    assert cashflow.period_range(now, "yesterday", start=day) == cashflow.period_range(now, end=day) == (day, datetime(2024, 8, 6))
    assert cashflow.period_range(now, "today", zone="America/Sao_Paulo") == (datetime(2024, 8, 9, 3), datetime(2024, 8, 10, 3))
    assert cashflow.period_range(now, days=0) == (datetime(2024, 8, 10), datetime(2024, 8, 11))
    with pytest.raises(ValueError, match="d14"):
        cashflow.period_range(now, "d14")


def test_verdicts_of_stored_runs(spark):
    mature = '"maturity": {"isMature": true, "unresolvedOrders": 0, "ordersWithoutLedger": 0, "materializedAfterWindow": true}'
    results = [
        '{"report": {"metrics": [{"label": "gross", "diverges": true}], %s}}' % mature,
        '{"report": {"metrics": [{"diverges": true}, {"label": " ", "diverges": true}], %s}}' % mature,
        '{"metrics": [{"label": "gross", "diverges": true}], %s}' % mature,
        '{"report": {%s}}' % mature,
        '{"report": {"metrics": []}}',
        None,
    ]
    days = [f"2024-01-0{i + 1}" for i in range(len(results))]
    runs = spark.createDataFrame(
        [(i, d, AT(9), "ok", r) for i, (d, r) in enumerate(zip(days, results))],
        "id long, day string, started_at timestamp, status string, result string",
    )
    found = {r["day"]: r["verdict"] for r in reconcile.verdict(runs, runs.select("day")).collect()}
    assert [found[d] for d in days] == [
        "divergente",
        "conferido",
        "formato_desconhecido",
        "conferido",
        "provisoria",
        "formato_desconhecido",
    ]


def test_differences_add_up(spark):
    legs = spark.createDataFrame(
        [("a", 10, AT(5)), ("b", 20, AT(5)), ("c", 30, AT(5)), ("d", 40, AT(5)), ("d", 5, AT(9)), ("x", 7, AT(9))],
        "external_order_id string, amount_cents long, processed_at timestamp",
    )
    made = [("b", 20, AT(7)), ("d", 45, AT(5)), ("e", 50, AT(5)), ("f", 0, AT(5))]
    orders = spark.createDataFrame(
        [("shopify", *m) for m in made],
        "source string, external_order_id string, amount_cents long, occurred_at timestamp",
    )
    seen = spark.createDataFrame([("shopify", o) for o in "abdef"] + [("anymarket", "c")], "source string, external_order_id string")
    window = F.lit(AT(5, 0)), F.lit(AT(6, 0))
    found = joins.explain_difference(legs, orders, seen, *window)
    want = {
        ("a", "not_materialized", 10),
        ("b", "different_date", 20),
        ("c", "absent_from_mirror", 30),
        ("d", "leg_outside_window", -5),
        ("e", "system_only", -50),
    }
    assert rows_of(found, "external_order_id", "cause", "difference_cents") == want
    sums = joins.difference_by_cause(found, legs, orders, *window)
    assert ("residual", 0, 0) in rows_of(sums, "cause", "n", "difference_cents") and sums.count() == 6


def test_payments_take_the_place_of_orders_where_they_cover_every_day(spark):
    rows = [
        ("income", "Shopify", "pix", 100, 1, 2, 3, None, AT(9), "shopify"),
        ("income", "Shopify", "pix", 50, 0, 0, 0, 0, AT(7), "shopify"),
        ("expense", "manual", None, 9, 0, 0, 0, 0, AT(9), None),
        ("income", "Amazon", "boleto", 30, 0, 0, 0, 0, AT(9), "anymarket"),
    ]
    frame = spark.createDataFrame(
        rows,
        "type string, source_bucket string, payment_method string, amount_cents long, discount_cents long, shipping_cents long, tax_cents long, fee_cents long, occurred_at timestamp, external_source string",
    )
    ledger = spark.createDataFrame(
        [("pix", 90, 2, AT(8)), ("appmax", 5, 1, AT(9)), ("pix", 11, 1, AT(6))],
        "gateway_raw string, amount_cents long, transaction_count long, processed_at timestamp",
    )
    found = cashflow.summary_by_payments(frame, ledger, datetime(2024, 1, 8), datetime(2024, 1, 10), "UTC")
    want = {
        ("current", "Shopify", "pix", 90, 0, 1, 2, 3, 2),
        ("current", "Shopify", "credit_card", 5, 0, 0, 0, 0, 1),
        ("current", "manual", "other", 0, 9, 0, 0, 0, 1),
        ("current", "Amazon", "boleto", 30, 0, 0, 0, 0, 1),
        ("previous", "Shopify", "pix", 50, 0, 0, 0, 0, 1),  # a day of the ledger is missing
    }
    assert {tuple(r) for r in found.collect()} == want
    only = cashflow.summary_by_payments(
        frame.where("payment_method = 'pix'"),
        ledger,
        datetime(2024, 1, 8),
        datetime(2024, 1, 10),
        "UTC",
        method="pix",
    )
    assert rows_of(only.where("period = 'current'"), "source_bucket", "payment_method", "income_cents") == {("Shopify", "pix", 90)}


def test_verification_counts_payments_without_tolerance(spark):
    system = spark.createDataFrame([("pix", 101, 2), ("store_credit", 9, 1)], "payment_method string, gross_cents long, n long")
    ledger = spark.createDataFrame(
        [("a", "pix", 60, 1, AT(5)), ("b", "pix", 40, 2, AT(5)), ("b", "shopify_store_credit", 9, 1, AT(5)), ("c", "pix", 1, 1, AT(9))],
        "external_order_id string, gateway_raw string, amount_cents long, transaction_count long, processed_at timestamp",
    )
    tenders = spark.createDataFrame(
        [("a", 70, AT(5), False), ("a", -5, AT(9), False), ("c", 1, AT(9), False), ("t", 1, AT(5), True)],
        "external_order_id string, amount_cents long, processed_at timestamp, test boolean",
    )
    report = lambda **o: {r["metric"]: tuple(r)[1:] for r in reconcile.verification_report(system, tenders, ledger, F.lit(AT(5, 0)), F.lit(AT(6, 0)), **o).collect()}
    found = report()
    assert found["gross"][:3] == (110, 109, 1) and not found["gross"][4] and found["method:pix"][:3] == (101, 100, 1)
    assert found["count"] == (3, 2, 1, 50.0, True) and report(by_payments=True)["count"][:3] == (3, 4, -1)
    assert found["ledger_vs_tender"] == (1, 9, 10, None, True)


def test_pending_changes_are_due_and_may_be_tried(spark):
    rows = [
        (1, "INSERT", 0, None),
        (2, "UPDATE", 4, AT(3)),
        (3, "UPDATE", 5, None),
        (4, "FETCH", 1, None),
        (5, "DELETE", 1, AT(9)),
        (6, "DELETE", 4, AT(5)),
    ]
    queue = spark.createDataFrame(rows, "id long, operation string, retries int, next_retry_at timestamp")
    assert [r["id"] for r in paging.pending_changes(queue, F.lit(AT(5)), 5, 10).collect()] == [2, 6, 1]


def test_alerts_name_critical_jobs_in_the_order_expected(spark):
    runs = [
        ("b", AT(9, 1), "failed", "no disk", "cf-cron-1"),
        ("a", AT(6, 1), "ok", None, "cf-cron-2"),
        ("c", AT(9, 11), "running", None, "cf-cron-3"),
        ("d", AT(9, 11), "ok", None, "cf-cron-4"),
    ]
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(runs)],
        "id long, job_name string, started_at timestamp, status string, error_message string, request_id string",
    )
    expected = spark.createDataFrame(
        [("b", 60, 1, 60, 0, "Bee"), ("a", 90, 1, 60, 1, "Ay"), ("c", 90, 1, 60, 2, "See"), ("d", 90, 9, 60, 3, "Dee"), ("e", 9, 1, 9, 4, "Ee")],
        "job_name string, stale_minutes int, per_day int, max_seconds int, position int, label string",
    )
    jobs = health.job_health(frame, expected.drop("position", "label"), F.lit(AT(9)))
    (row,) = health.pipeline_health(jobs, expected).collect()
    assert row["problems"] == "b,a,c,d,e" and row["critical"] == 3
    assert row["alert"] == (
        "Pipeline com problema: Bee — última execução falhou há 11 h: no disk; Ay — última execução há 3 d; tolerância de 1 h; "
        "See — começou há 60 min e não terminou; a rota é encerrada em 60 s, então a execução morreu sem registrar o fim"
    ).replace("60 min", "1 h")
    assert health.pipeline_health(jobs.where("job_name = 'd'"), expected).collect()[0]["alert"] is None


def test_periods_without_an_end_are_unknown_and_expired_files_go(spark):
    lag = spark.createDataFrame([(AT(20), AT(19))], "max_materialized_at timestamp, max_occurred_at timestamp")
    periods = spark.createDataFrame([(AT(1), None), (None, AT(2)), (AT(1), AT(2))], "start timestamp, end timestamp")
    assert rows_of(health.freshness(periods, lag, F.lit(AT(25))), "freshness", "can_show_totals") == {("unknown", True), ("fresh", True)}
    jobs = spark.createDataFrame(
        [(1, "completed", AT(5), "x"), (2, "completed", AT(9), "x"), (3, "failed", AT(5), "x"), (4, "completed", None, "x")],
        "id int, status string, expires_at timestamp, file_data string",
    )
    jobs = jobs.withColumns({"file_name": F.lit("n"), "mime_type": F.lit("m"), "file_size_bytes": F.lit(1)})
    assert rows_of(health.without_expired_files(jobs, F.lit(AT(5))), "id", "file_data", "file_name") == {
        (1, None, None),
        (2, "x", "n"),
        (3, "x", "n"),
        (4, "x", "n"),
    }


def test_cells_are_trimmed_of_any_white_space(spark):
    content = 'data;tipo;valor\n \t01/02/2024\u00a0; receita\t;" R$ 1.000,50 "\n \n'
    files = spark.createDataFrame([("f", content)], "path string, content string")
    (row,) = imports.parse(files).collect()
    assert (str(row["occurred_on"]), row["type"], row["amount_cents"]) == ("2024-02-01", "income", 100_050)
