"""Order independence, idempotence, streaming against batch, and sinks."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cashlark import registry
from cashlark.operators import dedup, ranks, state
from cashlark.plans import cashflow, health, imports, orders, payments, reconcile
from cashlark.sources import sinks
from cashlark.sources.fixtures import Tables
from cashlark.sources.payloads import orders_extract
from cashlark.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize(
    "name",
    [
        "agg1_cash_flow_by_source_method_type",
        "ded1_dedup_events",
        "agg11_dominant_gateway",
        "cf1_cash_flow_summary",
        "hlt1_job_health",
        "src9_import_csv",
        "src9_import_csv_by_lines",
        "agg26_gateway_inflation",
        "agg28_date_basis",
        "jn9_diff_by_checksums",
        "jn11_explain_difference",
        "rec5_verification_report",
        "cf4_summary_by_payments",
    ],
)
def test_queries_match_their_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("nation", "customer", "orders", "lineitem", "events"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    ours = registry.queries()[name](spark, SF)
    twin = con.sql(registry.oracle_sql()[name])
    at = [twin.columns.index(c) for c in sorted(twin.columns)]
    theirs = [tuple(str(r[i]) for i in at) for r in twin.fetchall()]
    found = [tuple(str(v) for v in r) for r in ours.select(sorted(ours.columns)).collect()]
    assert sorted(found) == sorted(theirs)


def test_dedup_does_not_depend_on_order(spark):
    rows = [(f"e{i}", f"o{i % 5}", "shopify", i % 3 == 0, None if i % 4 == 0 else datetime(2024, 1, 1 + i % 7)) for i in range(40)]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "id string, external_order_id string, source string, paid boolean, ts timestamp")
        found.add(tuple(sorted(r["id"] for r in dedup.dedup_events(df, F.col("paid"), F.col("ts")).collect())))
    assert len(found) == 1


def test_materialising_twice_changes_nothing(spark, tmp_path):
    t = Tables(spark, SF)
    events, none = registry.payload_events(t), registry.no_resolution(t)
    empty = spark.createDataFrame([], orders.map_orders(orders.joins.events_with_resolution(orders.newest_events(events), none)).schema)
    days = (date(1998, 1, 1), date(1998, 12, 31))
    sinks.write_orders(orders.materialize(empty, events, none, *days), str(tmp_path / "orders"), 4)
    current = spark.read.parquet(str(tmp_path / "orders"))
    assert current.count() > 0
    again = {r["change"]: r["n"] for r in orders.change_counts(orders.materialize(current, events, none, *days)).collect()}
    assert set(again) == {"unchanged"}


def test_orders_that_no_longer_hold_are_deleted(spark):
    t = Tables(spark, SF)
    events, none = registry.payload_events(t), registry.no_resolution(t)
    current = orders.map_orders(orders.joins.events_with_resolution(orders.newest_events(events), none))
    unpaid = events.withColumn("payload_json", F.lit("{}"))
    changes = {
        r["change"]
        for r in orders.change_counts(orders.materialize(current, unpaid, none, date(1990, 1, 1), date(2005, 1, 1))).collect()
    }
    assert changes == {"deleted"}


def test_stream_of_changes_equals_batch(spark, tmp_path):
    t = Tables(spark, SF)
    changes = t.changes_fx.where("record_id is not null and payload is not null").select("event_id", "operation", "record_id", "payload")
    for part in range(4):
        changes.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {"state": changes.where("false").select("record_id", "payload", "event_id"), "n": 0}

    def sink(batch, _):
        last = ingest.last_change(batch).select("record_id", "payload", "event_id", "operation")
        newer = last.join(
            seen["state"].select("record_id", F.col("event_id").alias("old")),
            "record_id",
            "left",
        ).where("old is null or event_id > old").drop("old")
        merged = seen["state"].join(newer.select("record_id"), "record_id", "left_anti").unionByName(
            newer.select("record_id", F.when(F.col("operation") != "DELETE", F.col("payload")).alias("payload"), "event_id")
        )
        path = str(tmp_path / f"state-{seen['n']}")
        merged.write.parquet(path)
        seen.update(state=spark.read.parquet(path), n=seen["n"] + 1)

    stream = ingest.source(spark, str(tmp_path / "in"), changes.schema, files_per_batch=1)
    ingest.run_once(stream, sink, str(tmp_path / "checkpoint"))
    assert seen["n"] == 4
    streamed = {(r["record_id"], r["payload"]) for r in seen["state"].where("payload is not null").collect()}
    batch = {
        (r["record_id"], r["payload"])
        for r in ingest.apply_changes(changes.where("false").select("record_id", "payload"), changes).collect()
    }
    assert streamed == batch


def test_streamed_events_are_deduplicated(spark, tmp_path):
    rows = Tables(spark, SF).raw_events_fx.select("id", "received_at").withColumn("received_at", F.col("received_at").cast("timestamp"))
    rows.union(rows.where("cast(id as bigint) % 3 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = ingest.fresh_events(ingest.source(spark, str(tmp_path / "in"), rows.schema), grace="40 days")
    ingest.run_once(stream, lambda batch, _: batch.write.mode("append").parquet(out), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(out).count() == rows.count()


def test_snapshots_replace_their_day_only(spark, tmp_path):
    rows = Tables(spark, SF).entries_fx
    first, second = [
        r[0]
        for r in rows.select(
            F.to_date(F.from_utc_timestamp("occurred_at", "America/Sao_Paulo")).alias("d")
        ).distinct().orderBy("d").limit(2).collect()
    ]
    path = str(tmp_path / "days")
    for day in (first, second, first):
        sinks.snapshot_day(rows, day, "America/Sao_Paulo", path)
    whole = spark.read.parquet(path)
    assert whole.select("id").distinct().count() == whole.count() > 0
    assert sinks.read_snapshot(spark, first, path).count() > 0


def test_backfill_refuses_to_go_below_the_floor(spark):
    rows = Tables(spark, SF).raw_events_fx
    with pytest.raises(ValueError):
        sinks.backfill_window(rows, rows, datetime(2023, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1), ["status"])


def test_landed_pages_of_orders(spark, tmp_path):
    (tmp_path / "page.json").write_text(
        '{"orders": [{"id": 7, "name": "#7", "total_price": "10.00", "total_tax": "1.00", "processed_at": "2024-01-01T00:00:00Z", "payment_gateway_names": ["pix"]}]}'
    )
    row = orders.map_extract(orders_extract(spark, str(tmp_path))).first()
    assert (
        row["external_id"],
        row["order_number"],
        row["amount_cents"],
        row["tax_cents"],
        row["payment_method_normalized"],
    ) == ("7", "#7", 1000, 100, "pix")


def test_csv_quirks(spark):
    text = 'Data;Tipo;Valor;Descrição;Origem\n01/02/2024,receita,"1.234,56",a;b\n2024-02-30;despesa;5\n\n2024-03-01;Saída;1.234;"x;y"\n'
    rows = {
        r["row_index"]: r
        for r in imports.parse(
            spark.createDataFrame([("f", text), ("empty", ""), ("head", "data")], "path string, content string")
        ).collect()
    }
    assert (rows[1]["amount_cents"], rows[1]["description"], rows[1]["origin"], rows[1]["type"]) == (123456, "a", "b", "income")
    assert rows[2]["status"] == "error" and "data inválida" in rows[2]["error_message"]
    assert (rows[3]["amount_cents"], rows[3]["description"]) == (123400, "x;y")


def test_periods():
    start, end = cashflow.period_range(datetime(2024, 3, 10, 15), "d7")
    assert (start, end) == (datetime(2024, 3, 4), datetime(2024, 3, 11))
    assert cashflow.previous_period(start, end) == (datetime(2024, 2, 26), datetime(2024, 3, 4))
    assert cashflow.period_range(datetime(2024, 3, 10), "yesterday") == (datetime(2024, 3, 9), datetime(2024, 3, 10))


def test_job_health_precedence(spark):
    now = datetime(2024, 1, 2)
    runs = [
        (1, "a", datetime(2024, 1, 1, 23, 50), "failed", "cf-cron-1"),
        (2, "b", datetime(2024, 1, 1, 20), "running", "cf-cron-2"),
        (3, "c", datetime(2024, 1, 1, 23, 59), "ok", "manual"),
        (4, "d", datetime(2024, 1, 1, 23, 59), "ok", "cf-cron-4"),
    ]
    df = spark.createDataFrame(runs, "id long, job_name string, started_at timestamp, status string, request_id string")
    expected = spark.createDataFrame([(j, 60, 1, 60) for j in "abcd"], "job_name string, stale_minutes int, per_day int, max_seconds int")
    found = health.job_health(df, expected, F.lit(now))
    assert {r["job_name"]: r["verdict"] for r in found.collect()} == {"a": "falhou", "b": "travado", "c": "sem_registro", "d": "ok"}
    assert health.pipeline_health(found).first()["problems"] == "a,b,c"


def test_retry_days_run_out(spark):
    rows = spark.createDataFrame([("o", "persistente", n) for n in range(5)], "external_order_id string, status string, attempts int")
    found = reconcile.retry_outcome(rows, F.lit(datetime(2024, 1, 1)), F.lit(True)).orderBy("attempts").collect()
    assert [r["status"] for r in found] == ["persistente"] * 4 + ["sem_correcao"]
    assert [r["next_attempt_at"].day if r["next_attempt_at"] else None for r in found] == [2, 3, 5, 9, None]


def test_empty_legs_clear_only_on_request(spark):
    ledger = spark.createDataFrame([("1", "pix", 5), ("2", "pix", 7)], "external_order_id string, gateway_raw string, amount_cents long")
    none, orders_ = ledger.where("false"), ledger.select("external_order_id").limit(1)
    assert state.replace_legs(ledger, none, orders_).count() == 2
    assert state.replace_legs(ledger, none, orders_, clear_empty=True).count() == 1


def test_candidates_are_half_open_business_days(spark):
    stamps = [datetime(2024, 1, 8, 2, 59, 59), datetime(2024, 1, 8, 3), datetime(2024, 1, 13, 2, 59, 59), datetime(2024, 1, 13, 3)]
    rows = spark.createDataFrame(
        [(f"e{i}", f"o{i}", "shopify", "{}", at) for i, at in enumerate(stamps)],
        "id string, external_order_id string, source string, payload_json string, received_at timestamp",
    )
    assert sorted(r["order_key"] for r in orders.candidates(rows, date(2024, 1, 10), date(2024, 1, 10)).collect()) == ["o1", "o2"]


def paid_event(order, amount, at):
    return (
        f"{order}-{at:%d%H}",
        order,
        "shopify",
        "order",
        '{"financial_status": "paid", "total_price": "%s", "created_at": "2024-01-10T12:00:00Z"}' % amount,
        at,
        None,
        "processed",
    )


EVENTS = "id string, external_order_id string, source string, event_type string, payload_json string, received_at timestamp, mirror_updated_at timestamp, processing_status string"


def test_orders_resolved_late_are_materialised_again(spark, tmp_path):
    day, now = date(2024, 1, 10), datetime(2024, 1, 11)
    events = spark.createDataFrame([paid_event(f"o{i}", "10.00", datetime(2024, 1, 10, 12)) for i in range(8)], EVENTS)
    none = registry.no_resolution(Tables(spark, SF))
    path = str(tmp_path / "orders")
    empty = spark.createDataFrame([], orders.map_orders(orders.joins.events_with_resolution(orders.newest_events(events), none)).schema)
    sinks.write_orders(orders.materialize_day(empty, events, none, day, now), path, 4)
    assert {(r["payment_method_raw"], r["materialized_at"]) for r in sinks.read_orders(spark, path).collect()} == {(None, now)}
    stale, early = ("o3", "pix", datetime(2024, 1, 9), datetime(2024, 1, 20)), ("o4", "pix", datetime(2024, 1, 9), datetime(2024, 1, 1))
    resolved = spark.createDataFrame(
        [stale, early],
        "external_order_id string, gateway_raw string, processed_at timestamp, resolved_at timestamp",
    )
    before = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "orders").glob("bucket=*")}
    sinks.update_orders(events, resolved, path, 4, date(2024, 3, 1), date(2024, 3, 1), datetime(2024, 1, 21))
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "orders").glob("bucket=*")}
    rows = {r["order_key"]: r for r in sinks.read_orders(spark, path).collect()}
    assert len(rows) == 8 and rows["o3"]["payment_method_raw"] == "pix" and rows["o3"]["occurred_at"] == datetime(2024, 1, 9) and rows["o3"]["materialized_at"] == datetime(2024, 1, 21)
    assert rows["o4"]["payment_method_raw"] is None and sum(before[k] != after[k] for k in before) == 1
    sinks.update_orders(events.withColumn("payload_json", F.lit("{}")), resolved, path, 4, day, day)
    assert sinks.read_orders(spark, path).count() == 0


def test_export_is_one_file_with_mark_and_headings(spark, tmp_path):
    rows = spark.createDataFrame(
        [('Loja "A"; B', None, None, None, "Pedido #7", "", "cash", datetime(2024, 1, 2, 1), 1050, None, 5, -3, 2)],
        "marketplace string, external_source string, source string, order_number string, description string, payment_method_raw string, payment_method_normalized string, occurred_at timestamp, amount_cents long, shipping_cents long, discount_cents long, tax_cents long, fee_cents long",
    )
    cashflow.write_export(cashflow.export_rows(rows, "America/Sao_Paulo"), str(tmp_path / "out"), single=True)
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_text(encoding="utf-8") == '﻿Marketplace;Numero do pedido;Data;Forma de pagamento;Entrega;Descontos;Taxas;Valor\n"Loja ""A""; B";#7;01/01/2024;Dinheiro;0.00;0.05;-0.01;10.50\n'


def test_ingestion_remembers_stored_ids(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    frame = lambda rows: spark.createDataFrame(rows, "id string, received_at timestamp")
    stored = frame([("a", at(1)), ("b", at(5))])
    arrivals = frame([("a", at(9)), ("b", at(5)), ("c", datetime(2024, 1, 1, 4, 56)), ("d", at(2)), ("e", at(8)), ("e", at(8))])
    assert sorted(r["id"] for r in ingest.incremental(stored, arrivals, at(0)).collect()) == ["c", "e"]
    assert sorted(r["id"] for r in ingest.incremental(stored.limit(0), arrivals, at(3)).collect()) == ["a", "b", "c", "e"]


def test_streamed_ingestion_equals_batch(spark, tmp_path):
    rows = Tables(spark, SF).raw_events_fx.select("id", "received_at").withColumn("received_at", F.col("received_at").cast("timestamp"))
    source, mirror = str(tmp_path / "in"), str(tmp_path / "mirror")
    for part in rows.randomSplit([1.0, 1.0, 1.0], 3):
        part.unionByName(rows.limit(20)).orderBy("received_at").coalesce(1).write.mode("append").parquet(source)
    rows.limit(0).write.parquet(mirror)

    def sink(batch, _):
        ingest.incremental(
            spark.read.schema(rows.schema).parquet(mirror),
            batch,
            datetime(2024, 1, 1),
            grace_seconds=40 * 86400,
        ).write.mode("append").parquet(mirror)

    ingest.run_once(ingest.source(spark, source, rows.schema, files_per_batch=1), sink, str(tmp_path / "checkpoint"))
    found = [r["id"] for r in spark.read.parquet(mirror).collect()]
    assert len(found) == len(set(found)) == rows.count()


def test_numbers_and_gaps_need_no_whole_group(spark):
    rng = random.Random(5)
    rows = [
        ("ab"[i % 7 > 0], i, datetime.fromtimestamp(1_700_000_000 + rng.randrange(10**6) * (1 + 9 * (i % 5 == 0))))
        for i in range(300)
    ] + [("c", 1, None)]
    frame = spark.createDataFrame(rows, "g string, k long, ts timestamp")
    for r in ranks.numbered(frame, "g", ["k"]).collect():
        own = sorted(k for g, k, _ in rows if g == r["g"])
        assert (r["_n"], own[r["_j"]]) == (len(own), r["k"])
    found = {r["g"]: r["gap_micros"] for r in ranks.largest_gaps(frame, "g", "ts").collect()}
    for g in "ab":
        own = sorted(t for x, _, t in rows if x == g)
        assert found[g] == max((b - a).total_seconds() for a, b in zip(own, own[1:])) * 1e6


def test_events_by_day_and_legs_by_order(spark, tmp_path):
    rows = Tables(spark, SF).raw_events_fx
    sinks.write_events(rows, str(tmp_path / "events"))
    days = {p.name for p in (tmp_path / "events").glob("received_day=*")}
    assert len(days) == rows.select(F.to_date("received_at")).distinct().count()
    assert spark.read.parquet(str(tmp_path / "events")).drop("received_day").count() == rows.count()
    legs = spark.createDataFrame(
        [("1", "pix", "sale", "success", 5), ("1", "card", "sale", "success", 7), ("2", "pix", "sale", "failure", 9), ("3", "pix", "sale", "success", 1)],
        "external_order_id string, gateway_raw string, kind string, status string, amount_cents long",
    ).withColumn("processed_at", F.lit(datetime(2024, 1, 1)))
    ledger = payments.A.gateway_split(legs).where("external_order_id <> '1'").withColumn("amount_cents", F.lit(100).cast("long"))
    found = payments.resolve_into(ledger, legs.select("external_order_id").where("external_order_id < '3'"), legs)
    assert sorted((r["external_order_id"], r["gateway_raw"], r["amount_cents"]) for r in found.collect()) == [("1", "card", 7), ("1", "pix", 5), ("3", "pix", 100)]


def test_finance_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Data;Tipo;Valor\n01/02/2024;receita;5\n")
    (tmp_path / "b.csv").write_text("")
    files = imports.read_files(spark, str(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in files.collect()} >= {"a.csv"}
    assert imports.parse(files).where("status <> 'error'").count() == 1
