"""Stored tables and streams: each equals its batch, also after a crash and a repeated batch."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cashlark import registry
from cashlark.operators import bloom, checksums, joins, ranks
from cashlark.plans import day_totals, imports, orders, reconcile
from cashlark.sources.fixtures import Tables
from cashlark.sources.order_store import OrderStore
from cashlark.streaming import ingest, totals
from cashlark.streaming.changes import ChangeFeed
from cashlark.streaming.materialize import OrderSink, keep_orders
from cashlark.streaming.mirror import Mirror

EVENTS = "id string, external_order_id string, source string, event_type string, payload_json string, received_at timestamp, mirror_updated_at timestamp, processing_status string"
RESOLUTIONS = "external_order_id string, gateway_raw string, processed_at timestamp, resolved_at timestamp"


def event(order, amount, at, paid=True, mark=""):
    status = "paid" if paid else "pending"
    payload = '{"financial_status": "%s", "total_price": "%s", "created_at": "2024-01-10T12:00:00Z"}' % (status, amount)
    return (f"{order}-{at:%m%d%H}{mark}", order, "shopify", "order", payload, at, None, "processed")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def shown(df):
    return sorted((r["order_key"], r["amount_cents"], r["payment_method_raw"]) for r in df.collect())


def from_scratch(events, resolutions):
    return shown(orders.map_orders(joins.events_with_resolution(orders.newest_events(events), resolutions)))


def empty_store(spark, path, events):
    none = spark.createDataFrame([], orders.ORDER_ROW).withColumn("materialized_at", F.lit(None).cast("timestamp"))
    return OrderStore(spark, str(path), 2).create(none, events)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_day_appends_its_changes_only(spark, tmp_path):
    first = [event(f"o{i}", f"{i + 1}.00", datetime(2024, 1, 1 + i % 20, 12)) for i in range(40)]
    events, none = frame(spark, first, EVENTS), frame(spark, [], RESOLUTIONS)
    store = empty_store(spark, tmp_path / "orders", events)
    assert store.update(events, none, date(2024, 1, 1), date(2024, 1, 31)) == 1
    assert shown(store.read()) == from_scratch(events, none) and store.compact(0) > 0
    before = files(tmp_path / "orders")
    late = frame(
        spark,
        [*first, event("o3", "99.00", datetime(2024, 2, 10, 12)), event("o4", "5.00", datetime(2024, 2, 10, 13)), event("new", "7.00", datetime(2024, 2, 10))],
        EVENTS,
    )
    version = store.update(late, none, date(2024, 2, 10), date(2024, 2, 10))
    # Orders keep the cell of their first event.
    assert {(r["order_key"], r["period"]) for r in store.changes().collect()} == {("o3", "2024-01"), ("o4", "2024-01"), ("new", "2024-02")}
    assert before.items() <= files(tmp_path / "orders").items()
    assert shown(store.read()) == from_scratch(late, none) and len(shown(store.read(version))) == 40
    # The same version again, after more has landed: it sees what was before it.
    assert store.update(late, none, date(2024, 2, 10), date(2024, 2, 10), version=version) == version
    assert shown(store.read()) == from_scratch(late, none) and store.changes().count() == 3


def test_compaction_and_deletion_change_nothing_that_is_read(spark, tmp_path):
    events = frame(spark, [event(f"o{i}", "3.00", datetime(2024, 1 + i % 3, 5)) for i in range(30)], EVENTS)
    store = empty_store(spark, tmp_path / "orders", events)
    store.update(events, frame(spark, [], RESOLUTIONS), date(2024, 1, 1), date(2024, 4, 1))
    january = store.read().where("period = '2024-01'")
    store.delete(january)
    left = shown(store.read())
    assert len(left) == 20 and store.compact(0.1) == 6 and shown(store.read()) == left
    assert store.changes().isEmpty() and store.base().count() == 20 and store.compact(0.1) == 0


def test_scan_of_an_update_is_pruned(spark, tmp_path):
    events = frame(spark, [event(f"o{i}", "3.00", datetime(2024, 1 + i % 3, 5)) for i in range(6)], EVENTS)
    store = empty_store(spark, tmp_path / "orders", events)
    store.update(events, frame(spark, [], RESOLUTIONS), date(2024, 1, 1), date(2024, 4, 1))
    store.compact(0)
    store.delete(store.read().limit(2))
    plan = store.read(5, ["2024-01"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") > 1 and "PartitionFilters: []" not in plan


@pytest.mark.parametrize("crash", [False, True])
def test_streamed_orders_equal_a_batch(spark, tmp_path, monkeypatch, crash):
    at = lambda d, h=12: datetime(2024, 1, d, h)
    parts = [
        [event(f"o{i}", f"{i + 1}.00", at(10)) for i in range(8)],
        [event("o1", "50.00", at(20)), event("o2", "9.00", at(5)), event("o3", "1.00", at(25), paid=False)],
        [event("o9", "4.00", at(2)), event("o0", "6.00", at(26)), event("o0", "6.00", at(26), mark="b")],
    ]
    resolutions = [
        [("o5", "pix", at(11), at(12))],
        [("o5", "appmax", at(11), at(28)), ("o6", "pix", None, at(28)), ("o7", "boleto", at(3), at(29))],
        [("none", "pix", at(1), at(1))],
    ]
    where = [str(tmp_path / n) for n in ("events", "resolutions", "checkpoint")]
    for es, rs in zip(parts, resolutions):
        frame(spark, es, EVENTS).coalesce(1).write.mode("append").parquet(where[0])
        frame(spark, rs, RESOLUTIONS).coalesce(1).write.mode("append").parquet(where[1])
    events, known = spark.read.schema(EVENTS).parquet(where[0]), spark.read.schema(RESOLUTIONS).parquet(where[1])
    store = empty_store(spark, tmp_path / "orders", events)
    run = lambda: keep_orders(spark, where[0], events.schema, where[1], known.schema, store, where[2], files_per_batch=1)
    if crash:  # after the second batch's write and before the stream commits it
        real = OrderSink.__call__

        def dies(self, batch, batch_id):
            real(self, batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost")

        monkeypatch.setattr(OrderSink, "__call__", dies)
        with pytest.raises(Exception, match="lost"):
            run()
        monkeypatch.setattr(OrderSink, "__call__", real)
    run()
    newest = known.groupBy("external_order_id").agg(F.max_by(F.struct("gateway_raw", "processed_at"), "resolved_at").alias("r")).select(
        "external_order_id",
        "r.*",
    )
    assert shown(store.read()) == from_scratch(events, newest)
    found = shown(store.read())
    run()
    assert shown(store.read()) == found


def test_bloom_filters_miss_nothing(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("id"))
    bits = bloom.buckets_for(2000)
    filters = bloom.build(keys.limit(1000), "id", bits).unionByName(
        bloom.build(keys.where("substring(id, 2) >= 1000 and substring(id, 2) < 2000"), "id", bits)
    )
    seen = {int(r["id"][1:]) for r in bloom.maybe_seen(keys.unionByName(keys.limit(5)), "id", filters, bits).collect()}
    assert set(range(2000)) <= seen and len(seen) < 2020
    assert bloom.maybe_seen(keys, "id", filters.limit(0), bits).count() == 0


def test_grown_mirror_takes_each_event_once(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    schema = spark.createDataFrame([], "id string, received_at timestamp").schema
    mirror = Mirror(spark, str(tmp_path / "m"), schema, at(2), days_around=1, expected=100)
    take = lambda rows, n: mirror.take(spark.createDataFrame(rows, schema), n)
    take([], 0)
    take([("low", at(1)), ("a", at(2)), ("b", at(10)), ("b", at(10, 1)), ("none", None)], 1)
    assert sorted(r["id"] for r in mirror.events().collect()) == ["a", "b"]
    # a comes again long after, c is older than the mark less the grace.
    batch = [("a", at(20)), ("b", at(10)), ("c", at(9)), ("d", at(21)), ("d", at(22))]
    take(batch, 2)
    once = sorted((r["id"], r["received_at"]) for r in mirror.events().collect())
    assert once == [("a", at(2)), ("b", at(10)), ("d", at(21))]
    take(batch, 2)  # the batch is repeated
    assert sorted((r["id"], r["received_at"]) for r in mirror.events().collect()) == once
    mirror.compact(2)
    mirror.compact(3)
    assert mirror.spark.read.parquet(f"{mirror.path}/known").select("batch").distinct().collect() == [(-1,)]
    take([("a", at(23)), ("e", at(22))], 3)
    assert sorted(r["id"] for r in mirror.events().collect()) == ["a", "b", "d", "e"]
    again = Mirror(spark, str(tmp_path / "m"), schema, at(2), days_around=1, expected=100)
    assert again.start(9) == at(23) - timedelta(seconds=300)
    plan = again.near(9, date(2024, 1, 20))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_day" in plan or "received_day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_rejected_changes_heal_or_die(spark, tmp_path):
    schema = "event_id long, operation string, record_id long, payload string, table_name string"
    batches = [
        [(1, "INSERT", 1, "one", "late"), (2, "INSERT", 2, "two", "raw"), (3, "INSERT", None, "x", "raw")],
        [(4, "UPDATE", 2, "two again", "raw"), (5, "INSERT", 3, "old", "late")],
        [(6, "UPDATE", 3, "new", "raw")],
        [(7, "DELETE", 2, None, "raw")],
        [],
        [(8, "INSERT", 4, "four", "raw")],
    ]

    def judge(changes, n):
        bad = F.col("record_id").isNull() | ((F.col("table_name") == "late") & F.lit(n < 2))
        return changes.withColumn("reason", F.when(bad, "rejected"))

    feed = ChangeFeed(spark, str(tmp_path), spark.createDataFrame([], schema).schema, judge, lambda n: datetime(2024, 1, 1, n))
    for n, rows in enumerate(batches):
        feed(spark.createDataFrame(rows, schema), n)
        if n in (2, 4):  # a repeated batch
            feed(spark.createDataFrame(rows, schema), n)
    assert {(r["record_id"], r["payload"]) for r in feed.records().collect()} == {(1, "one"), (3, "new"), (4, "four")}
    assert {(r["event_id"], r["state"], r["attempts"]) for r in feed.queue().collect()} == {
        (1, "healed", 2),
        (5, "healed", 1),
        (3, "dead", 5),
    }


def test_totals_follow_legs_that_come_late(spark, tmp_path):
    at = lambda d, h: datetime(2024, 1, d, h)
    schema = "gateway_raw string, amount_cents long, processed_at timestamp"
    parts = [[("pix", 5, at(3, 12)), ("pix", 7, at(2, 1))], [("pix", 11, at(2, 5)), ("appmax", 1, at(4, 2))], [("pix", 100, at(2, 23))]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    legs = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), legs.schema, 1)
    for _ in range(2):  # the second run finds nothing new
        totals.keep_totals(stream, str(tmp_path / "totals"), str(tmp_path / "checkpoint"), late="5 days")
    want = {tuple(r) for r in ingest.daily_totals(legs).collect()}
    assert {tuple(r) for r in totals.read(spark, str(tmp_path / "totals")).collect()} == want and len(want) == 4
    assert spark.read.parquet(str(tmp_path / "totals")).count() > len(want)  # a day was emitted more than once


@pytest.mark.parametrize("seed", range(3))
def test_checksums_find_what_a_plain_diff_finds(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "a"]), rng.choice([None, 0, 1])) for i in range(300)]
    other = [(k, a, b) if rng.random() > 0.02 else (k, rng.choice([None, "", "z"]), b) for k, a, b in rows if rng.random() > 0.01] + [(999, "n", 1)] * seed
    left, right = (spark.createDataFrame(r, "k long, a string, b int") for r in (rows, list(dict.fromkeys(other))))
    plain = {tuple(r) for r in joins.diff_read_models(left, right, ["k"], ["a", "b"]).collect()}
    assert {tuple(r) for r in checksums.diff(left, right, ["k"], ["a", "b"], leaves=128).collect()} == plain
    same = checksums.diff(left, left.orderBy(F.rand()), ["k"], ["a", "b"], leaves=128)
    assert same.count() == 0 and "leaf" not in same._jdf.queryExecution().toString()


def test_discrete_percentile(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, *range(n)])) for g, n in (("a", 500), ("b", 3), ("c", 1)) for _ in range(400)] + [("none", None)]
    found = {r["g"]: r["v"] for r in ranks.discrete_percentile(spark.createDataFrame(rows, "g string, v long"), "g", "v", 95).collect()}
    for g in "abc":
        known = sorted(v for k, v in rows if k == g and v is not None)
        assert found.pop(g) == known[-(-95 * len(known) // 100) - 1]
    assert not found


def test_large_csv_files_are_split(spark, tmp_path):
    body = [
        "data;tipo;valor;descricao;categoria;origem",
        *(f'{1 + i % 28:02}/01/2024;receita;"{i},50";linha {i};;' for i in range(4000)),
        "",
        "   ",
        "x;y;z",
    ]
    (tmp_path / "a.csv").write_bytes("\r\n".join(body).encode())
    (tmp_path / "b.csv").write_text("valor;data;tipo\n\n10;2024-01-02;despesa")
    (tmp_path / "c.csv").write_text("data;tipo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = imports.read_lines(spark, str(tmp_path))
        assert lines.select("path", "block").distinct().count() > 8
        found = imports.parse_lines(lines)
        whole = imports.parse(imports.read_files(spark, str(tmp_path)))
        name = F.regexp_extract("path", "[^/]*$", 0)
        rows = [{tuple(r) for r in x.select(whole.columns).withColumn("path", name).collect()} for x in (found, whole)]
        assert rows[0] == rows[1] and found.count() == 4002
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_maintained_totals_equal_totals_from_scratch(spark, tmp_path):
    days = [datetime(2024, 1, 5), datetime(2024, 1, 6, 1), datetime(2024, 2, 1)]
    events = frame(spark, [event(f"o{i}", f"{i}.00", days[i % 3]) for i in range(1, 12)], EVENTS)
    resolved = frame(
        spark,
        [("o2", "pix", datetime(2024, 1, 9), datetime(2030, 1, 1)), ("o3", "pix", datetime(2024, 1, 5), datetime(2030, 1, 1))],
        RESOLUTIONS,
    )
    store, path = empty_store(spark, tmp_path / "orders", events), str(tmp_path / "totals")
    day_totals.create(store.read(), path)
    steps = [
        (events.where("external_order_id <> 'o5'"), resolved.limit(0)),
        (events, resolved),
        (events.where("external_order_id <> 'o7'").unionByName(frame(spark, [event("o7", "0.00", days[2])], EVENTS)), resolved),
    ]
    for rows, known in steps:
        version = store.update(rows, known, date(2024, 1, 1), date(2024, 2, 28))
        for _ in range(2):  # adding a version twice counts it once
            day_totals.add_version(store, path, version)
        assert {tuple(r) for r in day_totals.read(spark, path).collect()} == {tuple(r) for r in day_totals.counted(store.read()).collect()}
    assert store.read().count() == 10


def test_stored_tenders_are_read_by_month(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "tenders")
    t.tenders_fx.withColumn("processed_month", F.to_date(F.date_trunc("month", "processed_at"))).repartition("processed_month").write.partitionBy("processed_month").parquet(
        path
    )
    tenders = spark.read.parquet(path)
    spans = reconcile.tender_spans(tenders.where("processed_month < '1995-01-01'"))
    spans = reconcile.widened(spans, tenders.where("processed_month >= '1995-01-01'"))
    first, last, zone = date(1995, 3, 1), date(1995, 3, 20), "America/Sao_Paulo"
    found = reconcile.detect_stored(tenders, spans, registry.split(t), first, last, zone)
    edges = [F.lit(datetime(1995, 3, 1, 3)), F.lit(datetime(1995, 3, 21, 3))]
    plain = reconcile.detect(t.tenders_fx, registry.split(t), *edges, zone)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in plain.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "processed_month" in plan and "1998" not in plan.split("PartitionFilters")[-1][:400]
