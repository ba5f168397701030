"""Logical tables of the engine over the star-schema test tables.

Each is one SELECT that both Spark and DuckDB run, so a query and its SQL twin
share their input and nothing else.  ``{name}`` stands for another table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def cents(amount: str) -> str:
    return f"CAST(floor(({amount}) * 100 + 0.5) AS BIGINT)"


FIXTURES = {
    "raw_events_fx": f"""SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS external_order_id, CASE user_id % 3 WHEN 0 THEN 'anymarket' ELSE 'shopify' END AS source,
        CASE event_type WHEN 'purchase' THEN 'paid' ELSE 'pending' END AS status, ts AS received_at, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS mirror_updated_at,
        {cents('value')} AS total_cents, event_type FROM {{events}}""",
    "order_parts_fx": f"""SELECT l_orderkey, CAST(sum({cents('l_extendedprice * l_discount')}) AS BIGINT) AS discount_cents, CAST(sum({cents('l_extendedprice * l_tax')}) AS BIGINT) AS tax_cents,
        CAST(sum({cents('l_quantity')}) AS BIGINT) AS shipping_cents FROM {{lineitem}} GROUP BY l_orderkey""",
    "orders_fx": f"""SELECT CAST(o_orderkey AS STRING) AS order_key, CAST(o_orderkey AS STRING) AS external_order_id, o_orderdate AS occurred_at, c_mktsegment AS marketplace,
        CASE o_orderkey % 4 WHEN 0 THEN 'anymarket' ELSE 'shopify' END AS source, CASE o_orderkey % 4 WHEN 0 THEN 'anymarket' ELSE 'shopify' END AS external_source,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Pix (3% de desconto)' WHEN '2-HIGH' THEN 'Appmax - Cartão de Crédito' WHEN '3-MEDIUM' THEN 'boleto' WHEN '4-NOT SPECIFIED' THEN 'shopify_store_credit' ELSE 'outro' END AS payment_method_raw,
        {cents('o_totalprice')} AS amount_cents, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'applied' ELSE 'rejected' END AS status, 'income' AS type,
        discount_cents, tax_cents, shipping_cents, CAST(NULL AS BIGINT) AS fee_cents, CAST(NULL AS BIGINT) AS category_id, o_orderdate + INTERVAL '3' DAY AS materialized_at, o_custkey AS custkey
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey LEFT JOIN {{order_parts_fx}} ON l_orderkey = o_orderkey""",
    "entries_fx": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN 'income' WHEN o_orderkey % 5 < 4 THEN 'expense' ELSE 'transfer' END AS type,
        CASE o_orderkey % 2 WHEN 0 THEN 'manual' ELSE 'import' END AS source, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS category_id, o_orderdate AS occurred_at,
        {cents('o_totalprice')} AS amount_cents, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'applied' ELSE 'rejected' END AS status, c_mktsegment AS description, lower(c_mktsegment) AS search_text
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "storefront_events_fx": " UNION ALL ".join(
        f"""SELECT CAST(k * 3 + {n} AS STRING) AS id, CASE k % 9 WHEN 0 THEN 'anymarket' ELSE 'shopify' END AS source,
        CASE WHEN {n} = 2 AND k % 23 = 0 THEN NULL ELSE CAST(k AS STRING) END AS external_order_id, '{kind}' AS event_type, {status} AS financial_status,
        CASE WHEN k % 29 = 0 THEN NULL ELSE cents + {13 * n} * (k % 3) END AS total_cents, (k + {n}) % 19 <> 0 AS has_payload, created_at,
        CASE WHEN {n} = 2 AND k % 11 = 0 THEN NULL ELSE created_at + INTERVAL '{n}' DAY END AS received_at,
        CASE (k + {n}) % 3 WHEN 0 THEN NULL WHEN 1 THEN created_at + INTERVAL '{10 - 3 * n}' DAY ELSE created_at + INTERVAL '{n + 1}' DAY END AS mirror_updated_at,
        created_at + INTERVAL '{n + 2}' DAY AS processed_at
        FROM (SELECT o_orderkey AS k, {cents('o_totalprice')} AS cents, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '2' HOUR WHEN 1 THEN o_orderdate + INTERVAL '12' HOUR
        ELSE o_orderdate + INTERVAL '23' HOUR END AS created_at FROM {{orders}})"""
        for n, kind, status in (
            (0, "orders/create", "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'PAID' WHEN 2 THEN 'pending' ELSE 'Paid' END"),
            (1, "orders/updated", "CASE k % 7 WHEN 0 THEN 'refunded' ELSE 'pending' END"),
            (2, "orders/paid", "CASE k % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'voided' END"),
        )
    ),
    "categories_fx": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_regionkey % 2 WHEN 0 THEN 'income' ELSE 'expense' END AS direction FROM {nation} WHERE n_nationkey < 23",
    "payment_tx_fx": f"""SELECT CAST(l_orderkey AS STRING) AS external_order_id, CASE l_returnflag WHEN 'A' THEN 'pix' WHEN 'N' THEN 'appmax' ELSE 'shopify_store_credit' END AS gateway_raw,
        CASE l_linenumber % 4 WHEN 0 THEN 'authorization' WHEN 1 THEN 'sale' WHEN 2 THEN 'capture' ELSE 'refund' END AS kind, CASE l_linestatus WHEN 'F' THEN 'success' ELSE 'failure' END AS status,
        {cents('l_extendedprice')} AS amount_cents, l_shipdate AS processed_at, l_orderkey, l_partkey FROM {{lineitem}}""",
    "tenders_fx": """SELECT external_order_id, processed_at, CASE WHEN l_orderkey % 97 = 0 THEN -amount_cents ELSE amount_cents + CASE WHEN l_orderkey % 50 = 0 THEN 777 ELSE 0 END END AS amount_cents,
        l_partkey % 101 = 0 AS test FROM {payment_tx_fx} WHERE status = 'success' AND kind IN ('sale', 'capture', 'change') AND gateway_raw <> 'shopify_store_credit'""",
    "job_runs_fx": f"""SELECT event_id AS id, event_type AS job_name, ts AS started_at, {cents('value')} AS duration_ms, CASE event_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'ok' END AS status,
        CASE WHEN event_id % 6 = 0 THEN 'manual' ELSE 'cf-cron-' || CAST(event_id AS STRING) END AS request_id,
        CASE event_id % 50 WHEN 0 THEN 'request Timed Out after 60 s' WHEN 10 THEN 'Invalid value of occurredAt' WHEN 20 THEN 'socket hang up' WHEN 30 THEN 'Unique violation: id' WHEN 40 THEN 'broken' END AS error_message FROM {{events}}""",
    "divergences_fx": f"""SELECT CAST(o_orderkey AS STRING) AS external_order_id, CAST(o_orderdate AS DATE) AS day, {cents('o_totalprice')} AS tender_cents, {cents('o_totalprice / 2')} AS ledger_cents_before,
        {cents('o_totalprice')} - {cents('o_totalprice / 2')} AS delta_cents,
        CASE o_orderkey % 6 WHEN 0 THEN 'pendente' WHEN 1 THEN 'persistente' WHEN 2 THEN 'corrigido' WHEN 3 THEN 'sem_correcao' WHEN 4 THEN 'aceito' ELSE 'pendente' END AS status,
        CAST(o_custkey % 6 AS INT) AS attempts, o_orderdate AS next_attempt_at, 1 AS occurrences, o_orderdate AS last_checked_at FROM {{orders}}""",
    "changes_fx": """SELECT event_id, CASE event_id % 10 WHEN 9 THEN 'DELETE' WHEN 8 THEN 'UPDATE' WHEN 7 THEN 'UPDATE' ELSE 'INSERT' END AS operation, CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id END AS record_id,
        CASE WHEN event_id % 37 = 0 THEN NULL ELSE props END AS payload, CASE WHEN event_id % 43 = 0 THEN 'other' ELSE 'raw_payloads' END AS table_name, ts FROM {events}""",
}


def needed(names: list[str]) -> list[str]:
    """The named logical tables and those that they stand on, in order of use."""
    out: list[str] = []
    for name in names:
        if name in FIXTURES:
            for other in [*needed(re.findall(r"(?<!\{)\{(\w+)\}", FIXTURES[name])), name]:
                if other not in out:
                    out.append(other)
    return out


class Tables:
    """Test tables and logical tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # The JVM does not compile longer methods, so steps that would need one run as Spark's own smaller ones.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        text = FIXTURES[name]
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})


def twin(sql: str) -> str:
    """A DuckDB query over logical tables: their definitions, then ``sql``."""
    used = needed([n for n in FIXTURES if re.search(rf"\b{n}\b", sql)])
    parts = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', FIXTURES[n]).replace(' AS STRING)', ' AS VARCHAR)')})" for n in used]
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {sql[5:]}" if parts else sql
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
