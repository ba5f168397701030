import pytest
from pyspark.sql import functions as F

from cashlark.functions import scalars as S
from cashlark.sources.payloads import order_payload


def apply(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "rule,cases",
    [
        (
            S.marketplace_token,
            {
                " Mercado Livre ": "mercado_livre",
                "MercadoLivre": "mercado_livre",
                "Todos": None,
                "": None,
                None: None,
                "São-João": "sao_joao",
            },
        ),
        (S.title_words, {"mercado_livre": "Mercado Livre", "TIKTOK-shop": "Tiktok Shop"}),
        (S.origin_label, {"amazon": "Amazon", "tiktok": "TikTok Shop", "outra_loja": "Outra Loja", "Shopee": "Shopee"}),
        (
            S.classify_payment,
            {
                "Pix (3% de desconto)": "pix",
                "Appmax - Cartão de Crédito": "credit_card",
                "shopify_store_credit": "store_credit",
                "Crédito em loja | pix": "store_credit",
                "": "other",
                None: "other",
                "outro": "other",
                "Apple Pay": "wallet",
                "Dinheiro": "cash",
                "TED": "bank_transfer",
            },
        ),
        (
            S.money_locale,
            {"1.234,56": 123456, "1234.56": 123456, "12abc": 0, "": 0, None: 0, "-0.005": 0, "2,5": 250, "NaN": 0, "Infinity": 0},
        ),
        (lambda c: S.first_money(c), {"1.234,56": 123, "12abc": 1200, "abc": None, " 3,5": 350, None: None}),
        (S.paid_token, {"paid": True, "Pago": True, "PAID_partially": True, "unpaid": False, None: False, " paid ": True}),
        (S.gateway_or_none, {"": "sem_gateway", " pix ": "pix", None: "sem_gateway"}),
    ],
)
def test_rules(spark, rule, cases):
    assert apply(spark, rule, list(cases)) == list(cases.values())


def test_percentages(spark):
    rows = spark.createDataFrame([(110, 100), (5, 0), (0, 0), (90, -100)], "a long, b long")
    found = rows.select(
        S.delta_percent(F.col("a"), F.col("b")).alias("d"),
        S.difference_percent(F.col("a"), F.col("b")).alias("p"),
    ).collect()
    assert [(r["d"], r["p"]) for r in found] == [(10.0, 10.0), (None, 100.0), (None, 0.0), (190.0, -190.0)]


def test_local_day_follows_the_zone(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 02:30:00' AS ts")
    assert str(rows.select(S.local_day(F.col("ts"), "America/Sao_Paulo")).first()[0]) == "2023-12-31"


def test_hash_tells_null_places_apart(spark):
    rows = spark.createDataFrame([("a", None), (None, "a")], "a string, b string")
    found = [r[0] for r in rows.select(S.content_hash(F.col("a"), F.col("b"))).collect()]
    assert found[0] != found[1]


def money(spark, json, rule):
    return spark.createDataFrame([(json,)], "j string").select(rule(order_payload(F.col("j")))).first()[0]


@pytest.mark.parametrize(
    "json,shipping",
    [
        ('{"total_shipping_price_set": {"shop_money": {"amount": "12.50"}}, "total_shipping_price": "1"}', 1250),
        ('{"shipping_lines": [{"price": "10.00", "discounted_price": "7.00"}, {"price": "5.00"}]}', 700),
        ('{"shipping_lines": [{"price": "10.00"}, {"price": 5}]}', 1500),
        ('{"total_price": "110.00", "subtotal_price": "100.00"}', 1000),
        ('{"total_price": "100.00", "subtotal_price": "110.00"}', 0),
        ('{"total_price": "90000.00", "subtotal_price": "1.00"}', 0),
        ("{}", 0),
    ],
)
def test_shipping(spark, json, shipping):
    assert money(spark, json, S.shipping_cents) == shipping


@pytest.mark.parametrize(
    "json,dominant,raw",
    [
        ('{"payment_gateway_names": ["Pix", "shopify_store_credit"]}', None, "Crédito em loja | Pix"),
        ('{"payment_gateway_names": ["pix"], "tags": "PIX, visa|extra, none"}', None, "pix | visa | extra"),
        ('{"transactions": [{"gateway": "g", "payment_details": {"credit_card": {"brand": "Visa"}}}]}', None, "Visa"),
        ('{"note": "pago por boleto ontem"}', None, "boleto"),
        ('{"note_attributes": [{"name": "forma", "value": "Dinheiro"}]}', None, "Dinheiro"),
        ('{"gateway": "manual"}', "shopify_store_credit", "Crédito em loja"),
        ("{}", None, None),
    ],
)
def test_payment_raw(spark, json, dominant, raw):
    assert money(spark, json, lambda p: S.payment_raw(p, F.lit(dominant).cast("string"))) == raw


@pytest.mark.parametrize(
    "rule,cases",
    [
        (S.money_locale, {"12d": 0, "1e3f": 0, "1e3": 100000, "\t7,5 ": 750, ".5": 50, "5.": 500, "+1": 100, "1,2,3": 0, "0x10": 0}),
        (S.clean, {"\tpaid\n": "paid", " x ": "x", '{"a": 1}': None, "[1, 2]": None, "[PIX]": "[PIX]", "{x}": "{x}", " \t ": None}),
        (S.paid_token, {"\tpaid": True, "pago\r\n": True, '{"status": "paid"}': False}),
        (
            S.failure_reason,
            {
                "request Timed Out": "timeout",
                "Invalid DATE": "invalid_date",
                "invalid value of occurredAt": "invalid_date",
                "socket hang up": "database_error",
                "Unique constraint": "constraint_error",
                "HTTP 429": "unknown_error",
                "": "unknown_error",
                None: "unknown_error",
            },
        ),
        (
            lambda c: S.shown_order_number(c, F.lit("x pedido # ab-1 y")),
            {"12": "#12", "#12": "#12", "##12": "##12", "": "#ab-1", None: "#ab-1"},
        ),
        (lambda c: S.shown_order_number(F.lit(None), c), {"12": "—", "Pedido 12": "—", "PEDIDO #7": "#7", None: "—"}),
        (lambda c: S.payment_label(F.lit(""), c), {"pix": "Pix", "cash": "Dinheiro", "nothing": "Não informado", None: "Não informado"}),
    ],
)
def test_rules_at_their_edges(spark, rule, cases):
    assert apply(spark, rule, list(cases)) == list(cases.values())


def test_distinct_names_keep_their_order(spark):
    rows = spark.createDataFrame(
        [(["Visa", "cartão", "CARTAO", " ", "store credit", "Crédito em loja", "visa"],), (["Store Credit", "a"],), ([],), (None,)],
        "names array<string>",
    )
    assert [r[0] for r in rows.select(S.distinct_names(F.col("names"))).collect()] == [
        "store credit | Visa | cartão | Crédito em loja",
        "Store Credit | a",
        None,
        None,
    ]
