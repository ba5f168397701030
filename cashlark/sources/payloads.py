"""Typed views of landed JSON: order payloads, payment legs and tenders.

All leaves are text, as the same field comes as a number, a text or a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

_MONEY = "struct<shop_money:struct<amount:string>>"

#: Fields of both sources' payloads.
ORDER_PAYLOAD = ", ".join(
    [
        *(
            f"{c} string"
            for c in "id name order_number number financial_status display_financial_status total_price current_total_price subtotal_price current_subtotal_price total_line_items_price total_tax total_discounts current_total_discounts total_shipping_price currency processed_at created_at updated_at updatedAt gateway note tags".split()
        ),
        *(
            f"{c} {_MONEY}"
            for c in "total_shipping_price_set current_total_shipping_price_set current_total_discounts_set current_total_tax_set current_total_additional_fees_set".split()
        ),
        "payment_gateway_names array<string>",
        "note_attributes array<struct<name:string,value:string>>",
        "transactions array<struct<gateway:string,payment_details:struct<credit_card:struct<brand:string>,wallet:struct<type:string>>>>",
        f"shipping_lines array<struct<price:string,discounted_price:string,discounted_price_set:{_MONEY}>>",
        f"line_items array<struct<total_discount:string,total_discount_set:{_MONEY}>>",
        *(
            f"{c} string"
            for c in "paymentStatus status marketPlace marketPlaceNumber total freight discount paymentDate createdAt lastUpdate".split()
        ),
        "payments array<struct<status:string,paymentMethodNormalized:string,paymentDetailNormalized:string,method:string,marketplaceFee:string,gatewayFee:string>>",
    ]
)


#: Those that say whether an order is paid.
PAID_PAYLOAD = "financial_status string, display_financial_status string, paymentStatus string, status string, payments array<struct<status:string>>"


def order_payload(json: Column) -> Column:
    return F.from_json(json, ORDER_PAYLOAD, {"mode": "PERMISSIVE"})


def paid_payload(json: Column) -> Column:
    return F.from_json(json, PAID_PAYLOAD, {"mode": "PERMISSIVE"})


def payment_transactions(landed: DataFrame) -> DataFrame:
    """Payment legs from landed JSON rows ``order_id, gateway, kind, status, amount, processed_at`` (all text)."""
    amount = S.finite(F.replace("amount", F.lit(","), F.lit(".")).try_cast("double"))
    return landed.select(
        F.col("order_id").alias("external_order_id"),
        S.gateway_or_none(F.col("gateway")).alias("gateway_raw"),
        "kind",
        "status",
        S.zero(S.to_cents(amount)).alias("amount_cents"),
        F.try_to_timestamp("processed_at").alias("processed_at"),
    )


def tenders(landed: DataFrame) -> DataFrame:
    """Tenders from landed JSON rows ``order_id, amount, processed_at, test``; rows without an order go."""
    return landed.where(S.clean(F.col("order_id")).isNotNull()).select(
        F.col("order_id").alias("external_order_id"),
        F.try_to_timestamp("processed_at").alias("processed_at"),
        S.zero(S.to_cents(S.finite(F.col("amount").try_cast("double")))).alias("amount_cents"),
        F.coalesce(F.col("test").try_cast("boolean"), F.lit(False)).alias("test"),
    )


#: Ends a JSON text where a file holds many; it stands in none, as JSON escapes control characters.
RECORD = "\x1e"


def orders_extract(spark, path: str, separator: str | None = None) -> DataFrame:
    """Orders of landed storefront pages, ``{"orders": [...]}``, as payload structs.

    A file is one page, or holds many that ``separator`` ends; such files are split over tasks.
    """
    reader = spark.read.schema(f"orders array<struct<{_as_fields(ORDER_PAYLOAD)}>>")
    pages = (reader.option("lineSep", separator) if separator else reader.option("multiLine", True)).json(path)
    return pages.select(F.explode("orders").alias("p"))


def _as_fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]
