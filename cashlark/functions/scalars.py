"""Rules on single values as column expressions; all stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .values import HUB, NO_GATEWAY, STORE_CREDIT_GATEWAY, STOREFRONT


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(V.WHITE))


def strip_accents(text: Column) -> Column:
    return F.translate(text, V.ACCENTED, V.PLAIN)


def folded(text: Column) -> Column:
    """Without accents, in lower case, trimmed."""
    return trimmed(F.lower(strip_accents(text)))


def scalar(text: Column) -> Column:
    """A text leaf of JSON; null where the payload holds an object or an array."""
    nested = F.when(text.startswith("{"), F.json_object_keys(text).isNotNull()).when(
        text.startswith("["),
        F.json_array_length(text).isNotNull(),
    )
    return F.when(F.coalesce(nested, F.lit(False)), None).otherwise(text)


def _bare(text: Column) -> Column:
    """Whether a text begins and ends with visible ASCII and is no object or array, so that :func:`stated` and :func:`clean` leave it as it is."""
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return first.between("!", "z") & (first != "[") & last.between("!", "~")


def stated(text: Column) -> Column:
    """Trimmed, objects and arrays null: for rules to which blank and null are the same."""
    return F.when(_bare(text), text).otherwise(trimmed(scalar(text)))


def clean(text: Column) -> Column:
    """Trimmed; blank becomes null, and so do objects and arrays."""
    return F.when(_bare(text), text).otherwise(F.nullif(trimmed(scalar(text)), F.lit("")))


def marketplace_token(text: Column) -> Column:
    token = F.regexp_replace(folded(text), r"[\s-]+", "_")
    return F.when(token.isin("", "todos", "all"), None).when(token == "mercadolivre", "mercado_livre").otherwise(token)


def title_words(text: Column) -> Column:
    """Words between blanks, dashes and underscores, each with one capital, joined by blanks."""
    words = F.filter(F.split(text, r"[_\s-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " ")


def marketplace_label(marketplace: Column, source: Column) -> Column:
    return F.when(source == STOREFRONT, "Shopify").when(clean(marketplace).isNotNull(), title_words(clean(marketplace)))


def origin_label(value: Column) -> Column:
    """Catalogue label of a marketplace name or key, else its words in title case."""
    token = marketplace_token(value)
    for old, new in V.MARKETPLACE_ALIASES.items():
        token = F.when(token == old, new).otherwise(token)
    known = reduce(lambda c, kv: c.when(token == kv[0], kv[1]), V.MARKETPLACE_LABELS.items(), F.when(F.lit(False), None))
    return F.coalesce(known, title_words(value))


def names_method(raw: Column, method: str, fold: Column | None = None) -> Column:
    tokens = V.PAYMENT_TOKENS.get(method, [])
    text = folded(raw) if fold is None else fold
    return F.coalesce(text.rlike("|".join(tokens)), F.lit(False)) if tokens else F.lit(False)


def classify_payment(raw: Column, fold: Column | None = None) -> Column:
    """The first method, in order of precedence, that a token in the text names.

    ``fold`` is :func:`folded` of the text where a row has it already.
    """
    chosen = F.when(F.coalesce(trimmed(raw) if fold is None else fold, F.lit("")) == "", "other")
    for method in V.PAYMENT_TOKENS:
        chosen = chosen.when(names_method(raw, method, fold), method)
    return chosen.otherwise("other")


def method_rank(raw: Column) -> Column:
    """Precedence of a gateway's method in ties: smaller goes first."""
    return F.array_position(F.array(*map(F.lit, V.PAYMENT_METHODS)), classify_payment(raw)).cast("int")


def payment_label(raw: Column, normalized: Column) -> Column:
    """The text as it stands, else the label of the method, else that none is known."""
    named = reduce(lambda c, kv: c.when(normalized == kv[0], kv[1]), V.PAYMENT_LABELS.items(), F.when(F.lit(False), None))
    return F.coalesce(F.nullif(raw, F.lit("")), named, F.lit(V.UNKNOWN_PAYMENT))


def finite(number: Column) -> Column:
    return F.when(F.abs(number) < float("inf"), number)  # NaN is above all numbers


def to_cents(amount: Column) -> Column:
    """Half a cent goes up, also below zero."""
    return F.floor(amount * 100 + 0.5).cast("long")


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
#: Amounts as most payloads state them, of which all rules make the same number: finite, without sign, comma or blank.
_AMOUNT = r"^[0-9]{1,12}(?:\.[0-9]{1,12})?\z"


def money_locale(text: Column) -> Column:
    """Cents of a number whose dots are thousands if it has a comma; 0 if it is none."""
    plain = trimmed(F.when(text.contains(","), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text))
    number = F.when(plain.rlike(f"^{_NUMBER}$"), finite(plain.try_cast("double")))
    return F.when(text.rlike(_AMOUNT), to_cents(text.try_cast("double"))).otherwise(F.coalesce(to_cents(number), F.lit(0).cast("long")))


def money_prefix(text: Column) -> Column:
    """The number that a text begins with, its first comma as a point; null if it begins with none."""
    pointed = F.when(text.contains(","), F.regexp_replace(text, r"^([^,]*),", "$1.")).otherwise(text)
    begins = finite(F.regexp_extract(pointed, rf"^\s*({_NUMBER})", 1).try_cast("double"))
    return F.when(text.rlike(_AMOUNT), text.try_cast("double")).otherwise(begins)


def first_money(*texts: Column) -> Column:
    return to_cents(F.coalesce(*map(money_prefix, texts)))


def sum_money(items: Column, amount) -> Column:
    """Cents of the sum of an array's amounts that are numbers; null if none is."""
    known = F.transform(items, lambda x: money_prefix(amount(x)))
    return to_cents(F.aggregate(known, F.lit(None).cast("double"), lambda a, b: F.coalesce(a + b, a, b)))


def zero(cents: Column) -> Column:
    return F.coalesce(cents, F.lit(0).cast("long"))


def paid_token(text: Column) -> Column:
    return F.coalesce(F.upper(stated(text)).rlike(r"^(?:PAID|PAGO|PAGA)\z|^PAID[\s_]"), F.lit(False))


def is_paid(source: Column, event_type: Column, p: Column) -> Column:
    """Whether an event says that its order is paid, by its source's fields."""
    store = paid_token(p["financial_status"]) | paid_token(p["display_financial_status"]) | paid_token(event_type)
    hub = paid_token(p["paymentStatus"]) | paid_token(p["status"]) | F.coalesce(
        F.exists(p["payments"], lambda x: paid_token(x["status"])),
        F.lit(False),
    )
    return F.coalesce(F.when(source == STOREFRONT, store).when(source == HUB, hub), F.lit(False))


def shop_amount(p: Column, field: str) -> Column:
    return p[field]["shop_money"]["amount"]


def discount_cents(p: Column) -> Column:
    direct = first_money(shop_amount(p, "current_total_discounts_set"), p["total_discounts"], p["current_total_discounts"])
    lines = sum_money(p["line_items"], lambda x: F.coalesce(x["total_discount_set"]["shop_money"]["amount"], x["total_discount"]))
    return zero(F.coalesce(direct, lines))


def shipping_cents(p: Column) -> Column:
    """Stated shipping, else that of the shipping lines, else what the totals leave within bounds."""
    direct = first_money(
        shop_amount(p, "total_shipping_price_set"),
        shop_amount(p, "current_total_shipping_price_set"),
        p["total_shipping_price"],
    )
    lines = [
        sum_money(p["shipping_lines"], lambda x: x["discounted_price_set"]["shop_money"]["amount"]),
        sum_money(p["shipping_lines"], lambda x: x["discounted_price"]),
        sum_money(p["shipping_lines"], lambda x: x["price"]),
    ]
    total, subtotal = zero(first_money(p["total_price"])), first_money(p["subtotal_price"], p["current_subtotal_price"])
    left = total - subtotal + discount_cents(p) + zero(first_money(p["total_tax"])) + zero(
        first_money(shop_amount(p, "current_total_additional_fees_set"))
    )
    derived = F.when((total > 0) & left.between(*V.SHIPPING_BOUNDS), F.greatest(left, F.lit(0).cast("long")))
    return zero(F.coalesce(direct, *lines, derived))


def hub_fee_cents(p: Column) -> Column:
    each = F.transform(p["payments"], lambda x: money_locale(x["marketplaceFee"]) + money_locale(x["gatewayFee"]))
    return zero(F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b))


def liquid_cents(amount: Column, *parts: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), reduce(lambda a, b: a - b, parts, amount))


def display_order_number(name: Column, number: Column, identifier: Column) -> Column:
    own, other = clean(name), clean(number)
    return F.coalesce(
        F.when(own.startswith("#"), own).otherwise(F.concat(F.lit("#"), own)),
        F.concat(F.lit("#"), F.regexp_replace(other, "^#", "")),
        F.concat(F.lit("#"), identifier),
    )


def shown_order_number(number: Column, description: Column) -> Column:
    """For exports: the number with one mark, else the one that the description marks, else a dash."""
    found = F.nullif(F.regexp_extract(description, r"(?i)Pedido\s*#\s*([\w-]+)", 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("#"), F.regexp_replace(F.nullif(number, F.lit("")), "^#", "")),
        F.concat(F.lit("#"), found),
        F.lit("—"),
    )


def source_bucket(marketplace: Column, external_source: Column, source: Column) -> Column:
    return F.coalesce(marketplace, external_source, source)


def order_status(processing_status: Column) -> Column:
    return F.when(processing_status == "failed", "rejected").otherwise("approved")


def search_text(*parts: Column) -> Column:
    return F.nullif(F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])), F.lit(""))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over all parts, null as empty, so that a change of any part shows."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def iso_instant(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_start(day: Column, zone: str) -> Column:
    """The instant at which a calendar day of the zone begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def delta_percent(current: Column, previous: Column) -> Column:
    return (current - previous) / F.abs(F.nullif(previous, F.lit(0))) * 100


def difference_percent(value: Column, reference: Column) -> Column:
    return F.when(reference != 0, (value - reference) / reference * 100).when(value == 0, 0.0).otherwise(100.0)


def failure_reason(message: Column) -> Column:
    """The first reason of which the pattern stands in an error message."""
    known = reduce(lambda c, kv: c.when(message.rlike(f"(?i){kv[1]}"), kv[0]), V.FAILURE_PATTERNS.items(), F.when(F.lit(False), None))
    return F.coalesce(known, F.lit(V.OTHER_FAILURE))


_STORE_CREDIT = f"(?i){'|'.join(V.STORE_CREDIT_NAMES)}"


def gateway_name(raw: Column) -> Column:
    return F.when(raw.rlike(_STORE_CREDIT), STORE_CREDIT_GATEWAY).otherwise(trimmed(raw))


def gateway_or_none(raw: Column) -> Column:
    return F.coalesce(clean(raw), F.lit(NO_GATEWAY))


def distinct_names(names: Column) -> Column:
    """Names in order without repeats that differ only in case or accents, the first that is store credit in front, joined by bars.

    Each name is folded once; one pass carries the keys seen, the store credit and the other names.
    """
    pieces = F.transform(
        names,
        lambda n: F.struct(trimmed(n).alias("name"), folded(n).alias("key"), n.rlike(_STORE_CREDIT).alias("credit")),
    )
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("keys"), F.lit(None).cast("string").alias("credit"), none.alias("rest"))

    def add(seen, piece):
        first = piece["credit"] & seen["credit"].isNull()
        more = F.struct(
            F.array_append(seen["keys"], piece["key"]).alias("keys"),
            F.when(first, piece["name"]).otherwise(seen["credit"]).alias("credit"),
            F.when(first, seen["rest"]).otherwise(F.array_append(seen["rest"], piece["name"])).alias("rest"),
        )
        return F.when((piece["name"] == "") | F.array_contains(seen["keys"], piece["key"]), seen).otherwise(more)

    return F.aggregate(pieces, start, add, lambda seen: F.nullif(F.concat_ws(" | ", seen["credit"], seen["rest"]), F.lit("")))


def stated_payment(p: Column) -> Column:
    """How the payload of a storefront order says that it was paid, tags aside."""
    empty = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce(p["payment_gateway_names"], empty), gateway_name), lambda n: n != "")
    joined = F.nullif(F.array_join(names, " | "), F.lit(""))
    first = F.get(p["transactions"], F.lit(0))
    gateways = F.filter(F.transform(p["transactions"], lambda t: clean(t["gateway"])), lambda g: g.isNotNull())
    by_leg = F.coalesce(
        clean(first["payment_details"]["credit_card"]["brand"]),
        clean(first["payment_details"]["wallet"]["type"]),
        F.get(gateways, F.lit(0)),
    )
    attribute = F.get(
        F.filter(p["note_attributes"], lambda a: F.coalesce(a["name"], F.lit("")).rlike(f"(?i){'|'.join(V.ATTRIBUTE_WORDS)}")),
        F.lit(0),
    )["value"]
    note = F.nullif(F.regexp_extract(p["note"], f"(?i)({'|'.join(V.NOTE_WORDS)})", 1), F.lit(""))
    return F.coalesce(joined, by_leg, clean(p["gateway"]), clean(attribute), note)


def payment_raw(p: Column, dominant: Column, stated: Column | None = None) -> Column:
    """How an order of the storefront was paid: by the resolved gateway, else by what its payload says.

    ``stated`` is :func:`stated_payment` where a row has it already.
    """
    raw = stated_payment(p) if stated is None else stated
    # One name without tags, as most orders have, stands alone.
    alone = ~F.coalesce(raw, F.lit("")).contains("|") & (F.coalesce(p["tags"], F.lit("")) == "")
    tags = F.filter(F.split(F.coalesce(p["tags"], F.lit("")), ","), lambda t: t.rlike(f"(?i){'|'.join(V.TAG_WORDS)}"))
    pieces = F.transform(F.flatten(F.transform(tags, lambda t: F.split(t, r"\|"))), gateway_name)
    own = F.transform(F.split(F.coalesce(raw, F.lit("")), r"\|"), gateway_name)
    name = F.when(alone, F.nullif(gateway_name(raw), F.lit(""))).otherwise(distinct_names(F.concat(own, pieces)))
    return F.when(dominant.isNotNull(), gateway_name(dominant)).otherwise(F.coalesce(name, raw))
