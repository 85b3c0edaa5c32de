"""Prices from prose, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies by their signs, and the words around "free" that take it back or bind it to a condition.
CURRENCY = {"£": "GBP", "$": "USD", "€": "EUR"}
DENIED = ("not", "non", "no")
BOUND_AFTER = ("for", "to", "with", "on", "when", "if", "upon", "under")
BOUND_BEFORE = ("children", "child", "member", "members", "concession", "concessions", "student", "students")
LINKING = ("go", "are", "is")
#: A sign, then digits with commas between, and pence.
PRICE = "[£$€]\\s?[0-9,]+(?:\\.[0-9]{2})?"


def amounts(text: Column) -> Column:
    """array<struct<price, at, symbol>> of the prices of a text, by their places."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PRICE), 0), lambda x, i: F.struct(F.regexp_replace(x, "[^0-9.]", "").try_cast("double").alias("price"), i.alias("at"), F.substring(x, 1, 1).alias("symbol")))
    return F.filter(found, lambda p: p["price"].isNotNull())


def free_words(text: Column) -> Column:
    """How a text uses the word free: an array of denied, bound (free under a condition) or plain."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)

    def use(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        whose = F.when(before.isin(*LINKING), F.get(words, i - 2)).otherwise(before)
        under = whose.rlike("^under[0-9]+s?$") | (whose.rlike("^[0-9]+s?$") & (F.get(words, i - F.when(before.isin(*LINKING), 3).otherwise(2)) == "under"))
        bound = F.get(words, i + 1).isin(*BOUND_AFTER) | whose.isin(*BOUND_BEFORE) | under
        return F.when(w == "free", F.when(before.isin(*DENIED), "denied").when(bound, "bound").otherwise("plain"))

    return F.array_compact(F.transform(words, use))


def price_info(text: Column) -> Column:
    """struct<is_free, price_from, currency>: free only if nothing costs anything; the lowest price with its own currency; else unknown."""
    order = amounts(text)
    least = F.array_min(order)  # ties keep the first
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]), least["symbol"])
    make = lambda free, price, cur: F.struct(free.alias("is_free"), price.alias("price_from"), cur.alias("currency"))
    none = make(F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    uses = free_words(text)
    return (
        F.when(F.size(order) > 0, make(F.array_max(order)["price"] == 0, least["price"], name))
        .when((F.size(uses) > 0) & F.forall(uses, lambda u: u == "plain"), make(F.lit(True), F.lit(0.0), F.lit(None).cast("string")))
        .otherwise(none)
    )


def offers(items: Column) -> Column:
    """struct<price_text, is_free, price_from, currency, booking_url> of array<struct<price, lowPrice, priceCurrency, url>> (all texts).

    The currency is the first stated, whatever the lowest price's is."""
    amount = lambda t: F.trim(F.regexp_replace(t, "[£$€,]", "")).try_cast("double")
    priced = F.flatten(F.transform(items, lambda o: F.array_compact(F.array(amount(o["price"]), amount(o["lowPrice"])))))
    has = F.filter(items, lambda o: amount(o["price"]).isNotNull() | amount(o["lowPrice"]).isNotNull())
    currency = F.when(F.size(F.filter(has["priceCurrency"], lambda x: F.length(x) > 0)) > 0, F.upper(F.try_element_at(F.filter(has["priceCurrency"], lambda x: F.length(x) > 0), F.lit(1))))
    url = F.try_element_at(F.filter(items["url"], lambda x: F.length(x) > 0), F.lit(1))
    low, high = F.array_min(priced), F.array_max(priced)
    sign = F.element_at(F.create_map(*[F.lit(x) for k, v in CURRENCY.items() for x in (v, k)]), currency)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", low), "0+$", ""), r"\.$", "")
    text = F.when(high == 0, "Free").when(sign.isNotNull(), F.concat(F.lit("from "), sign, plain)).when(currency.isNotNull(), F.concat(F.lit("from "), plain, F.lit(" "), currency)).when(low.isNotNull(), F.concat(F.lit("from "), plain))
    return F.struct(text.alias("price_text"), (high == 0).alias("is_free"), low.alias("price_from"), currency.alias("currency"), url.alias("booking_url"))
