"""Cleaning of raw tables: one row per business key, standard texts, derived flags.

``flagged=True`` keeps every row and marks copies in ``_is_duplicate``; otherwise the latest row
stays and unusable ones go. Ties of the load time are broken by the row hash.

Lines and payments are dealt by order, not by their whole key, so that what joins or groups them by
order next needs no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import blank_to_null, days_between, initcap_words, money
from loomfield.operators.rows import flag_duplicates, keep_latest

C = F.col


def _low(c: str) -> Column:
    return F.lower(F.trim(c))


def _one(df: DataFrame, keys: list[str], flagged: bool, usable: Column, order: list[Column] | None = None) -> DataFrame:
    order = order or [C("_loaded_at").desc_nulls_last()]
    if flagged:
        return flag_duplicates(df, keys, order, ["_row_hash"])
    return keep_latest(df.filter(usable), keys, order, ["_row_hash"])


def clean_customers(raw: DataFrame, flagged: bool = False) -> DataFrame:
    df = raw.select(_low("customer_id").alias("customer_id"), _low("customer_unique_id").alias("customer_unique_id"), F.trim("zip_code_prefix").alias("zip_code_prefix"), initcap_words(F.trim("city")).alias("city"), F.upper(F.trim("state")).alias("state"), "_loaded_at", "_row_hash")
    return _one(df, ["customer_id"], flagged, C("customer_id").isNotNull() & C("customer_unique_id").isNotNull())


def geo_parts(raw: DataFrame) -> DataFrame:
    """Samples of each zip prefix and city, with the sums and counts of their places; parts of parts are added by ``geo_added``."""
    rows = raw.filter(C("zip_code_prefix").isNotNull()).select(F.trim("zip_code_prefix").alias("zip_code_prefix"), initcap_words(F.trim("city")).alias("city"), F.upper(F.trim("state")).alias("state"), "lat", "lng")
    return rows.groupBy("zip_code_prefix", "city", "state").agg(F.count("*").alias("n"), *[f(x).alias(f"{x}_{k}") for x in ("lat", "lng") for f, k in ((F.sum, "s"), (F.count, "k"))])


def geo_added(parts: DataFrame) -> DataFrame:
    """Parts with one row for each zip prefix and city again."""
    sums = [F.sum(c).alias(c) for c in parts.columns if c not in ("zip_code_prefix", "city", "state")]
    return parts.groupBy("zip_code_prefix", "city", "state").agg(*sums)


def geo_centers(parts: DataFrame) -> DataFrame:
    """Mean place and most frequent city of each zip prefix; ties go to the city first in order."""
    best = F.min_by(F.struct("city", "state"), F.struct(-C("n"), C("city"), C("state")))
    mean = lambda x: F.try_divide(F.sum(f"{x}_s"), F.sum(f"{x}_k")).alias(x)
    return parts.groupBy("zip_code_prefix").agg(best.alias("b"), mean("lat"), mean("lng"), F.sum("n").alias("samples")).select("zip_code_prefix", "b.city", "b.state", "lat", "lng", "samples")


def geo_centroid(raw: DataFrame) -> DataFrame:
    """The centers of all samples, in one pass over them."""
    return geo_centers(geo_parts(raw))


def clean_orders(raw: DataFrame, flagged: bool = False) -> DataFrame:
    status = F.upper(F.trim("order_status"))
    late = F.when(C("delivered_customer_at").isNull() | C("estimated_delivery_dt").isNull(), None).otherwise(C("delivered_customer_at").cast("date") > C("estimated_delivery_dt"))
    df = raw.select(
        _low("order_id").alias("order_id"), _low("customer_id").alias("customer_id"), status.alias("order_status"), "purchase_ts", "approved_at", "delivered_carrier_at", "delivered_customer_at", "estimated_delivery_dt",
        C("purchase_ts").cast("date").alias("purchase_date"), (status == "DELIVERED").alias("is_delivered"), (status == "CANCELED").alias("is_canceled"), late.alias("is_late"),
        days_between(C("estimated_delivery_dt"), C("delivered_customer_at")).alias("delivery_delay_days"), "_loaded_at", "_row_hash",
    )
    return _one(df, ["order_id"], flagged, C("order_id").isNotNull() & C("purchase_ts").isNotNull())


def clean_items(raw: DataFrame, flagged: bool = False) -> DataFrame:
    zero = F.lit(0).cast("decimal(12,2)")
    price, freight = F.coalesce(money(C("price_amt")), zero), F.coalesce(money(C("freight_amt")), zero)
    df = raw.select(_low("order_id").alias("order_id"), "order_item_id", _low("product_id").alias("product_id"), _low("seller_id").alias("seller_id"), "shipping_limit_at", price.alias("price_amt"), freight.alias("freight_amt"), (price + freight).cast("decimal(12,2)").alias("total_item_amt"), "_loaded_at", "_row_hash")
    return _one(df.repartition("order_id"), ["order_id", "order_item_id"], flagged, C("order_id").isNotNull() & (C("price_amt") > 0))


def clean_payments(raw: DataFrame, flagged: bool = False) -> DataFrame:
    kind = F.upper(F.trim("payment_type"))
    df = raw.select(
        _low("order_id").alias("order_id"), F.coalesce("payment_sequential", F.lit(1)).alias("payment_sequential"), kind.alias("payment_type"), F.coalesce("payment_installments", F.lit(1)).alias("payment_installments"), money(C("payment_amt")).alias("payment_amt"),
        *[(kind == k).alias(f"is_{k.lower()}") for k in ("CREDIT_CARD", "BOLETO", "VOUCHER", "DEBIT_CARD")], "_loaded_at", "_row_hash",
    )
    return _one(df.repartition("order_id"), ["order_id", "payment_sequential"], flagged, C("order_id").isNotNull() & (C("payment_amt") > 0))


def clean_reviews(raw: DataFrame, flagged: bool = False) -> DataFrame:
    """The latest answered review of each order; unanswered ones come last."""
    df = raw.select(
        _low("review_id").alias("review_id"), _low("order_id").alias("order_id"), "review_score", blank_to_null(C("review_title")).alias("review_title"), blank_to_null(C("review_message")).alias("review_message"), "review_created_dt", "review_answered_at",
        (C("review_score") >= 4).alias("is_positive"), (C("review_score") == 3).alias("is_neutral"), (C("review_score") <= 2).alias("is_negative"), blank_to_null(C("review_message")).isNotNull().alias("has_comment"), "_loaded_at", "_row_hash",
    ).filter(C("review_score").between(1, 5))
    return _one(df, ["order_id"], flagged, C("order_id").isNotNull(), [C("review_answered_at").desc_nulls_last(), C("_loaded_at").desc_nulls_last()])


def category_names(categories: DataFrame) -> DataFrame:
    """One English name for each category ``_k``: of several the latest loaded, and of these the first in order."""
    order = [C("_loaded_at").desc_nulls_last()] if "_loaded_at" in categories.columns else []
    named = categories.select("*", _low("category_name_pt").alias("_k"), F.trim("category_name_en").alias("_name"))
    return keep_latest(named, ["_k"], order, ["_name"]).select("_k", C("_name").alias("category_name_en"))


def clean_products(raw: DataFrame, categories: DataFrame, flagged: bool = False) -> DataFrame:
    names = category_names(categories)
    df = raw.join(names, _low("category_name_pt") == C("_k"), "left").select(
        _low("product_id").alias("product_id"), _low("category_name_pt").alias("category_name_pt"), "category_name_en", "photo_cnt", *[money(C(c), 10).alias(c) for c in ("weight_g", "length_cm", "height_cm", "width_cm")], "_loaded_at", "_row_hash"
    )
    return _one(df, ["product_id"], flagged, C("product_id").isNotNull())


def clean_sellers(raw: DataFrame, flagged: bool = False) -> DataFrame:
    df = raw.select(_low("seller_id").alias("seller_id"), F.trim("zip_code_prefix").alias("zip_code_prefix"), initcap_words(F.trim("city")).alias("city"), F.upper(F.trim("state")).alias("state"), "_loaded_at", "_row_hash")
    return _one(df, ["seller_id"], flagged, C("seller_id").isNotNull())


def stage(raw: dict[str, DataFrame], flagged: bool = False) -> dict[str, DataFrame]:
    """All staging tables from all raw tables."""
    return {
        "customers": clean_customers(raw["customers"], flagged), "geolocation": geo_centroid(raw["geolocation"]), "orders": clean_orders(raw["orders"], flagged), "order_items": clean_items(raw["order_items"], flagged),
        "order_payments": clean_payments(raw["order_payments"], flagged), "order_reviews": clean_reviews(raw["order_reviews"], flagged), "products": clean_products(raw["products"], raw["category_names"], flagged), "sellers": clean_sellers(raw["sellers"], flagged),
    }


#: How the latest row of a key is found when staged rows meet new ones: keys and order, as in the functions above.
LATEST = {
    "customers": ["customer_id"], "orders": ["order_id"], "order_items": ["order_id", "order_item_id"], "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["order_id"], "products": ["product_id"], "sellers": ["seller_id"],
}


def latest(name: str, rows: DataFrame) -> DataFrame:
    """Of staged rows of a table, old and new, those that stay: the latest of latest rows is the latest of all."""
    answered = [C("review_answered_at").desc_nulls_last()] if name == "order_reviews" else []
    return keep_latest(rows, LATEST[name], [*answered, C("_loaded_at").desc_nulls_last()], ["_row_hash"])
