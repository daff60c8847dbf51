"""Dimensions and facts of the star schema.

Surrogate keys are allocated once and kept by upserts. Versions of a dimension are half-open
intervals; a fact takes the version that holds on its day.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import date_key
from loomfield.operators.rows import allocate_keys, as_of_join, keep_latest, scd2_apply, upsert

C = F.col
CUSTOMER_TRACKED = ["zip_code_prefix", "city", "state"]
PRODUCT_TRACKED = ["category_name_pt", "category_name_en", "weight_g"]
SELLER_COLUMNS = ["zip_code_prefix", "city", "state"]


def one_per_person(customers: DataFrame, orders: DataFrame, latest: bool) -> DataFrame:
    """A person's row of the first (or latest) order; customers without an order come last."""
    first = orders.groupBy("customer_id").agg((F.max if latest else F.min)("purchase_ts").alias("_at"))
    order = C("_at").desc_nulls_last() if latest else C("_at").asc_nulls_last()
    return keep_latest(customers.join(first, "customer_id", "left"), ["customer_unique_id"], [order], ["customer_id"])


def _version(start: Column) -> list[Column]:
    return [start.alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current")]


def dim_customers(customers: DataFrame, orders: DataFrame, today: Column) -> DataFrame:
    people = one_per_person(customers, orders, False)
    rows = people.select("customer_unique_id", *CUSTOMER_TRACKED, *_version(F.coalesce(C("_at").cast("date"), today)))
    return allocate_keys(rows, "customer_key", ["customer_unique_id"])


def dim_products(products: DataFrame, today: Column) -> DataFrame:
    valid = products.filter(F.coalesce(C("weight_g") > 0, F.lit(True)))
    return allocate_keys(valid.select("product_id", *PRODUCT_TRACKED, *_version(today)), "product_key", ["product_id"])


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return allocate_keys(sellers.select("seller_id", *SELLER_COLUMNS), "seller_key", ["seller_id"])


def dim_geography(centroids: DataFrame) -> DataFrame:
    rows = centroids.select("zip_code_prefix", "city", "state", "lat", "lng")
    return allocate_keys(rows, "geography_key", ["zip_code_prefix"])


def evolve(dim: DataFrame, batch: DataFrame, surrogate: str, natural: str, tracked: list[str], today: Column) -> DataFrame:
    """A versioned dimension brought up to a batch of one row per natural key; old versions keep their surrogate keys."""
    old = dim.drop(surrogate).select(natural, *tracked, "start_date", "end_date", "is_current")
    moved = scd2_apply(old, batch.select(natural, *tracked), natural, tracked, today)
    keyed = moved.join(dim.select(surrogate, natural, "start_date"), [natural, "start_date"], "left")
    top = dim.agg(F.max(surrogate)).first()[0] or 0
    new = allocate_keys(keyed.filter(C(surrogate).isNull()).drop(surrogate), surrogate, [natural], top)
    return keyed.filter(C(surrogate).isNotNull()).select(new.columns).unionByName(new)


def upsert_sellers(dim: DataFrame, batch: DataFrame) -> DataFrame:
    """Type 1: attributes are overwritten, new sellers get the next keys."""
    top = dim.agg(F.max("seller_key")).first()[0] or 0
    known = batch.join(dim.select("seller_id", "seller_key"), "seller_id", "left").select("seller_key", "seller_id", *SELLER_COLUMNS)
    new = allocate_keys(known.filter(C("seller_key").isNull()).drop("seller_key"), "seller_key", ["seller_id"], top)
    return upsert(dim, known.filter(C("seller_key").isNotNull()).unionByName(new), ["seller_id"], update=SELLER_COLUMNS)


def _orders(stg: dict[str, DataFrame], dims: dict[str, DataFrame]) -> DataFrame:
    """Orders with the version of their person, found before their lines, of which there are more, join them."""
    orders = stg["orders"].select("order_id", "customer_id", "order_status", "purchase_date", "is_delivered", "is_canceled", "is_late", "delivery_delay_days")
    people = stg["customers"].select("customer_id", "customer_unique_id", C("zip_code_prefix").alias("_zip"))
    return _person(orders.join(people, "customer_id"), dims, C("purchase_date"))


def _person(rows: DataFrame, dims: dict[str, DataFrame], day: Column) -> DataFrame:
    """The version of the person that holds on the day. A person has few versions."""
    d = dims["customers"].select("customer_key", C("customer_unique_id").alias("_nk"), C("start_date").alias("_from"), C("end_date").alias("_to"))
    return as_of_join(rows, d, {"customer_unique_id": "_nk"}, day, start="_from", end="_to").drop("_nk", "_from", "_to")


def _loaded() -> Column:
    return F.current_timestamp().alias("_loaded_at")


def fact_items(stg: dict[str, DataFrame], dims: dict[str, DataFrame], late: bool = False) -> DataFrame:
    """A row for each order line whose parents are there. The lines may be a stream, the other tables not."""
    products = dims["products"].filter("is_current").select("product_id", "product_key")
    places = dims["geography"].select(C("zip_code_prefix").alias("_zip"), "geography_key")
    rows = stg["order_items"].join(_orders(stg, dims).join(places, "_zip", "left"), "order_id")
    rows = rows.join(products, "product_id").join(dims["sellers"].select("seller_id", "seller_key"), "seller_id")
    return rows.select(
        "order_id", "order_item_id", date_key(C("purchase_date")).alias("purchase_date_key"), "customer_key", "product_key", "seller_key", "geography_key",
        "order_status", "is_delivered", "is_canceled", "is_late", "delivery_delay_days", "price_amt", "freight_amt", "total_item_amt",
        F.lit(late).alias("_is_late_arriving"), _loaded(),
    )


def fact_payments(stg: dict[str, DataFrame], dims: dict[str, DataFrame], late: bool = False) -> DataFrame:
    rows = stg["order_payments"].join(_orders(stg, dims), "order_id")
    return rows.select(
        "order_id", "payment_sequential", date_key(C("purchase_date")).alias("purchase_date_key"), "customer_key", "payment_type", "payment_installments", "payment_amt",
        "is_credit_card", "is_boleto", "is_voucher", "is_debit_card", F.lit(late).alias("_is_late_arriving"), _loaded(),
    )


def fact_reviews(stg: dict[str, DataFrame], dims: dict[str, DataFrame]) -> DataFrame:
    day = F.coalesce(C("review_answered_at").cast("date"), C("review_created_dt"))
    rows = stg["order_reviews"].join(_orders(stg, dims), "order_id")
    return rows.select(
        "review_id", "order_id", date_key(day).alias("answered_date_key"), "customer_key", "review_score",
        "is_positive", "is_neutral", "is_negative", "has_comment", _loaded(),
    )


#: Keys, columns whose change rewrites a fact, columns that are rewritten, and the day by whose month the table is parted.
MERGES = {
    "items": (
        ["order_id", "order_item_id"],
        ["price_amt", "freight_amt", "order_status"],
        ["price_amt", "freight_amt", "total_item_amt", "order_status", "is_delivered", "is_canceled", "is_late", "delivery_delay_days", "_loaded_at"],
        "purchase_date_key",
    ),
    "payments": (
        ["order_id", "payment_sequential"],
        ["payment_amt", "payment_type"],
        ["payment_amt", "payment_type", "payment_installments", "is_credit_card", "is_boleto", "is_voucher", "is_debit_card", "_loaded_at"],
        "purchase_date_key",
    ),
    "reviews": (
        ["review_id"],
        ["review_score", "has_comment"],
        ["review_score", "is_positive", "is_neutral", "is_negative", "has_comment", "answered_date_key", "_loaded_at"],
        "answered_date_key",
    ),
}


def month_of(name: str) -> Column:
    """The partition of a fact's row, yyyymm."""
    return F.floor(C(MERGES[name][3]) / 100).cast("int")


def merge_fact(target: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """``target`` with ``source`` merged in; of several source rows of a key the first by all its columns counts."""
    keys, change, update, _ = MERGES[name]
    rest = [c for c in source.columns if c not in keys]
    return upsert(target, keep_latest(source, keys, [], rest), keys, change, update)


def unresolved(stg: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    """Order lines that no fact row has, since a parent or a version is missing."""
    return stg["order_items"].join(facts, ["order_id", "order_item_id"], "left_anti")


def build_dims(stg: dict[str, DataFrame], today: Column, only: Collection[str] | None = None) -> dict[str, DataFrame]:
    """The dimensions of an initial load, or those named in ``only``: each writes its keys when it is built."""
    makers = {
        "customers": lambda: dim_customers(stg["customers"], stg["orders"], today),
        "products": lambda: dim_products(stg["products"], today),
        "sellers": lambda: dim_sellers(stg["sellers"]),
        "geography": lambda: dim_geography(stg["geolocation"]),
    }
    return {n: make() for n, make in makers.items() if only is None or n in only}


def revenue_by_month_and_state(facts: DataFrame, dates: DataFrame, customers: DataFrame) -> DataFrame:
    """The flagship: orders, revenue and mean item value by month and state, canceled orders left out.

    Lines are summed to their order first, so that orders and not lines meet the customers.
    """
    days = dates.select(C("date_key").alias("purchase_date_key"), "year_num", "month_num", "month_name")
    sums = facts.filter(~C("is_canceled")).groupBy("order_id", "purchase_date_key", "customer_key").agg(F.sum("total_item_amt").alias("_sum"), F.count("total_item_amt").alias("_n"))
    rows = sums.join(days, "purchase_date_key").join(customers.select("customer_key", "state"), "customer_key")
    return rows.groupBy("year_num", "month_num", "month_name", "state").agg(
        F.countDistinct("order_id").alias("orders"),
        F.round(F.sum("_sum"), 2).cast("decimal(22,2)").alias("revenue"),
        F.round(F.try_divide(F.sum("_sum").cast("decimal(22,2)"), F.sum("_n").cast("decimal(15,0)")), 2).cast("decimal(22,2)").alias("avg_order_item_value"),
    )


def verify(dims: dict[str, DataFrame], facts: dict[str, DataFrame]) -> dict[str, int]:
    """Invariants as counts that must be zero, and late rows."""
    current = dims["customers"].groupBy("customer_unique_id").agg(F.count_if("is_current").alias("n"))
    orphans = facts["items"].join(dims["customers"], "customer_key", "left_anti")
    return {"not_one_current": current.filter("n <> 1").count(), "orphans": orphans.count(), "late": facts["items"].filter("_is_late_arriving").count()}
