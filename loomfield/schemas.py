"""Declared schemas of the raw layer, and of the audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names and types of each raw table, in file order.
RAW = {
    "customers": "customer_id string, customer_unique_id string, zip_code_prefix string, city string, state string",
    "geolocation": "zip_code_prefix string, lat double, lng double, city string, state string",
    "orders": "order_id string, customer_id string, order_status string, purchase_ts timestamp_ntz, approved_at timestamp_ntz, delivered_carrier_at timestamp_ntz, delivered_customer_at timestamp_ntz, estimated_delivery_dt date",
    "order_items": "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_at timestamp_ntz, price_amt decimal(12,2), freight_amt decimal(12,2)",
    "order_payments": "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_amt decimal(12,2)",
    "order_reviews": "review_id string, order_id string, review_score int, review_title string, review_message string, review_created_dt date, review_answered_at timestamp_ntz",
    "products": "product_id string, category_name_pt string, product_name_len int, product_desc_len int, photo_cnt int, weight_g decimal(10,2), length_cm decimal(8,2), height_cm decimal(8,2), width_cm decimal(8,2)",
    "sellers": "seller_id string, zip_code_prefix string, city string, state string",
    "category_names": "category_name_pt string, category_name_en string",
}
#: Longest texts that a column takes; longer ones reject the row.
LENGTHS = {"zip_code_prefix": 10, "state": 10, "order_status": 30, "payment_type": 30, "city": 100, "category_name_pt": 100, "category_name_en": 100, "review_title": 500, "review_message": 5000}
#: Provenance of every raw row.
PROVENANCE = "_loaded_at timestamp_ntz, _source_file string, _row_hash string"
AUDIT_CHECKS = "check_name string, target string, check_type string, result string, total bigint, failed bigint, pass_rate decimal(6,3), run_at timestamp, notes string"
AUDIT_RUNS = "run_id string, target string, started_at timestamp, ended_at timestamp, loaded bigint, rejected bigint, status string, notes string"

#: Declared schemas of the marts; ``NOT NULL`` is checked when a table is first written.
MARTS = {
    "dim_customers": "customer_key bigint NOT NULL, customer_unique_id string NOT NULL, zip_code_prefix string, city string, state string, "
    "start_date date NOT NULL, end_date date, is_current boolean NOT NULL",
    "dim_products": "product_key bigint NOT NULL, product_id string NOT NULL, category_name_pt string, category_name_en string, weight_g decimal(10,2), "
    "start_date date NOT NULL, end_date date, is_current boolean NOT NULL",
    "dim_sellers": "seller_key bigint NOT NULL, seller_id string NOT NULL, zip_code_prefix string, city string, state string",
    "dim_geography": "geography_key bigint NOT NULL, zip_code_prefix string NOT NULL, city string, state string, lat double, lng double",
    "fact_items": "order_id string NOT NULL, order_item_id int NOT NULL, purchase_date_key int NOT NULL, customer_key bigint NOT NULL, "
    "product_key bigint NOT NULL, seller_key bigint NOT NULL, geography_key bigint, order_status string, is_delivered boolean, is_canceled boolean, "
    "is_late boolean, delivery_delay_days int, price_amt decimal(12,2) NOT NULL, freight_amt decimal(12,2), total_item_amt decimal(12,2), "
    "_is_late_arriving boolean NOT NULL, _loaded_at timestamp NOT NULL",
    "fact_payments": "order_id string NOT NULL, payment_sequential int NOT NULL, purchase_date_key int NOT NULL, customer_key bigint NOT NULL, "
    "payment_type string, payment_installments int, payment_amt decimal(12,2) NOT NULL, is_credit_card boolean, is_boleto boolean, is_voucher boolean, "
    "is_debit_card boolean, _is_late_arriving boolean NOT NULL, _loaded_at timestamp NOT NULL",
    "fact_reviews": "review_id string, order_id string NOT NULL, answered_date_key int, customer_key bigint NOT NULL, review_score int, "
    "is_positive boolean, is_neutral boolean, is_negative boolean, has_comment boolean, _loaded_at timestamp NOT NULL",
}

#: Business keys, which are checked and never assumed to be unique.
KEYS = {
    "customers": ["customer_id"], "geolocation": ["zip_code_prefix"], "orders": ["order_id"], "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"], "order_reviews": ["order_id"], "products": ["product_id"], "sellers": ["seller_id"], "category_names": ["category_name_pt"],
}

# The domains of statuses and payment types.
STATUSES = ["DELIVERED", "SHIPPED", "CANCELED", "INVOICED", "PROCESSING", "UNAVAILABLE", "APPROVED", "CREATED"]
PAYMENT_TYPES = ["CREDIT_CARD", "BOLETO", "VOUCHER", "DEBIT_CARD", "NOT_DEFINED"]


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def raw(table: str) -> T.StructType:
    return struct(f"{RAW[table]}, {PROVENANCE}")


def declared(df: DataFrame, table: str) -> DataFrame:
    """The columns of a mart in their declared order and types; a null where none may be ends the write."""
    out = []
    for f in struct(MARTS[table]).fields:
        c = F.col(f.name).cast(f.dataType)
        wrong = F.raise_error(F.lit(f"{table}.{f.name} is null")).cast(f.dataType)
        out.append((c if f.nullable else F.when(c.isNull(), wrong).otherwise(c)).alias(f.name))
    return df.select(*out)
