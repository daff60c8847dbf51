"""Queries that run the staging, quality and mart operators over retail-shaped views of the tables.

The views rename and derive columns, so that every row of the tables takes part; the SQL beside each
query is written on its own, from the meaning of the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield import schemas
from loomfield.operators import marts, quality, staging
from loomfield.operators.dates import calendar
from loomfield.plans.catalogue import query, read

C = F.col
TODAY = "2024-01-01"
#: The day on which the persons' latest places were learned.
MOVED = "1998-01-01"


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _text(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), C(c).cast("string"))


def _zip(c: str) -> Column:
    return F.lpad(C(c).cast("string"), 5, "0")


def raw_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The raw tables, as they would come from files."""
    customer, orders, items = (read(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    part, supplier = read(spark, sf, "part"), read(spark, sf, "supplier")
    o, k = C("o_orderdate"), C("o_orderkey")
    loaded = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("_loaded_at")
    hundred = lambda c: F.round(C(c) * 100).cast("long").cast("string")
    dec = lambda c, p=12: c.cast(f"decimal({p},2)")
    line = F.concat_ws("/", "l_partkey", "l_suppkey", *[hundred(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")])
    status = F.when(C("o_orderstatus") == "F", "delivered").when(C("o_orderstatus") == "O", "shipped").otherwise("canceled")
    kinds = {"1": "credit_card", "2": "boleto", "3": "voucher", "4": "debit_card", "5": "not_defined"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.substring("o_orderpriority", 1, 1))
    title = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 100)))
    return {
        "customers": customer.select(
            _text(" C", "c_custkey").alias("customer_id"), F.concat(F.lit("U"), F.expr("c_custkey div 2").cast("string")).alias("customer_unique_id"),
            _zip("c_nationkey").alias("zip_code_prefix"), F.lower("c_mktsegment").alias("city"), _text("n", "c_nationkey").alias("state"),
            loaded, C("c_custkey").cast("string").alias("_row_hash"),
        ),
        "geolocation": customer.select(
            _zip("c_nationkey").alias("zip_code_prefix"), (C("c_acctbal") / 100).alias("lat"), (C("c_custkey") / 1000).alias("lng"),
            F.lower("c_mktsegment").alias("city"), _text("n", "c_nationkey").alias("state"),
        ),
        "orders": orders.select(
            _text("O", "o_orderkey").alias("order_id"), _text("C", "o_custkey").alias("customer_id"), status.alias("order_status"), o.alias("purchase_ts"),
            (o + _days(C("o_custkey") % 3 - 1)).alias("approved_at"), (o + _days(F.lit(3))).alias("delivered_carrier_at"),
            F.when((C("o_orderstatus") == "F") & (k % 11 != 0), o + _days(k % 20)).alias("delivered_customer_at"),
            F.date_add(o.cast("date"), 10).alias("estimated_delivery_dt"), loaded, k.cast("string").alias("_row_hash"),
        ),
        "order_items": items.select(
            _text("O", "l_orderkey").alias("order_id"), C("l_linenumber").alias("order_item_id"), _text("P", "l_partkey").alias("product_id"),
            _text("S", "l_suppkey").alias("seller_id"), C("l_shipdate").alias("shipping_limit_at"), dec(C("l_extendedprice")).alias("price_amt"),
            dec(C("l_tax") * 100).alias("freight_amt"), C("l_shipdate").alias("_loaded_at"), line.alias("_row_hash"),
        ),
        "order_payments": orders.select(
            _text("O", "o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"), kind.alias("payment_type"),
            (k % 30).cast("int").alias("payment_installments"), dec(C("o_totalprice")).alias("payment_amt"), loaded, k.cast("string").alias("_row_hash"),
        ),
        "order_reviews": orders.select(
            _text("R", "o_orderkey").alias("review_id"), F.concat(F.lit("O"), (k - k % 2).cast("string")).alias("order_id"), (k % 5 + 1).cast("int").alias("review_score"),
            F.lit(None).cast("string").alias("review_title"), F.when(k % 3 == 0, " ").otherwise(C("o_orderpriority")).alias("review_message"),
            F.date_add(o.cast("date"), 12).alias("review_created_dt"), F.when(k % 7 != 0, o + _days(F.lit(14))).alias("review_answered_at"),
            loaded, F.lpad(k.cast("string"), 12, "0").alias("_row_hash"),
        ),
        "products": part.select(
            _text("P", "p_partkey").alias("product_id"), F.lower("p_type").alias("category_name_pt"), C("p_size").alias("photo_cnt"),
            dec((C("p_size") - 1) * 10, 10).alias("weight_g"), *[dec(C("p_size"), 8).alias(c) for c in ("length_cm", "height_cm", "width_cm")],
            loaded, C("p_partkey").cast("string").alias("_row_hash"),
        ),
        "sellers": supplier.select(
            _text("S", "s_suppkey").alias("seller_id"), _zip("s_nationkey").alias("zip_code_prefix"), F.lower("s_name").alias("city"),
            _text("n", "s_nationkey").alias("state"), loaded, C("s_suppkey").cast("string").alias("_row_hash"),
        ),
        "category_names": part.filter("p_type <> 'PROMO'").select(F.lower("p_type").alias("category_name_pt"), title("p_type").alias("category_name_en")).distinct(),
    }


_CAP = "upper({0}[1:1]) || lower({0}[2:])"
# Staged tables in SQL; rows that a later one of the same key replaces have dup.
_STAGED = f"""customers AS (SELECT 'c' || c_custkey AS customer_id, 'u' || (c_custkey // 2) AS customer_unique_id, lpad(c_nationkey::VARCHAR, 5, '0') AS zip_code_prefix,
    {_CAP.format('c_mktsegment')} AS city, 'N' || c_nationkey AS state FROM customer),
places AS (SELECT zip_code_prefix, city, state, count(*) AS n, sum(c_acctbal / 100) AS lat, sum(c_custkey / 1000) AS lng FROM customers JOIN customer ON customer_id = 'c' || c_custkey GROUP BY ALL),
geolocation AS (SELECT zip_code_prefix, arg_min(city, (-n, city, state)) AS city, arg_min(state, (-n, city, state)) AS state, sum(lat) / sum(n) AS lat, sum(lng) / sum(n) AS lng, sum(n)::BIGINT AS samples
    FROM places GROUP BY 1),
ord AS (SELECT 'o' || o_orderkey AS order_id, 'c' || o_custkey AS customer_id, CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' ELSE 'CANCELED' END AS order_status,
    o_orderdate AS purchase_ts, o_orderdate + to_days((o_custkey % 3 - 1)::INT) AS approved_at, o_orderdate + to_days(3) AS delivered_carrier_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN o_orderdate + to_days((o_orderkey % 20)::INT) END AS delivered_customer_at, o_orderdate::DATE + 10 AS estimated_delivery_dt,
    o_orderdate::DATE AS purchase_date, o_orderstatus = 'F' AS is_delivered, o_orderstatus NOT IN ('F', 'O') AS is_canceled, o_orderkey FROM orders),
staged_orders AS (SELECT *, CASE WHEN delivered_customer_at IS NOT NULL THEN delivered_customer_at::DATE > estimated_delivery_dt END AS is_late,
    date_diff('day', estimated_delivery_dt, delivered_customer_at::DATE)::INT AS delivery_delay_days FROM ord),
items AS (SELECT 'o' || l_orderkey AS order_id, l_linenumber AS order_item_id, 'p' || l_partkey AS product_id, 's' || l_suppkey AS seller_id, l_shipdate AS shipping_limit_at,
    l_extendedprice::DECIMAL(12,2) AS price_amt, (l_tax * 100)::DECIMAL(12,2) AS freight_amt, (l_extendedprice::DECIMAL(12,2) + (l_tax * 100)::DECIMAL(12,2))::DECIMAL(12,2) AS total_item_amt,
    l_shipdate AS loaded, concat_ws('/', l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT, round(l_quantity * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT) AS h FROM lineitem),
staged_items AS (SELECT *, row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY loaded DESC, h) > 1 AS dup FROM items),
payments AS (SELECT 'o' || o_orderkey AS order_id, 1 AS payment_sequential, CASE o_orderpriority[1:1] WHEN '1' THEN 'CREDIT_CARD' WHEN '2' THEN 'BOLETO' WHEN '3' THEN 'VOUCHER' WHEN '4' THEN 'DEBIT_CARD' ELSE 'NOT_DEFINED' END AS payment_type,
    (o_orderkey % 30)::INT AS payment_installments, o_totalprice::DECIMAL(12,2) AS payment_amt FROM orders),
reviews AS (SELECT 'r' || o_orderkey AS review_id, 'o' || (o_orderkey - o_orderkey % 2) AS order_id, (1 + o_orderkey % 5)::INT AS review_score, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS review_message,
    o_orderdate::DATE + 12 AS review_created_dt, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(14) END AS review_answered_at, lpad(o_orderkey::VARCHAR, 12, '0') AS h FROM orders),
staged_reviews AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_answered_at DESC NULLS LAST, h) > 1 AS dup FROM reviews),
products AS (SELECT 'p' || p_partkey AS product_id, lower(p_type) AS category_name_pt, CASE WHEN p_type <> 'PROMO' THEN {_CAP.format('p_type')} END AS category_name_en, p_size AS photo_cnt,
    ((p_size - 1) * 10)::DECIMAL(10,2) AS weight_g, p_size::DECIMAL(10,2) AS length_cm, length_cm AS height_cm, length_cm AS width_cm FROM part),
sellers AS (SELECT 's' || s_suppkey AS seller_id, lpad(s_nationkey::VARCHAR, 5, '0') AS zip_code_prefix, {_CAP.format('s_name')} AS city, 'N' || s_nationkey AS state FROM supplier)"""


_KINDS = "payment_type = 'CREDIT_CARD' AS is_credit_card, payment_type = 'BOLETO' AS is_boleto, payment_type = 'VOUCHER' AS is_voucher, payment_type = 'DEBIT_CARD' AS is_debit_card"


@query(f"WITH {_STAGED} SELECT * FROM customers")
def stg_customers(spark, sf):
    return staging.clean_customers(raw_tables(spark, sf)["customers"]).drop("_loaded_at", "_row_hash")


@query(f"WITH {_STAGED} SELECT zip_code_prefix, city, state, round(lat, 6) AS lat, round(lng, 6) AS lng, samples FROM geolocation")
def stg_geolocation(spark, sf):
    return staging.geo_centroid(raw_tables(spark, sf)["geolocation"]).withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


@query(f"""WITH {_STAGED} SELECT order_id, customer_id, order_status, purchase_ts, approved_at, delivered_carrier_at, delivered_customer_at, estimated_delivery_dt, purchase_date, is_delivered, is_canceled, is_late,
    delivery_delay_days FROM staged_orders""")
def stg_orders(spark, sf):
    return staging.clean_orders(raw_tables(spark, sf)["orders"]).drop("_loaded_at", "_row_hash")


@query(f"WITH {_STAGED} SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_at, price_amt, freight_amt, total_item_amt, loaded AS _loaded_at, h AS _row_hash FROM staged_items WHERE price_amt > 0 AND NOT dup")
def stg_order_items(spark, sf):
    return staging.clean_items(raw_tables(spark, sf)["order_items"])


@query(f"""WITH {_STAGED} SELECT *, {_KINDS} FROM payments WHERE payment_amt > 0""")
def stg_order_payments(spark, sf):
    return staging.clean_payments(raw_tables(spark, sf)["order_payments"]).drop("_loaded_at", "_row_hash")


@query(f"""WITH {_STAGED} SELECT review_id, order_id, review_score, NULL::VARCHAR AS review_title, review_message, review_created_dt, review_answered_at, review_score >= 4 AS is_positive, review_score = 3 AS is_neutral, review_score <= 2 AS is_negative,
    review_message IS NOT NULL AS has_comment, h AS _row_hash FROM staged_reviews WHERE NOT dup""")
def stg_order_reviews(spark, sf):
    return staging.clean_reviews(raw_tables(spark, sf)["order_reviews"]).drop("_loaded_at")


@query(f"WITH {_STAGED} SELECT * FROM products")
def stg_products(spark, sf):
    raw = raw_tables(spark, sf)
    return staging.clean_products(raw["products"], raw["category_names"]).drop("_loaded_at", "_row_hash")


@query(f"WITH {_STAGED} SELECT * FROM sellers")
def stg_sellers(spark, sf):
    return staging.clean_sellers(raw_tables(spark, sf)["sellers"]).drop("_loaded_at", "_row_hash")


def _check(name: str, target: str, kind: str, total: str, failed: str, source: str) -> str:
    return f"SELECT '{name}' AS check_name, '{target}' AS target, '{kind}' AS check_type, count(*) FILTER ({total}) AS total, count(*) FILTER (({total}) AND coalesce({failed}, FALSE)) AS failed FROM {source}"


_NO_ORDER = "order_id NOT IN (SELECT order_id FROM staged_orders)"
_NO_PRODUCT, _NO_SELLER = "product_id NOT IN (SELECT product_id FROM products)", "seller_id NOT IN (SELECT seller_id FROM sellers)"
_NO_CUSTOMER = "customer_id NOT IN (SELECT customer_id FROM customers)"
_BAD_ITEM = f"(price_amt <= 0 OR freight_amt < 0 OR order_item_id < 1 OR {_NO_ORDER} OR {_NO_PRODUCT} OR {_NO_SELLER})"
_TYPES = ", ".join(f"'{t}'" for t in schemas.PAYMENT_TYPES)
_PAID = "(SELECT order_id, item_total, coalesce(paid, 0) AS paid FROM (SELECT order_id, sum(total_item_amt) AS item_total FROM staged_items WHERE NOT dup GROUP BY 1) LEFT JOIN (SELECT order_id, sum(payment_amt) AS paid FROM payments GROUP BY 1) USING (order_id) WHERE item_total <> 0)"
_CHECKS = [
    *[_check(f"DEDUP_{t.upper()}", t, "DEDUP", "TRUE", "FALSE", s) for t, s in (("customers", "customers"), ("orders", "staged_orders"), ("order_payments", "payments"), ("products", "products"), ("sellers", "sellers"))],
    _check("DEDUP_ORDER_ITEMS", "order_items", "DEDUP", "TRUE", "dup", "staged_items"),
    _check("DEDUP_ORDER_REVIEWS", "order_reviews", "DEDUP", "TRUE", "dup", "staged_reviews"),
    _check("REF_ORDERS_TO_CUSTOMER", "orders", "REF_INTEGRITY", "TRUE", _NO_CUSTOMER, "staged_orders"),
    _check("REF_ORDER_ITEMS_TO_ORDER", "order_items", "REF_INTEGRITY", "NOT dup", _NO_ORDER, "staged_items"),
    _check("REF_ORDER_ITEMS_TO_PRODUCT", "order_items", "REF_INTEGRITY", "NOT dup", _NO_PRODUCT, "staged_items"),
    _check("REF_ORDER_ITEMS_TO_SELLER", "order_items", "REF_INTEGRITY", "NOT dup", _NO_SELLER, "staged_items"),
    _check("REF_ORDER_PAYMENTS_TO_ORDER", "order_payments", "REF_INTEGRITY", "TRUE", _NO_ORDER, "payments"),
    _check("REF_ORDER_REVIEWS_TO_ORDER", "order_reviews", "REF_INTEGRITY", "NOT dup", _NO_ORDER, "staged_reviews"),
    _check("VALID_CUSTOMERS", "customers", "VALIDITY", "TRUE", "customer_id IS NULL OR customer_unique_id IS NULL", "customers"),
    _check("VALID_ORDERS", "orders", "VALIDITY", "TRUE", f"purchase_ts IS NULL OR {_NO_CUSTOMER}", "staged_orders"),
    _check("VALID_ORDER_ITEMS", "order_items", "VALIDITY", "NOT dup", _BAD_ITEM, "staged_items"),
    _check("VALID_ORDER_PAYMENTS", "order_payments", "VALIDITY", "TRUE", f"payment_amt <= 0 OR payment_sequential < 1 OR payment_type NOT IN ({_TYPES}) OR {_NO_ORDER}", "payments"),
    _check("VALID_ORDER_REVIEWS", "order_reviews", "VALIDITY", "NOT dup", f"review_score NOT BETWEEN 1 AND 5 OR {_NO_ORDER}", "staged_reviews"),
    _check("VALID_PRODUCTS", "products", "VALIDITY", "TRUE", "weight_g <= 0", "products"),
    _check("VALID_SELLERS", "sellers", "VALIDITY", "TRUE", "seller_id IS NULL", "sellers"),
    _check("ZERO_PRICE_ITEMS", "order_items", "RANGE", "TRUE", "price_amt = 0", "staged_items"),
    _check("FREIGHT_EXCEEDS_PRICE", "order_items", "RANGE", f"NOT {_BAD_ITEM}", "freight_amt > price_amt", "staged_items"),
    _check("INSTALLMENTS_OUT_OF_RANGE", "order_payments", "RANGE", "TRUE", "payment_installments < 1 OR payment_installments > 24", "payments"),
    _check("DELIVERED_NULL_TIMESTAMP", "orders", "NULL_CHECK", "is_delivered", "delivered_customer_at IS NULL", "staged_orders"),
    _check("TIMESTAMP_INVERSION_APPROVED_BEFORE_PURCHASE", "orders", "RANGE", "TRUE", "approved_at < purchase_ts", "staged_orders"),
    _check("TIMESTAMP_INVERSION_DELIVERED_BEFORE_CARRIER", "orders", "RANGE", "TRUE", "delivered_customer_at < delivered_carrier_at", "staged_orders"),
    _check("PAYMENT_ITEM_RECONCILIATION", "orders", "RANGE", "TRUE", "abs(item_total - paid)::DOUBLE / item_total::DOUBLE > 0.1", _PAID),
    _check("ORDERS_WITHOUT_PAYMENT", "orders", "NULL_CHECK", "NOT is_canceled", "order_id NOT IN (SELECT order_id FROM payments)", "staged_orders"),
    _check("ORDERS_WITHOUT_ITEMS", "orders", "NULL_CHECK", "TRUE", "order_id NOT IN (SELECT order_id FROM staged_items WHERE NOT dup)", "staged_orders"),
]
_LOG = f"""SELECT check_name, target, check_type, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS result, total, failed, round((total - failed) * 100.0::DOUBLE / nullif(total, 0), 3) AS pass_rate
    FROM ({' UNION ALL '.join(_CHECKS)})"""


def _log(spark, sf):
    stg = quality.flagged(staging.stage(raw_tables(spark, sf), flagged=True))
    return quality.all_checks(stg, F.lit(TODAY)).drop("run_at", "notes").withColumn("pass_rate", C("pass_rate").cast("double"))


@query(f"WITH {_STAGED} {_LOG}")
def quality_log_full(spark, sf):
    return _log(spark, sf)


@query(f"WITH {_STAGED} SELECT * FROM ({_LOG}) WHERE result = 'FAIL'")
def quality_failed_only(spark, sf):
    return quality.dashboard(_log(spark, sf))["failed"]


_DIMS = f"""{_STAGED},
firsts AS (SELECT customers.*, first_at, last_at FROM customers LEFT JOIN (SELECT customer_id, min(purchase_ts) AS first_at, max(purchase_ts) AS last_at FROM staged_orders GROUP BY 1) USING (customer_id)),
people AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY first_at NULLS LAST, customer_id) AS rn FROM firsts) WHERE rn = 1),
dim_customers AS (SELECT row_number() OVER (ORDER BY customer_unique_id) AS customer_key, customer_unique_id, zip_code_prefix, city, state, coalesce(first_at::DATE, DATE '{TODAY}') AS start_date, NULL::DATE AS end_date, TRUE AS is_current FROM people),
dim_products AS (SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, category_name_pt, category_name_en, weight_g, DATE '{TODAY}' AS start_date, NULL::DATE AS end_date, TRUE AS is_current FROM products WHERE weight_g > 0 OR weight_g IS NULL),
dim_sellers AS (SELECT row_number() OVER (ORDER BY seller_id) AS seller_key, * FROM sellers),
dim_geography AS (SELECT row_number() OVER (ORDER BY zip_code_prefix) AS geography_key, zip_code_prefix, city, state, lat, lng FROM geolocation)"""
# Persons whose latest order came from another place get a second version.
_MOVES = f"""{_DIMS},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_unique_id ORDER BY last_at DESC NULLS LAST, customer_id) AS rn FROM firsts) WHERE rn = 1),
moved AS (SELECT l.* FROM latest l JOIN dim_customers d USING (customer_unique_id) WHERE l.zip_code_prefix <> d.zip_code_prefix OR l.city <> d.city OR l.state <> d.state),
versions AS (SELECT d.customer_key, d.customer_unique_id, d.zip_code_prefix, d.city, d.state, d.start_date, CASE WHEN m.customer_unique_id IS NOT NULL THEN DATE '{MOVED}' END AS end_date, m.customer_unique_id IS NULL AS is_current
    FROM dim_customers d LEFT JOIN moved m USING (customer_unique_id)
    UNION ALL SELECT (SELECT max(customer_key) FROM dim_customers) + row_number() OVER (ORDER BY customer_unique_id), customer_unique_id, zip_code_prefix, city, state, DATE '{MOVED}', NULL, TRUE FROM moved)"""
_PERSON = "JOIN staged_orders o USING (order_id) JOIN customers c USING (customer_id) JOIN versions v ON v.customer_unique_id = c.customer_unique_id AND v.start_date <= o.purchase_date AND (v.end_date IS NULL OR v.end_date > o.purchase_date)"
_FACT_ITEMS = f"""SELECT i.order_id, i.order_item_id, strftime(o.purchase_date, '%Y%m%d')::INT AS purchase_date_key, v.customer_key, p.product_key, s.seller_key, g.geography_key, o.order_status, o.is_delivered, o.is_canceled, o.is_late,
    o.delivery_delay_days, i.price_amt, i.freight_amt, i.total_item_amt, FALSE AS _is_late_arriving FROM (SELECT * FROM staged_items WHERE price_amt > 0 AND NOT dup) i {_PERSON}
    JOIN dim_products p ON p.product_id = i.product_id JOIN dim_sellers s ON s.seller_id = i.seller_id LEFT JOIN dim_geography g ON g.zip_code_prefix = c.zip_code_prefix"""


def _dims(spark, sf, moved: bool = False, only: tuple[str, ...] | None = None):
    stg = staging.stage(raw_tables(spark, sf))
    dims = marts.build_dims(stg, F.lit(TODAY).cast("date"), only)
    if moved:
        latest = marts.one_per_person(stg["customers"], stg["orders"], True)
        dims["customers"] = marts.evolve(dims["customers"], latest, "customer_key", "customer_unique_id", marts.CUSTOMER_TRACKED, F.lit(MOVED).cast("date"))
    return stg, dims


@query(f"WITH {_DIMS} SELECT * FROM dim_customers")
def mart_dim_customers(spark, sf):
    return schemas.declared(_dims(spark, sf, only=("customers",))[1]["customers"], "dim_customers")


@query(f"WITH {_MOVES} SELECT * FROM versions")
def mart_dim_customers_moved(spark, sf):
    return _dims(spark, sf, True, ("customers",))[1]["customers"]


@query(f"WITH {_DIMS} SELECT * FROM dim_products")
def mart_dim_products(spark, sf):
    return schemas.declared(_dims(spark, sf, only=("products",))[1]["products"], "dim_products")


@query(f"WITH {_DIMS} SELECT * FROM dim_sellers")
def mart_dim_sellers(spark, sf):
    return schemas.declared(_dims(spark, sf, only=("sellers",))[1]["sellers"], "dim_sellers")


@query(f"WITH {_DIMS} SELECT geography_key, zip_code_prefix, city, state, round(lat, 6) AS lat, round(lng, 6) AS lng FROM dim_geography")
def mart_dim_geography(spark, sf):
    return _dims(spark, sf, only=("geography",))[1]["geography"].withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


@query(f"WITH {_MOVES} {_FACT_ITEMS}")
def mart_fact_items(spark, sf):
    return marts.fact_items(*_dims(spark, sf, True)).drop("_loaded_at")


@query(f"""WITH {_MOVES} SELECT i.order_id, i.payment_sequential, strftime(o.purchase_date, '%Y%m%d')::INT AS purchase_date_key, v.customer_key, i.payment_type, i.payment_installments, i.payment_amt,
    {_KINDS}, FALSE AS _is_late_arriving FROM (SELECT * FROM payments WHERE payment_amt > 0) i {_PERSON}""")
def mart_fact_payments(spark, sf):
    return marts.fact_payments(*_dims(spark, sf, True, ("customers",))).drop("_loaded_at")


@query(f"""WITH {_MOVES} SELECT i.review_id, i.order_id, strftime(coalesce(i.review_answered_at::DATE, i.review_created_dt), '%Y%m%d')::INT AS answered_date_key, v.customer_key, i.review_score, i.review_score >= 4 AS is_positive,
    i.review_score = 3 AS is_neutral, i.review_score <= 2 AS is_negative, i.review_message IS NOT NULL AS has_comment FROM (SELECT * FROM staged_reviews WHERE NOT dup) i {_PERSON}""")
def mart_fact_reviews(spark, sf):
    return marts.fact_reviews(*_dims(spark, sf, True, ("customers",))).drop("_loaded_at")


@query(f"""WITH {_MOVES}, facts AS ({_FACT_ITEMS}), days AS (SELECT strftime(d, '%Y%m%d')::INT AS date_key, year(d)::INT AS year_num, month(d)::INT AS month_num, strftime(d, '%B') AS month_name
    FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d))
    SELECT year_num, month_num, month_name, v.state, count(DISTINCT order_id) AS orders, sum(total_item_amt)::DECIMAL(22,2) AS revenue, (((2 * sum((total_item_amt * 100)::BIGINT) + count(*)) // (2 * count(*)))::BIGINT * 0.01::DECIMAL(3,2))::DECIMAL(22,2) AS avg_order_item_value
    FROM facts JOIN days ON date_key = purchase_date_key JOIN versions v USING (customer_key) WHERE NOT is_canceled GROUP BY 1, 2, 3, 4""")
def revenue_by_month_and_state(spark, sf):
    stg, dims = _dims(spark, sf, True)
    return marts.revenue_by_month_and_state(marts.fact_items(stg, dims), calendar(spark, "1990-01-01", "2030-12-31"), dims["customers"])


@query("""SELECT a.year AS ordered_year, a.quarter AS ordered_quarter, b.year AS shipped_year, b.quarter AS shipped_quarter, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN (SELECT d::DATE AS d, year(d)::INT AS year, quarter(d)::INT AS quarter FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS d)) a ON a.d = o_orderdate::DATE
    JOIN (SELECT d::DATE AS d, year(d)::INT AS year, quarter(d)::INT AS quarter FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS d)) b ON b.d = l_shipdate::DATE GROUP BY 1, 2, 3, 4""")
def role_playing_dates(spark, sf):
    days = calendar(spark, "1990-01-01", "2030-12-31")
    role = lambda r: days.select(C("calendar_date").alias(f"{r}_day"), C("year_num").alias(f"{r}_year"), C("quarter_num").alias(f"{r}_quarter"))
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    dated = lines.select(C("o_orderdate").cast("date").alias("ordered_day"), C("l_shipdate").cast("date").alias("shipped_day"))
    both = dated.join(role("ordered"), "ordered_day").join(role("shipped"), "shipped_day")
    return both.groupBy("ordered_year", "ordered_quarter", "shipped_year", "shipped_quarter").agg(F.count("*").alias("n"))


@query("""SELECT grp, c_custkey FROM (SELECT lower(trim(c_mktsegment)) || '/' || c_nationkey AS grp, c_custkey, row_number() OVER (PARTITION BY lower(trim(c_mktsegment)) || '/' || c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
    WHERE rn = 1""")
def dedup_computed_key(spark, sf):
    from loomfield.operators.rows import keep_latest

    group = F.concat_ws("/", F.lower(F.trim("c_mktsegment")), "c_nationkey")
    return keep_latest(read(spark, sf, "customer").withColumn("grp", group), ["grp"], [C("c_acctbal").desc_nulls_last()], ["c_custkey"]).select("grp", "c_custkey")


@query("SELECT event_id, date_diff('second', TIMESTAMP '2000-01-01 00:00:00', date_trunc('second', ts))::BIGINT AS seconds FROM events")
def seconds_since(spark, sf):
    from loomfield.functions import seconds_between

    return read(spark, sf, "events").select("event_id", seconds_between(F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), C("ts")).alias("seconds"))


@query("SELECT dense_rank() OVER (ORDER BY l_orderkey, l_linenumber) AS line_key, l_orderkey, l_linenumber FROM lineitem GROUP BY 2, 3")
def surrogate_keys_at_size(spark, sf):
    from loomfield.operators.rows import allocate_keys

    keys = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return allocate_keys(keys, "line_key", ["l_orderkey", "l_linenumber"])
