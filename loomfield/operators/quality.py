"""Data quality: flags, declarative checks and the audit log.

A check is a table, a predicate that fails a row, and texts. Checks over the same table are one
aggregate over one scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import pass_rate
from loomfield.operators.rows import flag_exists
from loomfield.schemas import PAYMENT_TYPES, STATUSES

C = F.col


@dataclass(frozen=True)
class Check:
    name: str
    target: str
    kind: str
    fails: Column
    counts: Column | None = None  # which rows are checked at all
    notes: str = ""


def run_checks(df: DataFrame, checks: Iterable[Check], run_at: Column) -> DataFrame:
    """One audit row per check; an empty table passes with no rate. Null predicates don't fail a row."""
    checks = list(checks)
    aggs = []
    for k, c in enumerate(checks):
        of = c.counts if c.counts is not None else F.lit(True)
        aggs += [F.count_if(of).alias(f"t{k}"), F.count_if(of & F.coalesce(c.fails, F.lit(False))).alias(f"f{k}")]
    row = lambda k, c: F.struct(F.lit(c.name).alias("check_name"), F.lit(c.target).alias("target"), F.lit(c.kind).alias("check_type"), C(f"t{k}").alias("total"), C(f"f{k}").alias("failed"), F.lit(c.notes).alias("notes"))
    long = df.agg(*aggs).select(F.explode(F.array(*[row(k, c) for k, c in enumerate(checks)])).alias("x")).select("x.*")
    return long.select("check_name", "target", "check_type", F.when(C("failed") == 0, "PASS").otherwise("FAIL").alias("result"), "total", "failed", pass_rate(C("total"), C("failed")).alias("pass_rate"), run_at.cast("timestamp").alias("run_at"), "notes")


def reference_flags(stg: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Staging tables with a flag for each parent; copies are no parents."""
    parent = {n: df.filter(~C("_is_duplicate")) if "_is_duplicate" in df.columns else df for n, df in stg.items()}
    out = dict(stg)
    for child, key, of in (("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"), ("order_items", "seller_id", "sellers"), ("order_payments", "order_id", "orders"), ("order_reviews", "order_id", "orders")):
        out[child] = flag_exists(out[child], parent[of].select(key), {key: key}, f"_has_{of[:-1]}")
    return out


def _bad(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def invalid() -> dict[str, Column]:
    """What makes a row of a flagged staging table invalid; unknown values don't."""
    return {
        "customers": _bad(C("customer_id").isNull(), C("customer_unique_id").isNull()),
        "orders": _bad(C("purchase_ts").isNull(), ~C("order_status").isin(STATUSES), ~C("_has_customer")),
        "order_items": _bad(C("price_amt") <= 0, C("freight_amt") < 0, C("order_item_id") < 1, ~C("_has_order"), ~C("_has_product"), ~C("_has_seller")),
        "order_payments": _bad(C("payment_amt") <= 0, C("payment_sequential") < 1, ~C("payment_type").isin(PAYMENT_TYPES), ~C("_has_order")),
        "order_reviews": _bad(~C("review_score").between(1, 5), ~C("_has_order")),
        "products": _bad(C("weight_g") <= 0),
        "sellers": _bad(C("seller_id").isNull()),
    }


def flagged(stg: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Staging tables with reference flags and ``_is_valid``."""
    out = reference_flags(stg)
    return out | {n: out[n].withColumn("_is_valid", ~p) for n, p in invalid().items()}


def reconciliation(items: DataFrame, payments: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per order the item total, what was paid (missing: 0), and whether they differ by more than ``tolerance``; null for a total of 0."""
    i = items.groupBy("order_id").agg(F.sum("total_item_amt").alias("item_total"))
    p = payments.groupBy("order_id").agg(F.sum("payment_amt").alias("paid"))
    both = i.join(p, "order_id", "left").withColumn("paid", F.coalesce("paid", F.lit(0)))
    gap = F.try_divide(F.abs(C("item_total") - C("paid")).cast("double"), C("item_total").cast("double"))
    return both.withColumn("mismatch", gap > tolerance)


def all_checks(stg: dict[str, DataFrame], run_at: Column) -> DataFrame:
    """The audit log over flagged staging tables: duplicates, references, validity, rules."""
    once = ~C("_is_duplicate")
    refs = {"orders": ["customer"], "order_items": ["order", "product", "seller"], "order_payments": ["order"], "order_reviews": ["order"]}
    rules = {
        "order_items": [Check("ZERO_PRICE_ITEMS", "order_items", "RANGE", C("price_amt") == 0), Check("FREIGHT_EXCEEDS_PRICE", "order_items", "RANGE", C("freight_amt") > C("price_amt"), C("_is_valid"))],
        "order_payments": [Check("INSTALLMENTS_OUT_OF_RANGE", "order_payments", "RANGE", ~C("payment_installments").between(1, 24))],
        "orders": [
            Check("DELIVERED_NULL_TIMESTAMP", "orders", "NULL_CHECK", C("delivered_customer_at").isNull(), C("is_delivered")),
            Check("TIMESTAMP_INVERSION_APPROVED_BEFORE_PURCHASE", "orders", "RANGE", C("approved_at") < C("purchase_ts")),
            Check("TIMESTAMP_INVERSION_DELIVERED_BEFORE_CARRIER", "orders", "RANGE", C("delivered_customer_at") < C("delivered_carrier_at")),
        ],
    }
    out = None
    for name in invalid():
        checks = [Check(f"DEDUP_{name.upper()}", name, "DEDUP", C("_is_duplicate")), Check(f"VALID_{name.upper()}", name, "VALIDITY", ~C("_is_valid"), once)]
        checks += [Check(f"REF_{name.upper()}_TO_{r.upper()}", name, "REF_INTEGRITY", ~C(f"_has_{r}"), once) for r in refs.get(name, [])]
        one = run_checks(stg[name], [*checks, *rules.get(name, [])], run_at)
        out = one if out is None else out.unionByName(one)
    live = {n: df.filter(once) for n, df in stg.items() if "_is_duplicate" in df.columns}
    orders = live["orders"]
    paid = flag_exists(orders.filter(~C("is_canceled")), live["order_payments"].select("order_id"), {"order_id": "order_id"}, "_paid")
    # Totals of lines serve two checks in one join, since staging lines is most of the work.
    totals = reconciliation(live["order_items"], live["order_payments"]).withColumn("_full", F.lit(True))
    both = totals.join(orders.select("order_id", F.lit(True).alias("_order")), "order_id", "full")
    per_order = [
        Check("PAYMENT_ITEM_RECONCILIATION", "orders", "RANGE", C("mismatch"), C("mismatch").isNotNull()),
        Check("ORDERS_WITHOUT_ITEMS", "orders", "NULL_CHECK", C("_full").isNull(), C("_order").isNotNull()),
    ]
    more = [
        run_checks(both, per_order, run_at),
        run_checks(paid, [Check("ORDERS_WITHOUT_PAYMENT", "orders", "NULL_CHECK", ~C("_paid"))], run_at),
    ]
    for one in more:
        out = out.unionByName(one)
    return out


def dashboard(log: DataFrame) -> dict[str, DataFrame]:
    """The log in full, by type, and what failed."""
    one_if = lambda x: F.count_if(C("result") == x)
    by_type = log.groupBy("check_type").agg(F.count("*").alias("checks"), one_if("PASS").alias("passed"), one_if("FAIL").alias("failed"), F.round(F.avg("pass_rate"), 3).alias("mean_rate"))
    return {"full": log.orderBy(C("pass_rate").asc_nulls_last(), "check_name"), "by_type": by_type, "failed": log.filter("result = 'FAIL'")}
