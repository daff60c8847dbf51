"""Every registered query of the warehouse engine with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions import blank_to_null, date_key, days_between, initcap_words, pass_rate, row_hash
from loomfield.operators import distinct
from loomfield.operators import rows as R
from loomfield.operators.dates import calendar

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _register() -> None:
    """Import the modules whose queries use this one's registry."""
    from loomfield.plans import retail  # noqa: F401


def queries() -> dict[str, Query]:
    _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


C = F.col


def dec(name: str):
    return C(name).cast("decimal(12,2)")


def share(part, whole, places: int = 2):
    return F.round(part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)), places)


AS_OF = "DATE '2002-01-01'"

# Scans, projections and filters


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_project_filter(spark, sf):
    return read(spark, sf, "lineitem").filter((C("l_quantity") > 45) & (C("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000
    AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_orderdate IS NOT NULL AND NOT (o_custkey < 10)""")
def predicates_in_between_null(spark, sf):
    ok = C("o_totalprice").between(1000, 150000) & C("o_orderstatus").isin("F", "O") & ~C("o_orderpriority").isin("5-LOW") & C("o_orderdate").isNotNull() & ~(C("o_custkey") < 10)
    return read(spark, sf, "orders").filter(ok).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '_%E%'")
def like_filter(spark, sf):
    return read(spark, sf, "part").filter(C("p_name").like("%a%") & C("p_type").like("_%E%")).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, (o_orderstatus = 'F') AS is_delivered, (o_orderstatus = 'P') AS is_canceled,
    CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' ELSE 'small' END AS size FROM orders""")
def case_flags(spark, sf):
    size = F.when(C("o_totalprice") >= 200000, "large").when(C("o_totalprice") >= 50000, "medium").otherwise("small")
    return read(spark, sf, "orders").select("o_orderkey", (C("o_orderstatus") == "F").alias("is_delivered"), (C("o_orderstatus") == "P").alias("is_canceled"), size.alias("size"))


@query("""SELECT o_orderkey, upper(trim(o_orderpriority)) AS payment_type, o_orderpriority LIKE '1%' AS is_card, o_orderpriority LIKE '2%' AS is_slip,
    o_orderpriority LIKE '3%' AS is_voucher, o_orderpriority LIKE '4%' AS is_debit FROM orders""")
def payment_type_flags(spark, sf):
    kinds = zip(("is_card", "is_slip", "is_voucher", "is_debit"), "1234", strict=True)
    return read(spark, sf, "orders").select("o_orderkey", F.upper(F.trim("o_orderpriority")).alias("payment_type"), *[C("o_orderpriority").like(f"{d}%").alias(n) for n, d in kinds])


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1 LIMIT 20")
def distinct_values_limit(spark, sf):
    return read(spark, sf, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(20)


@query("SELECT 'DEDUP' AS check_type, TRUE AS active, NULL::DATE AS end_date, r_regionkey FROM region")
def constant_columns(spark, sf):
    return read(spark, sf, "region").select(F.lit("DEDUP").alias("check_type"), F.lit(True).alias("active"), F.lit(None).cast("date").alias("end_date"), "r_regionkey")


@query("SELECT c_custkey, TRY_CAST(split_part(c_name, '#', 2) AS INT) AS number, TRY_CAST(c_mktsegment AS INT) AS broken FROM customer")
def try_cast_columns(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).try_cast("int").alias("number"), C("c_mktsegment").try_cast("int").alias("broken"))


# Joins


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'O' WHERE l_quantity > 40")
def inner_join_filtered(spark, sf):
    orders = read(spark, sf, "orders").filter(C("o_orderstatus") == "O").select("o_orderkey", "o_orderstatus", "o_custkey")
    return read(spark, sf, "lineitem").filter("l_quantity > 40").join(orders, C("l_orderkey") == C("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "o_custkey")


@query("""SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') b
    ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2""")
def inner_join_multi_key(spark, sf):
    items = read(spark, sf, "lineitem")
    keys = items.filter(C("l_returnflag") == "A").select("l_orderkey", "l_linenumber").distinct()
    return items.join(keys, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, coalesce(n_name, 'unknown') AS nation FROM part LEFT JOIN nation ON lower(trim(n_name)) = lower(trim(split_part(p_name, ' ', 1)))""")
def left_join_computed_key(spark, sf):
    names = read(spark, sf, "nation").select(F.lower(F.trim("n_name")).alias("k"), "n_name")
    parts = read(spark, sf, "part").withColumn("k", F.lower(F.trim(F.split_part("p_name", F.lit(" "), F.lit(1)))))
    return parts.join(names, "k", "left").select("p_partkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("""SELECT o_orderkey, count(l_orderkey) AS returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1""")
def left_join_filter_in_on(spark, sf):
    back = read(spark, sf, "lineitem").filter(C("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return read(spark, sf, "orders").join(back, C("o_orderkey") == C("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("returned"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_items FROM orders")
def semi_exists_flag(spark, sf):
    return R.flag_exists(read(spark, sf, "orders").select("o_orderkey"), read(spark, sf, "lineitem"), {"o_orderkey": "l_orderkey"}, "has_items")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate AND l_linestatus <> o_orderstatus)")
def semi_exists_theta(spark, sf):
    orders, items = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    return orders.join(items, (C("l_orderkey") == C("o_orderkey")) & (C("l_shipdate") < C("o_orderdate")) & (C("l_linestatus") != C("o_orderstatus")), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def anti_left_null(spark, sf):
    return read(spark, sf, "orders").join(read(spark, sf, "lineitem"), C("l_orderkey") == C("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_not_exists(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").filter(C("o_orderstatus") == "P"), C("o_custkey") == C("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT i.order_key, i.item_total, p.paid FROM (SELECT l_orderkey AS order_key, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS item_total FROM lineitem GROUP BY 1) i
    JOIN (SELECT o_orderkey AS order_key, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS paid FROM orders GROUP BY 1) p USING (order_key)""")
def aggregate_to_aggregate_join(spark, sf):
    items = read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("order_key")).agg(F.sum(dec("l_extendedprice")).cast("decimal(22,2)").alias("item_total"))
    paid = read(spark, sf, "orders").groupBy(C("o_orderkey").alias("order_key")).agg(F.sum(dec("o_totalprice")).cast("decimal(22,2)").alias("paid"))
    return items.join(paid, "order_key")


_VERSIONS = """SELECT o_custkey AS k, o_orderstatus AS status, o_orderkey AS version, o_orderdate::DATE AS start_date,
    lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_date FROM orders"""


def versions(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select(C("o_custkey").alias("k"), C("o_orderstatus").alias("status"), C("o_orderkey").alias("version"), C("o_orderdate").cast("date").alias("start_date"), F.lead(C("o_orderdate").cast("date")).over(w).alias("end_date"))


@query(f"""SELECT event_id, version, status FROM events JOIN ({_VERSIONS}) v ON k = user_id AND start_date <= (ts - INTERVAL 8 YEAR)::DATE AND (end_date IS NULL OR end_date > (ts - INTERVAL 8 YEAR)::DATE)""")
def asof_scd2_lookup(spark, sf):
    facts = read(spark, sf, "events").select("event_id", "user_id", F.add_months(C("ts").cast("date"), -96).alias("day"))
    return R.as_of_join(facts, versions(spark, sf), {"user_id": "k"}, C("day")).select("event_id", "version", "status")


@query("""SELECT l_orderkey, l_linenumber, version, total FROM lineitem JOIN (
    SELECT *, lead(start_date) OVER (PARTITION BY k ORDER BY start_date) AS end_date FROM (
        SELECT o_orderstatus AS k, o_orderdate::DATE AS start_date, max(o_orderkey) AS version, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS total FROM orders GROUP BY 1, 2)) v
    ON k = l_linestatus AND start_date <= l_shipdate::DATE AND (end_date IS NULL OR end_date > l_shipdate::DATE)""")
def asof_hot_keys(spark, sf):
    # Two keys have all lines and a version a day: a sweep in slices of time, where a join would compare each line with every day.
    days = read(spark, sf, "orders").groupBy(C("o_orderstatus").alias("k"), C("o_orderdate").cast("date").alias("start_date")).agg(
        F.max("o_orderkey").alias("version"), F.sum(dec("o_totalprice")).cast("decimal(22,2)").alias("total")
    )
    dim = days.withColumn("end_date", F.lead("start_date").over(Window.partitionBy("k").orderBy("start_date")))
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", C("l_shipdate").cast("date").alias("day"))
    return R.as_of(lines, dim, {"l_linestatus": "k"}, C("day"), slice_rows=1 << 16, slice_bytes=0).select("l_orderkey", "l_linenumber", "version", "total")


# Aggregates


@query("SELECT " + " UNION ALL SELECT ".join(f"'{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def row_counts_union_all(spark, sf):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = read(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1 ORDER BY 2 DESC")
def status_distribution(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders")).orderBy(C("orders").desc_nulls_last())


@query("""SELECT count(*) AS rows, count(CASE WHEN l_extendedprice <= 0 THEN 1 END) AS not_positive, min(l_extendedprice::DECIMAL(12,2)) AS least, max(l_extendedprice::DECIMAL(12,2)) AS most,
    round(avg(l_extendedprice), 4) AS mean, sum(l_tax::DECIMAL(12,2))::DECIMAL(22,2) AS tax FROM lineitem""")
def money_sanity(spark, sf):
    p = dec("l_extendedprice")
    return read(spark, sf, "lineitem").agg(
        F.count("*").alias("rows"), F.count(F.when(C("l_extendedprice") <= 0, 1)).alias("not_positive"), F.min(p).alias("least"), F.max(p).alias("most"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.sum(dec("l_tax")).cast("decimal(22,2)").alias("tax"))


@query("""SELECT quality, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM labels GROUP BY 1""")
def sentiment_split_pct(spark, sf):
    # The window runs over one row per group, never over the table.
    g = read(spark, sf, "labels").groupBy("quality").agg(F.sum(F.when(C("toxic") == 1, 1).otherwise(0)).cast("long").alias("toxic"), F.count("*").alias("n"))
    return g.withColumn("pct", F.round(C("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()), 1))


@query("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS paid FROM orders GROUP BY 1 ORDER BY 2 DESC")
def payment_distribution(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(dec("o_totalprice")).cast("decimal(22,2)").alias("paid")).orderBy(C("n").desc())


@query("SELECT (count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)))::BIGINT AS empty_orders, count(*) AS orders FROM orders")
def scalar_subquery_rate(spark, sf):
    flagged = R.flag_exists(read(spark, sf, "orders").select("o_orderkey"), read(spark, sf, "lineitem"), {"o_orderkey": "l_orderkey"}, "ok")
    return flagged.agg(F.count_if(~C("ok")).alias("empty_orders"), F.count("*").alias("orders"))


@query("""WITH n AS (SELECT c_nationkey AS zone, c_mktsegment AS city, count(*) AS n FROM customer GROUP BY 1, 2),
    m AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, city) AS rn FROM n)
    SELECT zone, city, n, (SELECT round(avg(c_acctbal), 4) FROM customer WHERE c_nationkey = zone) AS centre FROM m WHERE rn = 1""")
def mode_with_centroid(spark, sf):
    # One pass: sums by (zone, city) give both the most frequent city and the zone's mean.
    part = read(spark, sf, "customer").groupBy(C("c_nationkey").alias("zone"), C("c_mktsegment").alias("city")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"), F.count("c_acctbal").alias("k"))
    best = F.min_by(F.struct("city", "n"), F.struct(-C("n"), C("city")))
    return part.groupBy("zone").agg(best.alias("b"), F.round(F.sum("s") / F.sum("k"), 4).alias("centre")).select("zone", "b.city", "b.n", "centre")


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_orders FROM orders GROUP BY 1 HAVING open_orders > 7 ORDER BY 2 DESC, 1 LIMIT 20")
def having_alias(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.when(C("o_orderstatus") == "O", 1).otherwise(0)).cast("long").alias("open_orders"))
    return g.filter("open_orders > 7").orderBy(C("open_orders").desc(), "o_custkey").limit(20)


@query("SELECT l_returnflag || l_linestatus AS pair, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem GROUP BY l_returnflag || l_linestatus, year(l_shipdate), l_linestatus ORDER BY l_linestatus, 2")
def group_by_expressions(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("pair"), F.year("l_shipdate").alias("year"), "l_linestatus").agg(F.count("*").alias("n"))
    return g.orderBy("l_linestatus", "year").select("pair", "year", "n")


# Windows and duplicates


_TIE = "l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_TIE}) AS rn FROM lineitem) WHERE rn = 1")
def dedup_latest(spark, sf):
    return R.keep_latest(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [C("l_shipdate").desc_nulls_last()], _ORDER)


@query(f"SELECT dup, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_TIE}) > 1 AS dup FROM lineitem) GROUP BY 1")
def dedup_flag(spark, sf):
    return R.flag_duplicates(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [C("l_shipdate").desc_nulls_last()], _ORDER, "dup").groupBy("dup").agg(F.count("*").alias("n"))


@query("SELECT dup, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup FROM lineitem) GROUP BY 1")
def dedup_flag_all_copies(spark, sf):
    return R.flag_all_copies(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "dup").groupBy("dup").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'O') DESC NULLS LAST, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedup_nulls_last(spark, sf):
    order = [F.nullif("o_orderstatus", F.lit("O")).desc_nulls_last(), C("o_orderdate").desc_nulls_last()]
    return R.keep_latest(read(spark, sf, "orders"), ["o_custkey"], order, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT c_nationkey, c_custkey, first_order FROM (SELECT c_nationkey, c_custkey, min(o_orderdate)::DATE AS first_order,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY min(o_orderdate) NULLS LAST, c_custkey) AS rn FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) WHERE rn = 1""")
def first_order_per_group(spark, sf):
    firsts = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("at"))
    both = read(spark, sf, "customer").join(firsts, C("o_custkey") == C("c_custkey"), "left")
    return R.keep_latest(both, ["c_nationkey"], [C("at").asc_nulls_last()], ["c_custkey"]).select("c_nationkey", "c_custkey", C("at").cast("date").alias("first_order"))


# Dates, texts, numbers


@query("""SELECT strftime(d, '%Y%m%d')::INT AS date_key, d AS calendar_date, isodow(d)::INT AS day_of_week, strftime(d, '%A') AS day_name, day(d)::INT AS day_of_month, dayofyear(d)::INT AS day_of_year,
    weekofyear(d)::INT AS week_of_year, month(d)::INT AS month_num, strftime(d, '%B') AS month_name, quarter(d)::INT AS quarter_num, year(d)::INT AS year_num, isodow(d) IN (6, 7) AS is_weekend
    FROM (SELECT unnest(generate_series(DATE '2015-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d)""")
def date_dim(spark, sf):
    return calendar(spark, "2015-01-01", "2030-12-31")


@query("""SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')::INT AS ship_key, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS delay_days,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate::DATE > o_orderdate::DATE END AS is_late FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_key_delay_late(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    late = F.when(C("l_returnflag") == "N", F.lit(None)).otherwise(C("l_shipdate").cast("date") > C("o_orderdate").cast("date"))
    return both.select("l_orderkey", "l_linenumber", date_key(C("l_shipdate")).alias("ship_key"), days_between(C("o_orderdate"), C("l_shipdate")).alias("delay_days"), late.alias("is_late"))


@query("""SELECT p_partkey, lower(trim(p_name)) AS name, upper(p_brand) AS brand, nullif(trim(replace(p_type, 'STANDARD', '')), '') AS kind,
    (SELECT string_agg(upper(w[1:1]) || lower(w[2:]), '' ORDER BY i) FROM (SELECT unnest(regexp_extract_all(p_name || '-' || p_brand || '.' || p_type, '[^ #.-]*[ #.-]?')) AS w, generate_subscripts(regexp_extract_all(p_name || '-' || p_brand || '.' || p_type, '[^ #.-]*[ #.-]?'), 1) AS i)) AS title FROM part""")
def string_clean_initcap(spark, sf):
    whole = F.concat(C("p_name"), F.lit("-"), C("p_brand"), F.lit("."), C("p_type"))
    return read(spark, sf, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), F.upper("p_brand").alias("brand"), blank_to_null(F.replace("p_type", F.lit("STANDARD"), F.lit(""))).alias("kind"), initcap_words(whole).alias("title"))


@query("SELECT o_orderkey, sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || coalesce(nullif(o_orderpriority, '5-LOW'), '∅')) AS row_hash FROM orders")
def row_hashes(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", row_hash(C("o_orderkey"), C("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("row_hash"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2) AS price, l_tax::DECIMAL(12,2) AS freight, (l_extendedprice::DECIMAL(12,2) + coalesce(l_tax::DECIMAL(12,2), 0))::DECIMAL(12,2) AS total,
    abs(l_discount::DECIMAL(12,2) - l_tax::DECIMAL(12,2))::DECIMAL(12,2) AS gap FROM lineitem""")
def round_coalesce_total(spark, sf):
    zero = F.lit(0).cast("decimal(12,2)")
    total = F.coalesce(dec("l_extendedprice"), zero) + F.coalesce(dec("l_tax"), zero)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dec("l_extendedprice").alias("price"), dec("l_tax").alias("freight"), total.cast("decimal(12,2)").alias("total"), F.abs(dec("l_discount") - dec("l_tax")).cast("decimal(12,2)").alias("gap"))


# Data quality


def log_rows(df, target: str, checks: list):
    """Audit rows (name, kind, failing predicate) of one table from one aggregate over one scan."""
    a = df.agg(F.count("*").alias("total"), *[F.count_if(p).alias(f"f{k}") for k, (_, _, p) in enumerate(checks)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(kind).alias("check_type"), C(f"f{k}").alias("failed")) for k, (n, kind, _) in enumerate(checks)]))
    rate = pass_rate(C("total"), C("x.failed")).cast("double")
    return a.select("total", each.alias("x")).select("x.check_name", F.lit(target).alias("target"), "x.check_type", F.when(C("x.failed") == 0, "PASS").otherwise("FAIL").alias("result"), "total", "x.failed", rate.alias("pass_rate"))


def log_row(df, name: str, target: str, kind: str, failed):
    return log_rows(df, target, [(name, kind, failed)])


def log_sql(name: str, target: str, kind: str, source: str, failed: str) -> str:
    return f"""SELECT '{name}' AS check_name, '{target}' AS target, '{kind}' AS check_type, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS result, total, failed,
    round((total - failed) * 100.0::DOUBLE / nullif(total, 0), 3) AS pass_rate FROM (SELECT count(*) AS total, count(*) FILTER ({failed}) AS failed FROM {source})"""


def _dups(spark, sf):
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
    # A key's copies beyond the first, counted by one aggregate and no window.
    return {t: read(spark, sf, t).groupBy(*k).agg(F.count("*").alias("n")) for t, k in keys.items()}


_DUP_KEYS = {"lineitem": "l_orderkey, l_linenumber", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


@query(" UNION ALL ".join(log_sql(f"DEDUP_{t.upper()}", t, "DEDUP", f"(SELECT row_number() OVER (PARTITION BY {k}) AS rn FROM {t})", "rn > 1") for t, k in _DUP_KEYS.items()))
def dedup_log(spark, sf):
    out = None
    for t, g in _dups(spark, sf).items():
        a = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(C("n") - 1), F.lit(0)).alias("failed"))
        one = a.select(F.lit(f"DEDUP_{t.upper()}").alias("check_name"), F.lit(t).alias("target"), F.lit("DEDUP").alias("check_type"), F.when(C("failed") == 0, "PASS").otherwise("FAIL").alias("result"), "total", "failed", pass_rate(C("total"), C("failed")).cast("double").alias("pass_rate"))
        out = one if out is None else out.unionByName(one)
    return out


#: Child table and key, parent table and key.
_REFS = {
    "REF_ITEM_TO_ORDER": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "REF_ITEM_TO_PART": ("lineitem", "l_partkey", "part", "p_partkey"),
    "REF_ITEM_TO_SUPPLIER": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "REF_ORDER_TO_CUSTOMER": ("orders", "o_custkey", "customer", "c_custkey"),
    "REF_EVENT_TO_CUSTOMER": ("events", "user_id", "customer", "c_custkey"),
    "REF_LABEL_TO_DOCUMENT": ("labels", "doc_id", "documents", "doc_id"),
}


def _ref(name: str, child: str, missing: str) -> str:
    return log_sql(name, child, "REF_INTEGRITY", f"(SELECT {missing} AS missing FROM {child})", "missing")


@query(
    " UNION ALL ".join(
        (
            _ref("REF_ITEM_TO_ORDER", "lineitem", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
            _ref("REF_ITEM_TO_PART", "lineitem", "l_partkey NOT IN (SELECT p_partkey FROM part)"),
            _ref("REF_ITEM_TO_SUPPLIER", "lineitem", "l_suppkey NOT IN (SELECT s_suppkey FROM supplier)"),
            _ref("REF_ORDER_TO_CUSTOMER", "orders", "o_custkey NOT IN (SELECT c_custkey FROM customer)"),
            _ref("REF_EVENT_TO_CUSTOMER", "events", "user_id NOT IN (SELECT c_custkey FROM customer)"),
            _ref("REF_LABEL_TO_DOCUMENT", "labels", "doc_id NOT IN (SELECT d.doc_id FROM documents d)"),
        )
    )
)
def ref_integrity_log(spark, sf):
    out = None
    for n, (t, k, p, pk) in _REFS.items():
        flagged = R.flag_exists(read(spark, sf, t).select(C(k).alias("k")), read(spark, sf, p).select(C(pk).alias("pk")), {"k": "pk"}, "ok")
        one = log_row(flagged, n, t, "REF_INTEGRITY", ~C("ok"))
        out = one if out is None else out.unionByName(one)
    return out


def _invalid() -> dict:
    """What makes a row invalid, by table."""
    return {
        "orders": C("o_orderdate").isNull() | ~C("o_orderstatus").isin("F", "O") | (C("o_totalprice") <= 0),
        "lineitem": (C("l_extendedprice") <= 0) | (C("l_discount") < 0) | (C("l_linenumber") < 1) | (C("l_quantity") > 49),
        "customer": C("c_custkey").isNull() | (C("c_acctbal") < 0),
        "part": C("p_size") <= 0,
        "supplier": C("s_suppkey").isNull(),
        "labels": ~C("quality").between(0, 1) | ~C("toxic").isin(0, 1),
        "events": ~C("event_type").isin("view", "click", "purchase", "signup"),
    }


_VALID_SQL = {
    "orders": "o_orderdate IS NULL OR (o_orderstatus <> 'F' AND o_orderstatus <> 'O') OR o_totalprice <= 0",
    "lineitem": "l_extendedprice <= 0 OR l_discount < 0 OR l_linenumber < 1 OR l_quantity > 49",
    "customer": "c_custkey IS NULL OR c_acctbal < 0",
    "part": "p_size IS NOT NULL AND p_size <= 0",
    "supplier": "s_suppkey IS NULL",
    "labels": "quality < 0 OR quality > 1 OR toxic < 0 OR toxic > 1",
    "events": "event_type = 'error'",
}


@query(" UNION ALL ".join(log_sql(f"VALID_{t.upper()}", t, "VALIDITY", t, p) for t, p in _VALID_SQL.items()))
def validity_log(spark, sf):
    out = None
    for t, p in _invalid().items():
        one = log_row(read(spark, sf, t), f"VALID_{t.upper()}", t, "VALIDITY", F.coalesce(p, F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


def _rules() -> dict:
    """Rules by table: name, kind, and what breaks them."""
    return {
        "lineitem": [
            ("FREIGHT_EXCEEDS_PRICE", "RANGE", C("l_tax") > C("l_discount")),
            ("INSTALLMENTS_OUT_OF_RANGE", "RANGE", ~C("l_quantity").between(1, 24)),
            ("ZERO_PRICE_ITEMS", "RANGE", C("l_extendedprice") == 0),
        ],
        "orders": [("DELIVERED_NULL_TIMESTAMP", "NULL_CHECK", (C("o_orderstatus") == "F") & C("o_orderdate").isNull())],
    }


@query(
    " UNION ALL ".join(
        (
            log_sql("FREIGHT_EXCEEDS_PRICE", "lineitem", "RANGE", "lineitem", "l_tax > l_discount"),
            log_sql("INSTALLMENTS_OUT_OF_RANGE", "lineitem", "RANGE", "lineitem", "l_quantity < 1 OR l_quantity > 24"),
            log_sql("ZERO_PRICE_ITEMS", "lineitem", "RANGE", "lineitem", "l_extendedprice = 0"),
            log_sql("DELIVERED_NULL_TIMESTAMP", "orders", "NULL_CHECK", "orders", "o_orderstatus = 'F' AND o_orderdate IS NULL"),
        )
    )
)
def range_log(spark, sf):
    out = None
    for t, checks in _rules().items():
        one = log_rows(read(spark, sf, t), t, [(n, k, F.coalesce(p, F.lit(False))) for n, k, p in checks])
        out = one if out is None else out.unionByName(one)
    return out


@query(log_sql("TIMESTAMP_INVERSION", "lineitem", "RANGE", "(SELECT l_shipdate < o_orderdate AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "bad"))
def timestamp_inversion_log(spark, sf):
    both = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"))
    return log_row(both, "TIMESTAMP_INVERSION", "lineitem", "RANGE", C("l_shipdate") < C("o_orderdate"))


@query(log_sql("PAYMENT_ITEM_RECONCILIATION", "orders", "RANGE", """(SELECT abs(item - paid) / nullif(item, 0) > 0.1 AS bad FROM (SELECT l_orderkey AS k, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS item FROM lineitem GROUP BY 1)
    LEFT JOIN (SELECT o_orderkey AS k, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS paid FROM orders GROUP BY 1) USING (k) WHERE item <> 0)""", "bad"))
def reconciliation_10pct(spark, sf):
    items = read(spark, sf, "lineitem").groupBy(C("l_orderkey").alias("k")).agg(F.sum(dec("l_extendedprice")).cast("double").alias("item"))
    paid = read(spark, sf, "orders").groupBy(C("o_orderkey").alias("k")).agg(F.sum(dec("o_totalprice")).cast("double").alias("paid"))
    return log_row(items.filter("item <> 0").join(paid, "k", "left"), "PAYMENT_ITEM_RECONCILIATION", "orders", "RANGE", F.abs(C("item") - C("paid")) / C("item") > 0.1)


@query(log_sql("ORDERS_WITHOUT_ITEMS", "orders", "NULL_CHECK", "(SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS ok FROM orders WHERE o_orderstatus <> 'P')", "NOT ok"))
def orders_without_items_log(spark, sf):
    orders = read(spark, sf, "orders").filter(C("o_orderstatus") != "P").select("o_orderkey")
    return log_row(R.flag_exists(orders, read(spark, sf, "lineitem"), {"o_orderkey": "l_orderkey"}, "ok"), "ORDERS_WITHOUT_ITEMS", "orders", "NULL_CHECK", ~C("ok"))


_ALL_LOGS = ("dedup_log", "ref_integrity_log", "validity_log", "range_log", "timestamp_inversion_log", "reconciliation_10pct", "orders_without_items_log")


@query("SELECT check_type, count(*) AS checks, sum(CASE WHEN result = 'PASS' THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN result = 'FAIL' THEN 1 ELSE 0 END)::BIGINT AS failed, round(avg(pass_rate), 3) AS mean_rate FROM ("
       + " UNION ALL ".join(_SQL[n] for n in _ALL_LOGS) + ") GROUP BY 1")
def dq_dashboard_by_type(spark, sf):
    logs = None
    for one in (_line_log(spark, sf), _order_log(spark, sf), *_small_logs(spark, sf)):
        logs = one if logs is None else logs.unionByName(one)
    one_if = lambda x: F.sum(F.when(C("result") == x, 1).otherwise(0)).cast("long")
    return logs.groupBy("check_type").agg(F.count("*").alias("checks"), one_if("PASS").alias("passed"), one_if("FAIL").alias("failed"), F.round(F.avg("pass_rate"), 3).alias("mean_rate"))


def _results(totals: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """Audit results (kind, result, rate) from one row of totals; a check names its kind and the columns with its rows and its failures."""
    each = F.array(*[F.struct(F.lit(kind).alias("check_type"), C(n).alias("total"), F.coalesce(C(f), F.lit(0)).alias("failed")) for kind, n, f in checks])
    long = totals.select(F.explode(each).alias("x")).select("x.*")
    return long.select("check_type", F.when(C("failed") == 0, "PASS").otherwise("FAIL").alias("result"), pass_rate(C("total"), C("failed")).cast("double").alias("pass_rate"))


def _known(keys: DataFrame, key: str, flag: str) -> DataFrame:
    return keys.select(C(key).alias(f"_{flag}")).dropna().distinct().withColumn(flag, F.lit(1))


def _bad(c):
    return F.count_if(F.coalesce(c, F.lit(False)))


def _line_log(spark, sf) -> DataFrame:
    """The checks over order lines: one scan of them, one join with the orders on the key, and no exchange after it."""
    orders = read(spark, sf, "orders").groupBy("o_orderkey").agg(F.collect_list("o_orderdate").alias("dates"), F.sum(dec("o_totalprice")).cast("double").alias("paid"))
    parts, suppliers = _known(read(spark, sf, "part"), "p_partkey", "part"), _known(read(spark, sf, "supplier"), "s_suppkey", "supplier")
    lines = read(spark, sf, "lineitem").join(orders, C("l_orderkey") == C("o_orderkey"), "left")
    lines = lines.join(parts, C("l_partkey") == C("_part"), "left").join(suppliers, C("l_suppkey") == C("_supplier"), "left")
    rules = [_invalid()["lineitem"], *[p for _, _, p in _rules()["lineitem"]], C("o_orderkey").isNull(), C("part").isNull(), C("supplier").isNull()]
    early = F.size(F.filter("dates", lambda d: d > C("l_shipdate")))
    per_line = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("n"), *[_bad(p).alias(f"f{k}") for k, p in enumerate(rules)], F.sum(F.greatest(F.size("dates"), F.lit(0))).alias("dated"),
        F.sum(F.greatest(early, F.lit(0))).alias("early"), F.sum(dec("l_extendedprice")).alias("item"), F.first("paid").alias("paid"),
    )
    summed = [*[f"f{k}" for k in range(len(rules))], "dated", "early"]
    per_order = per_line.groupBy("l_orderkey").agg(
        F.sum("n").alias("n"), F.sum(C("n") - 1).alias("copies"), *[F.sum(c).alias(c) for c in summed], F.sum("item").cast("double").alias("item"), F.first("paid").alias("paid")
    )
    gap = F.abs(C("item") - C("paid")) / F.nullif(C("item"), F.lit(0.0)) > 0.1
    totals = per_order.agg(*[F.sum(c).alias(c) for c in ("n", "copies", *summed)], F.count_if(C("item") != 0).alias("billed"), _bad(gap).alias("gap"))
    kinds = ["VALIDITY", "RANGE", "RANGE", "RANGE", "REF_INTEGRITY", "REF_INTEGRITY", "REF_INTEGRITY"]
    return _results(totals, [("DEDUP", "n", "copies"), *[(kind, "n", f"f{k}") for k, kind in enumerate(kinds)], ("RANGE", "dated", "early"), ("RANGE", "billed", "gap")])


def _order_log(spark, sf) -> DataFrame:
    customers, full = _known(read(spark, sf, "customer"), "c_custkey", "customer"), _known(read(spark, sf, "lineitem"), "l_orderkey", "line")
    orders = read(spark, sf, "orders").join(customers, C("o_custkey") == C("_customer"), "left")
    rules = [_invalid()["orders"], _rules()["orders"][0][2], C("customer").isNull()]
    per = orders.groupBy("o_orderkey").agg(F.count("*").alias("n"), *[_bad(p).alias(f"f{k}") for k, p in enumerate(rules)], F.count_if(C("o_orderstatus") != "P").alias("open"))
    both = per.join(full, C("o_orderkey") == C("_line"), "left").withColumn("empty", F.when(C("line").isNull(), C("open")).otherwise(0))
    totals = both.agg(*[F.sum(c).alias(c) for c in ("n", "f0", "f1", "f2", "open", "empty")], F.sum(C("n") - 1).alias("copies"))
    return _results(totals, [("DEDUP", "n", "copies"), ("VALIDITY", "n", "f0"), ("NULL_CHECK", "n", "f1"), ("REF_INTEGRITY", "n", "f2"), ("NULL_CHECK", "open", "empty")])


def _small_logs(spark, sf) -> list[DataFrame]:
    """The checks over the other tables, a scan for each."""
    keys = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": None, "labels": None}
    refs = {"events": ("user_id", "customer", "c_custkey"), "labels": ("doc_id", "documents", "doc_id")}
    out = []
    for t, key in keys.items():
        rows, checks = read(spark, sf, t), []
        aggs = [F.count("*").alias("n")]
        if t in _invalid():
            aggs.append(_bad(_invalid()[t]).alias("f0"))
            checks.append(("VALIDITY", "n", "f0"))
        if t in refs:
            k, parent, pk = refs[t]
            rows = rows.join(_known(read(spark, sf, parent), pk, "known"), C(k) == C("_known"), "left")
            aggs.append(_bad(C("known").isNull()).alias("f1"))
            checks.append(("REF_INTEGRITY", "n", "f1"))
        if key:
            rows = rows.groupBy(key).agg(*aggs)
            aggs = [F.sum(C(c)).alias(c) for c in ("n", *[f for _, _, f in checks])] + [F.sum(C("n") - 1).alias("copies")]
            checks.append(("DEDUP", "n", "copies"))
        out.append(_results(rows.agg(*aggs), checks))
    return out


# Dimensions, facts, change capture. A split by key plays the old and the new state; every row is in one of them or in both.


def _customers(spark, sf, batch: bool):
    c = read(spark, sf, "customer")
    if batch:  # every fifth key is new, every second of the others is there again, every third of all has moved
        c = c.filter("c_custkey % 2 = 0 OR c_custkey % 5 = 0")
        return c.select("c_custkey", F.when(C("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(" 2"))).otherwise(C("c_mktsegment")).alias("city"), C("c_nationkey").cast("string").alias("state"))
    return c.filter("c_custkey % 5 <> 0").select("c_custkey", C("c_mktsegment").alias("city"), C("c_nationkey").cast("string").alias("state"))


_OLD = "SELECT c_custkey, c_mktsegment AS city, c_nationkey::VARCHAR AS state FROM customer WHERE c_custkey % 5 <> 0"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' 2' ELSE c_mktsegment END AS city, c_nationkey::VARCHAR AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), s AS (SELECT n.* FROM n LEFT JOIN o USING (c_custkey) WHERE o.c_custkey IS NULL OR o.city <> n.city OR o.state <> n.state)
    SELECT o.*, DATE '2001-01-01' AS start_date, CASE WHEN s.c_custkey IS NOT NULL THEN {AS_OF} END AS end_date, s.c_custkey IS NULL AS is_current FROM o LEFT JOIN s USING (c_custkey)
    UNION ALL SELECT s.*, {AS_OF}, NULL, TRUE FROM s""")
def scd2_expire_insert(spark, sf):
    dim = _customers(spark, sf, False).select("*", F.lit("2001-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(True).alias("is_current"))
    return R.scd2_apply(dim, _customers(spark, sf, True), "c_custkey", ["city", "state"], F.expr(AS_OF))


@query(f"SELECT c_custkey, coalesce(n.city, o.city) AS city, coalesce(n.state, o.state) AS state FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (c_custkey)")
def scd1_upsert(spark, sf):
    return R.upsert(_customers(spark, sf, False), _customers(spark, sf, True), ["c_custkey"])


@query(f"""WITH d AS (SELECT o.c_custkey AS k, n.c_custkey AS m, o.city AS oc, o.state AS os, n.city AS nc, n.state AS ns FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey
    WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.city <> n.city OR o.state <> n.state)
    SELECT k AS c_custkey, m IS NOT NULL AS _is_update, oc AS city, os AS state, 'DELETE' AS _action FROM d WHERE k IS NOT NULL
    UNION ALL SELECT m, k IS NOT NULL, nc, ns, 'INSERT' FROM d WHERE m IS NOT NULL""")
def snapshot_changes(spark, sf):
    return R.snapshot_diff(_customers(spark, sf, False), _customers(spark, sf, True), ["c_custkey"])


_ITEMS = "SELECT l_orderkey, l_linenumber, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS price, min(l_returnflag) AS status FROM lineitem GROUP BY 1, 2"


def _items(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(dec("l_extendedprice")).cast("decimal(22,2)").alias("price"), F.min("l_returnflag").alias("status"))


@query(f"""WITH i AS ({_ITEMS}), t AS (SELECT *, FALSE AS is_late FROM i WHERE l_orderkey % 4 <> 0), s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 6 = 1 THEN price + 1 ELSE price END::DECIMAL(22,2) AS price, status FROM i WHERE l_orderkey % 3 <> 2 OR l_orderkey % 4 = 0)
    SELECT l_orderkey, l_linenumber, CASE WHEN t.price IS NULL OR s.price IS NOT NULL AND (s.price <> t.price OR s.status <> t.status) THEN s.price ELSE t.price END AS price, coalesce(t.status, s.status) AS status, coalesce(t.is_late, TRUE) AS is_late
    FROM t FULL JOIN s USING (l_orderkey, l_linenumber)""")
def late_arriving_items(spark, sf):
    items = _items(spark, sf)
    target = items.filter("l_orderkey % 4 <> 0").withColumn("is_late", F.lit(False))
    source = items.filter("l_orderkey % 3 <> 2 OR l_orderkey % 4 = 0").withColumn("price", F.when(C("l_orderkey") % 6 == 1, C("price") + 1).otherwise(C("price")).cast("decimal(22,2)")).withColumn("is_late", F.lit(True))
    return R.upsert(target, source, ["l_orderkey", "l_linenumber"], change=["price", "status"], update=["price", "status"])


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority AS kind, o_totalprice::DECIMAL(12,2) AS paid FROM orders), t AS (SELECT * FROM p WHERE o_orderkey % 4 <> 0), s AS (SELECT o_orderkey, upper(kind) || '!' AS kind, CASE WHEN o_orderkey % 5 = 0 THEN paid * 2 ELSE paid END::DECIMAL(12,2) AS paid FROM p WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0)
    SELECT o_orderkey, CASE WHEN t.paid IS NULL OR s.paid <> t.paid THEN s.kind ELSE t.kind END AS kind, CASE WHEN t.paid IS NULL OR s.paid <> t.paid THEN s.paid ELSE t.paid END AS paid FROM t FULL JOIN s USING (o_orderkey)""")
def merge_payments(spark, sf):
    p = read(spark, sf, "orders").select("o_orderkey", C("o_orderpriority").alias("kind"), dec("o_totalprice").alias("paid"))
    source = p.filter("o_orderkey % 3 = 0 OR o_orderkey % 4 = 0").select("o_orderkey", F.concat(F.upper("kind"), F.lit("!")).alias("kind"), F.when(C("o_orderkey") % 5 == 0, C("paid") * 2).otherwise(C("paid")).cast("decimal(12,2)").alias("paid"))
    return R.upsert(p.filter("o_orderkey % 4 <> 0"), source, ["o_orderkey"], change=["paid"])


_FACT = """SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y%m%d')::INT AS date_key, c_custkey, p_partkey, s_suppkey, n.n_nationkey AS geo_key, l_extendedprice::DECIMAL(12,2) AS price, o_orderstatus = 'P' AS is_canceled
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey"""


@query(_FACT)
def fact_items_build(spark, sf):
    items, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    wide = (
        items.join(orders, C("l_orderkey") == C("o_orderkey"))
        .join(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey"))
        .join(read(spark, sf, "part").select("p_partkey"), C("l_partkey") == C("p_partkey"))
        .join(read(spark, sf, "supplier").select("s_suppkey"), C("l_suppkey") == C("s_suppkey"))
        .join(read(spark, sf, "nation").select("n_nationkey"), C("c_nationkey") == C("n_nationkey"), "left")
    )
    return wide.select("l_orderkey", "l_linenumber", date_key(C("o_orderdate")).alias("date_key"), "c_custkey", "p_partkey", "s_suppkey", C("n_nationkey").alias("geo_key"), dec("l_extendedprice").alias("price"), (C("o_orderstatus") == "P").alias("is_canceled"))


@query("SELECT count(*) AS orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL")
def fact_orphans(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders"), C("l_orderkey") == C("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query(f"SELECT k, sum(CASE WHEN end_date IS NULL THEN 1 ELSE 0 END)::BIGINT AS current_versions, count(*) AS versions FROM ({_VERSIONS}) GROUP BY 1 HAVING current_versions <> 1 OR versions > 12")
def scd2_integrity(spark, sf):
    g = versions(spark, sf).groupBy("k").agg(F.sum(F.when(C("end_date").isNull(), 1).otherwise(0)).cast("long").alias("current_versions"), F.count("*").alias("versions"))
    return g.filter("current_versions <> 1 OR versions > 12")


@query("""SELECT 'items' AS target, count(*) AS loaded, count(*) FILTER (l_extendedprice <= 0) AS rejected, CASE WHEN count(*) FILTER (l_extendedprice <= 0) = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM lineitem
    UNION ALL SELECT 'events', count(*), count(*) FILTER (event_type = 'error'), CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'SUCCESS' ELSE 'PARTIAL' END FROM events""")
def pipeline_run_summary(spark, sf):
    def one(t, name, bad):
        a = read(spark, sf, t).agg(F.count("*").alias("loaded"), F.count_if(bad).alias("rejected"))
        return a.select(F.lit(name).alias("target"), "loaded", "rejected", F.when(C("rejected") == 0, "SUCCESS").otherwise("PARTIAL").alias("status"))

    return one("lineitem", "items", C("l_extendedprice") <= 0).unionByName(one("events", "events", C("event_type") == "error"))


@query("SELECT row_number() OVER (ORDER BY s_name, s_suppkey) + 100 AS supplier_key, s_suppkey FROM supplier")
def surrogate_keys(spark, sf):
    return R.allocate_keys(read(spark, sf, "supplier").select("s_suppkey", "s_name"), "supplier_key", ["s_name", "s_suppkey"], 100).select("supplier_key", "s_suppkey")


# Business questions


def _sales(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_custkey")
    return read(spark, sf, "lineitem").join(orders, C("l_orderkey") == C("o_orderkey"))


def _revenue():
    return F.sum(dec("l_extendedprice")).cast("decimal(22,2)").alias("revenue")


_SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_REV = "sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS revenue"


@query(f"SELECT o_orderdate::DATE AS day, {_REV}, count(DISTINCT o_orderkey) AS orders FROM {_SALES} GROUP BY 1")
def sales_daily(spark, sf):
    return _sales(spark, sf).groupBy(C("o_orderdate").cast("date").alias("day")).agg(_revenue(), F.countDistinct("o_orderkey").alias("orders"))


@query(f"SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, strftime(o_orderdate, '%B') AS month_name, {_REV} FROM {_SALES} GROUP BY 1, 2, 3")
def sales_monthly(spark, sf):
    return _sales(spark, sf).groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.date_format("o_orderdate", "MMMM").alias("month_name")).agg(_revenue())


@query(f"SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, {_REV} FROM {_SALES} GROUP BY 1, 2")
def sales_yearly(spark, sf):
    return _sales(spark, sf).groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(_revenue())


@query(f"SELECT l_partkey, {_REV}, count(*) AS lines FROM {_SALES} GROUP BY 1 ORDER BY revenue DESC, l_partkey LIMIT 10")
def topk_products(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey"), C("l_orderkey") == C("o_orderkey")).groupBy("l_partkey").agg(_revenue(), F.count("*").alias("lines")).orderBy(C("revenue").desc(), "l_partkey").limit(10)


@query(f"SELECT p_brand, p_type, {_REV} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def sales_by_category(spark, sf):
    return read(spark, sf, "lineitem").join(read(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), C("l_partkey") == C("p_partkey")).groupBy("p_brand", "p_type").agg(_revenue())


@query("SELECT o_custkey, sum(o_totalprice::DECIMAL(12,2))::DECIMAL(22,2) AS spent FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_customers(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(dec("o_totalprice")).cast("decimal(22,2)").alias("spent")).orderBy(C("spent").desc(), "o_custkey").limit(10)


@query("""SELECT count(*) AS orders, round(count(*) FILTER (o_orderstatus = 'P') * 100.0::DOUBLE / count(*), 2) AS canceled_pct, round(count(*) FILTER (o_orderstatus = 'F') * 100.0::DOUBLE / count(*), 2) AS delivered_pct FROM orders""")
def cancel_delivery_rate(spark, sf):
    n = F.count("*")
    return read(spark, sf, "orders").agg(n.alias("orders"), share(F.count_if(C("o_orderstatus") == "P"), n).alias("canceled_pct"), share(F.count_if(C("o_orderstatus") == "F"), n).alias("delivered_pct"))


@query("SELECT o_orderpriority, count(*) AS payments, round(count(*) FILTER (o_totalprice <= 1000) * 100.0::DOUBLE / count(*), 2) AS failed_pct FROM orders GROUP BY 1")
def payment_failure_proxy(spark, sf):
    n = F.count("*")
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(n.alias("payments"), share(F.count_if(C("o_totalprice") <= 1000), n).alias("failed_pct"))


@query("SELECT sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(12,2) ELSE 0 END)::DECIMAL(22,2) AS refunded, count(*) FILTER (l_returnflag = 'R') AS refunds FROM lineitem")
def refund_total(spark, sf):
    back = F.when(C("l_returnflag") == "R", dec("l_extendedprice")).otherwise(F.lit(0).cast("decimal(12,2)"))
    return read(spark, sf, "lineitem").agg(F.sum(back).cast("decimal(22,2)").alias("refunded"), F.count_if(C("l_returnflag") == "R").alias("refunds"))


@query("SELECT DISTINCT user_id FROM events v WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts)")
def viewed_not_purchased(spark, sf):
    e = read(spark, sf, "events")
    # The last purchase of a user decides for each view, so no pair of events is made.
    last = e.filter(C("event_type") == "purchase").groupBy("user_id").agg(F.max("ts").alias("last"))
    views = e.filter(C("event_type") == "view").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return views.join(last, "user_id", "left").filter(C("last").isNull() | (C("last") < C("seen"))).select("user_id")


@query("""SELECT ts::DATE AS day, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewed, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicked,
    count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS bought FROM events GROUP BY 1""")
def funnel_view_click_purchase(spark, sf):
    # One row per user and day with three flags: one shuffle on (day, user), no expansion for distinct counts.
    has = lambda k: F.max(F.when(C("event_type") == k, 1).otherwise(0))
    per = read(spark, sf, "events").groupBy(C("ts").cast("date").alias("day"), "user_id").agg(has("view").alias("v"), has("click").alias("c"), has("purchase").alias("p"))
    return per.groupBy("day").agg(F.sum("v").cast("long").alias("viewed"), F.sum("c").cast("long").alias("clicked"), F.sum("p").cast("long").alias("bought"))


@query("""SELECT r_name, n_name, sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def revenue_by_region(spark, sf):
    geo = read(spark, sf, "customer").join(read(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")).join(read(spark, sf, "region"), C("n_regionkey") == C("r_regionkey")).select("c_custkey", "r_name", "n_name")
    return _sales(spark, sf).join(geo, C("o_custkey") == C("c_custkey")).groupBy("r_name", "n_name").agg(_revenue())


@query("""WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS cohort FROM orders GROUP BY 1) SELECT cohort::INT AS cohort, (year(o_orderdate) - cohort)::INT AS age, count(DISTINCT orders.o_custkey) AS people, count(*) AS orders FROM orders JOIN f USING (o_custkey) GROUP BY 1, 2""")
def behaviour_over_time(spark, sf):
    orders = read(spark, sf, "orders")
    w = Window.partitionBy("o_custkey")
    aged = orders.withColumn("cohort", F.min(F.year("o_orderdate")).over(w)).withColumn("age", F.year("o_orderdate") - C("cohort"))
    per = aged.groupBy("o_custkey", "cohort", "age").agg(F.count("*").alias("n"))
    return per.groupBy("cohort", "age").agg(F.count("*").alias("people"), F.sum("n").cast("long").alias("orders"))


@query("SELECT CASE WHEN n > 1 THEN 'repeat' ELSE 'one-time' END AS kind, count(*) AS customers FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) GROUP BY 1")
def repeat_vs_onetime(spark, sf):
    per = read(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("n"))
    return per.groupBy(F.when(C("n") > 1, "repeat").otherwise("one-time").alias("kind")).agg(F.count("*").alias("customers"))


@query("SELECT round(sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(DISTINCT l_orderkey), 4) AS avg_order_value, round(sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(*), 4) AS avg_order_item_value FROM lineitem")
def average_order_value(spark, sf):
    total = F.sum(dec("l_extendedprice")).cast("double")
    return read(spark, sf, "lineitem").agg(F.round(total / F.countDistinct("l_orderkey"), 4).alias("avg_order_value"), F.round(total / F.count("*"), 4).alias("avg_order_item_value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling_window(spark, sf):
    g = read(spark, sf, "events").groupBy(F.window(C("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(C("w.start").alias("window_start"), "event_type", "n", "total")


@query("""SELECT year(ts)::INT AS year, month(ts)::INT AS month, event_type, count(DISTINCT user_id) AS people FROM events GROUP BY 1, 2, 3""")
def people_monthly_from_days(spark, sf):
    events = read(spark, sf, "events").select(C("ts").cast("date").alias("day"), "event_type", "user_id")
    days = distinct.by_day(events, "day", ["event_type"], "user_id")
    return distinct.counts(days, [F.year("day").alias("year"), F.month("day").alias("month"), "event_type"], "people")


@query("""SELECT year(o_orderdate)::INT AS year, n_name AS nation, count(DISTINCT o_custkey) AS buyers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def buyers_yearly_from_days(spark, sf):
    # Days of two loads, merged as a refresh would merge them.
    nations = read(spark, sf, "customer").join(read(spark, sf, "nation"), C("c_nationkey") == C("n_nationkey")).select("c_custkey", C("n_name").alias("nation"))
    orders = read(spark, sf, "orders").filter(C("o_orderstatus") != "P").join(nations, C("o_custkey") == C("c_custkey"))
    orders = orders.select(C("o_orderdate").cast("date").alias("day"), "nation", "o_custkey", (C("o_orderkey") % 2 == 0).alias("second"))
    first, second = (distinct.by_day(orders.filter(C("second") == x), "day", ["nation"], "o_custkey") for x in (False, True))
    return distinct.counts(distinct.merged(first, second), [F.year("day").alias("year"), "nation"], "buyers")


# Flagship


@query(
    """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, n_name AS nation, count(DISTINCT o_orderkey) AS orders,
    sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(22,2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3"""
)
def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    joined = (
        read(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("n_name").alias("nation")).agg(
        F.countDistinct("o_orderkey").alias("orders"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("revenue")
    )
