"""Ingestion, cleaning, quality, marts, change capture and the incremental pipeline on small hand-made tables."""

import gzip
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield import functions as fn
from loomfield import schemas
from loomfield.operators import marts, quality, staging
from loomfield.operators import rows as R
from loomfield.sources.files import list_files, load_audit, load_csv, load_history, record_load, stream_csv
from loomfield.sources.store import ConcurrentWrite, Store
from loomfield.streaming import pipeline as P

T0, T1 = datetime(2018, 1, 1), datetime(2018, 1, 2)
TODAY = "2018-06-01"


def raw(spark, table, *rows, at=T0):
    """Raw rows with provenance; the hash tells rows of equal load time apart."""
    n = len(schemas.struct(schemas.RAW[table]).fields)
    return spark.createDataFrame([(*r[:n], r[n] if len(r) > n else at, "f.csv", f"h{k}") for k, r in enumerate(rows)], schemas.raw(table))


@pytest.fixture
def world(spark):
    d = Decimal
    ts = lambda m, day=1, h=0: datetime(2018, m, day, h)
    return {
        "customers": raw(spark, "customers", (" C1 ", "u1", "01000", " sao paulo ", "sp"), ("c2", "u1", "02000", "mogi-guacu", "SP"), ("c3", "u2", "03000", "rio", "rj"), ("c3", "u2", "03000", "RIO ", "RJ", T1), ("c4", None, "1", "x", "x")),
        "geolocation": raw(spark, "geolocation", ("01000", 1.0, 2.0, "b", "sp"), ("01000", 3.0, 4.0, "a", "sp"), ("03000", None, 1.0, "rio", "rj")),
        "orders": raw(
            spark, "orders",
            ("O1", "c1", "delivered", ts(1), ts(1, 2), ts(1, 3), ts(1, 10), date(2018, 1, 10)), ("o2", "c2", "delivered", ts(2), ts(1), ts(2, 9), ts(2, 5), date(2018, 2, 4)),
            ("o3", "c3", "canceled", ts(3), None, None, None, date(2018, 3, 9)), ("o4", "c3", "shipped", ts(4), None, None, None, None), ("o5", "zz", "odd", ts(5), None, None, None, None), ("o6", "c3", "delivered", None, None, None, None, None),
        ),
        "order_items": raw(
            spark, "order_items",
            ("o1", 1, "P1", "s1", None, d("100.00"), d("10.00")), ("o1", 1, "p1", "s1", None, d("100.00"), d("10.00"), T1), ("o2", 1, "p1", "s1", None, d("50.00"), d("60.00")),
            ("o3", 1, "p2", "s9", None, d("20.00"), None), ("o4", 1, "p2", "s1", None, d("0.00"), d("1.00")), ("o9", 1, "p1", "s1", None, d("5.00"), d("0.00")), ("o1", 2, "p1", "s1", None, None, d("0.00")),
        ),
        "order_payments": raw(spark, "order_payments", ("o1", 1, "credit_card", 1, d("110.00")), ("o2", 1, "voucher", 30, d("10.00")), ("o3", None, "boleto", None, d("20.00")), ("o4", 1, "cash", 1, d("0.00"))),
        "order_reviews": raw(spark, "order_reviews", ("r1", "o1", 5, " ", "good\nbook", date(2018, 1, 11), ts(1, 12)), ("r2", "o1", 1, None, "", date(2018, 1, 11), None), ("r3", "o2", 3, "t", None, date(2018, 2, 6), None), ("r4", "o3", 9, None, None, None, None)),
        "products": raw(spark, "products", ("p1", "Beleza ", 1, 1, 1, d("100.00"), d("1.00"), d("1.00"), d("1.00")), ("p2", "nada", 1, 1, 1, d("0.00"), None, None, None), ("p3", None, 1, 1, 1, None, None, None, None)),
        "sellers": raw(spark, "sellers", ("s1", "01000", "d'oeste", "sp")),
        "category_names": raw(spark, "category_names", ("beleza", "beauty")),
    }


def test_functions(spark):
    df = spark.createDataFrame([("mogi-guacu",), (" são PAULO",), ("d'oeste",), ("a.b (c)",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(fn.initcap_words("c")).collect()] == ["Mogi-Guacu", " São Paulo", "D'oeste", "A.B (C)", "", None]
    one = spark.range(1).select(
        fn.blank_to_null(F.lit("  ")).alias("a"), fn.date_key(F.lit("2017-10-01").cast("date")).alias("b"), fn.days_between(F.lit("2017-01-01 23:00:00").cast("timestamp"), F.lit("2017-01-02 01:00:00").cast("timestamp")).alias("c"),
        fn.row_hash(F.lit("x"), F.lit(None).cast("string")).alias("d"), fn.pass_rate(F.lit(0), F.lit(0)).alias("e"), fn.pass_rate(F.lit(3), F.lit(1)).alias("f"), fn.differs(F.lit(""), F.lit(None).cast("string")).alias("g"),
    ).first()
    assert (one.a, one.b, one.c, one.e, one.f, one.g) == (None, 20171001, 1, None, Decimal("66.667"), False) and len(one.d) == 64


def test_csv_load_rejects_and_audit(spark, tmp_path):
    text = 'a,b,c,d,e,f,g\r\nr1,o1,5,N/A,"two\nlines, ""quoted""",2018-01-01,2018-01-02 03:04:05\r\nr2,o2,five,,,,\r\nr3,o3,NA,null,NULL,,\r\n' + "r" * 60 + ",o4,1,,,,\r\n"
    with gzip.open(tmp_path / "reviews.csv.gz", "wt", newline="") as f:
        f.write(text)
    got = load_csv(spark, str(tmp_path), "order_reviews", F.lit("2018-01-01").cast("timestamp"))
    good = {r.review_id: r for r in got.rows.collect()}
    assert set(good) == {"r1", "r3"} and good["r1"].review_message == 'two\nlines, "quoted"' and good["r1"].review_title is None
    assert good["r3"].review_score is None and good["r3"]._source_file == "reviews.csv.gz" and good["r3"]._row_hash
    assert sorted(tuple(r._wrong) for r in got.rejects.collect()) == [("review_id",), ("review_score",)]
    assert [tuple(r)[2:] for r in load_audit(got, "order_reviews").collect()] == [(2, 2)]
    assert list_files(spark, str(tmp_path)).count() == 1
    log = Store(spark, str(tmp_path / "log"))
    record_load(log, got, "order_reviews")
    assert [(r.loaded, r.rejected) for r in load_history(log).collect()] == [(2, 2)] and load_history(log, hours=-1).count() == 0
    # A stream of the same files has the same rows and the same rejects.
    stream = stream_csv(spark, str(tmp_path), "order_reviews")
    rows, bad = [], []
    P.follow(stream.rows, str(tmp_path / "cp1"), lambda df, n: rows.extend(df.collect()))
    P.follow(stream.rejects, str(tmp_path / "cp2"), lambda df, n: bad.extend(df.collect()))
    assert {r.review_id: r._row_hash for r in rows} == {k: r._row_hash for k, r in good.items()}
    assert sorted(tuple(r._wrong) for r in bad) == [("review_id",), ("review_score",)]


def test_row_hash_tells_cells_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "b"), ("a", "\\b"), (None, "x"), ("∅", "x")], "a string, b string")
    assert df.select(fn.row_hash(F.col("a"), F.col("b")).alias("h")).distinct().count() == 6


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not s.exists("t")
    s.write("t", spark.range(3))
    old = s.read("t")
    s.append("t", spark.range(2))
    assert old.count() == 3 and s.read("t").count() == 5
    s.write("t", s.read("t").filter("id = 0"))
    s.write("t", s.read("t"))
    assert old.count() == 3 and s.read("t").count() == 2 and len(s.versions("t")) == 4
    s.vacuum("t", keep=2)
    assert s.read("t").count() == 2 and len(s.versions("t")) == 2 and s.tables() == ["t"] and s.show().count() == 1
    with pytest.raises(ConcurrentWrite):
        s._commit("t", s.versions("t")[-1], [])
    assert s.schema("marts").root.endswith("/marts") and not s.schema("marts").exists("t")


def test_store_replaces_only_the_partitions_it_is_given(spark, tmp_path):
    s, by = Store(spark, str(tmp_path)), F.col("m")
    s.write("t", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id int, m int"), by)
    before = {x["partition"]: x["path"] for x in s._folders("t", 0)}
    assert set(before) == {"1", "2", "none"} and {r.id for r in s.partitions("t", ["1", "9"]).collect()} == {1, 2} and s.partitions("t", ["9"]).count() == 0
    s.replace("t", spark.createDataFrame([(1, 1), (9, 3)], "id int, m int"), by, ["1", "3"])
    after = {x["partition"]: x["path"] for x in s._folders("t", 1)}
    assert after["2"] == before["2"] and after["none"] == before["none"] and after["1"] != before["1"]
    assert {r.id for r in s.read("t").collect()} == {1, 3, 4, 9} and s.read("t", 0).count() == 4
    s.replace("t", s.read("t").limit(0), by, ["2"])
    assert {r.id for r in s.read("t").collect()} == {1, 4, 9}


def test_staging(spark, world):
    s = staging.stage(world)
    c = {r.customer_id: r for r in s["customers"].collect()}
    assert set(c) == {"c1", "c2", "c3"} and c["c1"].city == "Sao Paulo" and c["c2"].city == "Mogi-Guacu" and c["c3"]._loaded_at == T1
    g = {r.zip_code_prefix: r for r in s["geolocation"].collect()}
    assert (g["01000"].city, g["01000"].lat, g["01000"].lng, g["03000"].lat) == ("A", 2.0, 3.0, None)
    o = {r.order_id: r for r in s["orders"].collect()}
    assert set(o) == {"o1", "o2", "o3", "o4", "o5"} and [o[k].is_late for k in ("o1", "o2", "o3")] == [False, True, None]
    assert (o["o1"].delivery_delay_days, o["o2"].delivery_delay_days) == (0, 1)
    i = s["order_items"].collect()
    assert sorted((r.order_id, r.order_item_id, r.total_item_amt) for r in i) == [("o1", 1, Decimal("110.00")), ("o2", 1, Decimal("110.00")), ("o3", 1, Decimal("20.00")), ("o9", 1, Decimal("5.00"))]
    p = {r.order_id: r for r in s["order_payments"].collect()}
    assert p["o3"].payment_sequential == 1 and p["o3"].is_boleto and p["o2"].is_voucher and "o4" not in p
    r = {x.order_id: x for x in s["order_reviews"].collect()}
    assert r["o1"].review_id == "r1" and r["o1"].has_comment and r["o1"].review_title is None and not r["o2"].has_comment and "o3" not in r
    pr = {x.product_id: x for x in s["products"].collect()}
    assert pr["p1"].category_name_en == "beauty" and pr["p2"].category_name_en is None and len(pr) == 3
    f = staging.stage(world, flagged=True)
    assert f["customers"].filter("_is_duplicate").count() == 1 and f["order_items"].count() == 7
    assert R.flag_all_copies(f["customers"].drop("_is_duplicate"), ["customer_id"]).filter("_is_duplicate").count() == 2


def test_quality_log(spark, world):
    stg = quality.flagged(staging.stage(world, flagged=True))
    log = {r.check_name: r for r in quality.all_checks(stg, F.lit("2018-01-01")).collect()}
    assert len(log) == 7 + 6 + 7 + 9
    failed = {n: r.failed for n, r in log.items() if r.failed}
    assert failed["DEDUP_CUSTOMERS"] == 1 and failed["REF_ORDERS_TO_CUSTOMER"] == 1 and failed["REF_ORDER_ITEMS_TO_SELLER"] == 1 and failed["REF_ORDER_ITEMS_TO_ORDER"] == 1
    assert failed["VALID_PRODUCTS"] == 1 and failed["VALID_ORDERS"] == 2 and failed["INSTALLMENTS_OUT_OF_RANGE"] == 1 and failed["FREIGHT_EXCEEDS_PRICE"] == 1
    assert failed["ORDERS_WITHOUT_PAYMENT"] == 2 and failed["ORDERS_WITHOUT_ITEMS"] == 2 and failed["DELIVERED_NULL_TIMESTAMP"] == 1
    assert failed["TIMESTAMP_INVERSION_APPROVED_BEFORE_PURCHASE"] == 1 and failed["TIMESTAMP_INVERSION_DELIVERED_BEFORE_CARRIER"] == 1
    assert all(r.result == ("FAIL" if r.failed else "PASS") and r.failed <= r.total for r in log.values())
    empty = quality.run_checks(spark.createDataFrame([], "a int"), [quality.Check("E", "t", "RANGE", F.col("a") > 0)], F.lit("2018-01-01")).first()
    assert (empty.result, empty.total, empty.failed, empty.pass_rate) == ("PASS", 0, 0, None)
    boards = quality.dashboard(quality.all_checks(stg, F.lit("2018-01-01")))
    assert boards["full"].count() == 29 and boards["failed"].count() == len(failed) and boards["by_type"].count() == 5
    r = {x.order_id: x.mismatch for x in quality.reconciliation(stg["order_items"].filter("not _is_duplicate"), stg["order_payments"]).collect()}
    assert r["o2"] is True and r["o1"] is False and r["o9"] is True


def test_surrogate_keys_are_dense(spark):
    df = spark.createDataFrame([(x,) for x in "dbcae"], "k string")
    assert [tuple(r) for r in R.allocate_keys(df, "sk", ["k"], 10).orderBy("sk").collect()] == [(11 + i, c) for i, c in enumerate("abcde")]
    assert R.allocate_keys(df.limit(0), "sk", ["k"]).count() == 0


def test_surrogate_keys_are_dense_beyond_the_sample_of_ranges(spark):
    n = 500_000
    rows = spark.range(n).select((F.xxhash64("id") % 1_000_000_007).alias("k"), "id").repartition(9)
    keyed = R.allocate_keys(rows.union(rows.filter("id < 1000")), "sk", ["k", "id"], 5).persist()
    assert tuple(keyed.agg(F.count("*"), F.countDistinct("sk"), F.min("sk"), F.max("sk")).first()) == (n + 1000, n + 1000, 6, n + 1005)
    w = Window.partitionBy(F.floor(F.col("sk") / 1000)).orderBy("sk")
    assert keyed.withColumn("before", F.lag("k").over(w)).filter("before > k").count() == 0


def test_upsert_branches_and_rerun(spark):
    kind = "k int, price int, note string, sk int"
    target = spark.createDataFrame([(1, 10, "a", 7), (2, 20, "b", 8), (3, None, "c", 9)], kind)
    source = spark.createDataFrame([(1, 10, "x", 0), (2, 21, "y", 0), (3, None, "z", 0), (4, 40, "w", 1)], kind)
    once = R.upsert(target, source, ["k"], change=["price"], update=["price", "note"])
    want = [(1, 10, "a", 7), (2, 21, "y", 8), (3, None, "c", 9), (4, 40, "w", 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, R.upsert(once, source, ["k"], change=["price"], update=["price", "note"]).collect())) == want
    assert sorted(map(tuple, R.upsert(target, source.limit(0), ["k"]).collect())) == sorted(map(tuple, target.collect()))


def test_snapshot_diff(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b"), (3, None)], [(2, "c"), (3, None), (4, "d")]))
    got = sorted((r.k, r.v, r._action, r._is_update) for r in R.snapshot_diff(old, new, ["k"]).collect())
    assert got == [(1, "a", "DELETE", False), (2, "b", "DELETE", True), (2, "c", "INSERT", True), (4, "d", "INSERT", False)]


def test_versions_have_no_gap(spark):
    kind = "k string, city string, start_date date, end_date date, is_current boolean"
    dim = spark.createDataFrame([("u1", "A", date(2018, 1, 1), None, True), ("u2", None, date(2018, 1, 1), None, True)], kind)
    batch = spark.createDataFrame([("u1", "B"), ("u2", ""), ("u3", "C")], "k string, city string")
    out = R.scd2_apply(dim, batch, "k", ["city"], F.lit("2018-06-01").cast("date"))
    assert sorted((r.k, r.city or "", str(r.start_date), str(r.end_date), r.is_current) for r in out.collect()) == [
        ("u1", "A", "2018-01-01", "2018-06-01", False), ("u1", "B", "2018-06-01", "None", True), ("u2", "", "2018-01-01", "None", True), ("u3", "C", "2018-06-01", "None", True),
    ]
    days = spark.createDataFrame([("u1", date(2018, 5, 31)), ("u1", date(2018, 6, 1))], "c string, d date")
    assert sorted((str(r.d), r.city) for r in R.as_of(days, out, {"c": "k"}, F.col("d")).collect()) == [("2018-05-31", "A"), ("2018-06-01", "B")]


def test_marts(spark, world):
    stg = staging.stage(world)
    dims = marts.build_dims(stg, F.lit("2019-01-01").cast("date"))
    people = {r.customer_unique_id: r for r in dims["customers"].collect()}
    assert set(people) == {"u1", "u2"} and people["u1"].start_date == date(2018, 1, 1) and people["u1"].city == "Sao Paulo"
    assert {r.product_id for r in dims["products"].collect()} == {"p1", "p3"}
    dims["products"] = dims["products"].withColumn("start_date", F.lit("2018-01-01").cast("date"))
    items = marts.fact_items(stg, dims)
    assert sorted((r.order_id, r.purchase_date_key) for r in items.collect()) == [("o1", 20180101), ("o2", 20180201)]
    assert {r.order_id for r in marts.unresolved(stg, items).collect()} == {"o3", "o9"}
    assert marts.fact_payments(stg, dims).count() == 3
    assert {r.order_id: r.answered_date_key for r in marts.fact_reviews(stg, dims).collect()} == {"o1": 20180112, "o2": 20180206}


def test_pipeline_run_to_run(spark, world, tmp_path):
    store = Store(spark, str(tmp_path))
    stg = staging.stage(world)
    P.initial_load(store, stg, "2018-01-01")
    keys = {r.customer_unique_id: r.customer_key for r in store.read("dim_customers").collect()}
    graph = P.warehouse_graph(store, TODAY)
    # Nothing new: every task but root and audit is skipped.
    state = {"batch": {}, "stg": stg}
    done = graph.run_once(state)
    assert done["root"] == done["audit"] == "SUCCEEDED" and {done[t] for t in ("customers", "items", "reviews")} == {"SKIPPED"}
    # One person moves by a new customer row, an order progresses, a late line and a new review arrive.
    more = dict(world)
    more["customers"] = world["customers"].unionByName(raw(spark, "customers", ("c9", "u1", "09000", "belem", "pa", T1), ("c8", "u7", "1", "x", "y", T1)))
    more["orders"] = world["orders"].unionByName(raw(spark, "orders", ("o7", "c9", "created", datetime(2018, 6, 1), None, None, None, None, T1), ("o2", "c2", "canceled", datetime(2018, 2, 1), None, None, None, None, T1)))
    more["order_items"] = world["order_items"].unionByName(raw(spark, "order_items", ("o7", 1, "p1", "s1", None, Decimal("9.00"), Decimal("1.00"), T1)))
    more["sellers"] = world["sellers"].unionByName(raw(spark, "sellers", ("s1", "02000", "campinas", "sp", T1), ("s2", "1", "x", "y", T1)))
    now = staging.stage(more)
    batch = {t: now[t].join(stg[t].select("_row_hash", *schemas.KEYS[t], "_loaded_at"), [*schemas.KEYS[t], "_row_hash", "_loaded_at"], "left_anti") for t in ("customers", "orders", "order_items", "sellers")}
    state = {"batch": batch, "stg": now}
    done = graph.run_once(state)
    assert "errors" not in state, state.get("errors")
    assert done["customers"] == done["items"] == done["sellers"] == "SUCCEEDED" and done["products"] == "SKIPPED" and state["audit"].startswith("SUCCESS")
    dim = store.read("dim_customers").collect()
    u1 = sorted((str(r.start_date), r.city, r.is_current) for r in dim if r.customer_unique_id == "u1")
    assert u1 == [("2018-01-01", "Sao Paulo", False), (TODAY, "Belem", True)]
    assert {r.customer_key for r in dim if r.customer_unique_id == "u2"} == {keys["u2"]} and len({r.customer_key for r in dim}) == len(dim)
    facts = {r.order_id: r for r in store.read("fact_items").collect()}
    assert facts["o2"].order_status == "CANCELED" and facts["o1"].customer_key == keys["u1"] and facts["o7"].customer_key not in keys.values()
    assert {r.seller_id: (r.seller_key, r.city) for r in store.read("dim_sellers").collect()} == {"s1": (1, "Campinas"), "s2": (2, "X")}
    check = marts.verify({n: store.read(f"dim_{n}") for n in ("customers",)}, {"items": store.read("fact_items")})
    assert check == {"not_one_current": 0, "orphans": 0, "late": 0}
    # The same batch again changes nothing.
    before = sorted(map(tuple, store.read("fact_items").collect()))
    graph.run_once({"batch": batch, "stg": now})
    assert sorted(map(tuple, store.read("fact_items").collect())) == before and store.read("dim_customers").count() == len(dim)
    assert store.read("aud_pipeline_runs").count() == 9 and P.monthly_revenue_by_state(spark, store).count() == 2
    # The audit looks at its window alone, and every run of a task is on record.
    assert P.audit_run(store, -60.0) == "SUCCESS | loaded=0" and P.run_history(store).filter("duration_secs >= 0").count() == 12
    store.append("fact_reviews", store.read("fact_reviews").limit(1).withColumn("review_score", F.lit(9)).withColumn("_loaded_at", F.current_timestamp()), marts.month_of("reviews"))
    assert P.audit_run(store, 6).startswith("PARTIAL") and "BAD_REVIEW_SCORE=1" in P.run_history(store).filter("status = 'PARTIAL'").first().notes
    assert P.task_history(store).filter("state = 'SUCCEEDED' AND task = 'audit'").count() == 3
    # Months that a run does not touch keep their folders.
    folders = lambda n: {x["partition"]: x["path"] for x in store._folders("fact_items", n)}
    first, last = folders(0), folders(store.versions("fact_items")[-1])
    assert set(first) == {"201801", "201802"} and last["201801"] == first["201801"] and last["201802"] != first["201802"] and "201806" in last
    late = marts.merge_fact(store.read("fact_items"), marts.fact_items(now, {n: store.read(f"dim_{n}") for n in ("customers", "products", "sellers", "geography")}, late=True), "items")
    assert late.filter("_is_late_arriving").count() == 0


def test_graph_guards():
    def broken(state):
        raise RuntimeError("no")

    g = P.Graph([P.Task("a", broken), P.Task("b", lambda s: None, ("a",)), P.Task("c", lambda s: None)])
    state = {}
    assert g.run_once(state) == {"a": "FAILED", "c": "SUCCEEDED", "b": "BLOCKED"} and state["errors"] == {"a": "no"}
    g.suspend()
    assert g.run_once({}) == {} and len(g.history) == 3
    g.resume()
    g.suspend("a")
    assert g.run_once({}) == {"a": "SUSPENDED", "c": "SUCCEEDED", "b": "SUCCEEDED"} and [x["active"] for x in g.show()] == [False, True, True]
    made = []
    assert g.schedule(0.05, lambda: made.append(1) or {}, runs=3) == 3 and len(made) == 3
    with pytest.raises(ValueError):
        P.Graph([P.Task("a", broken, ("b",)), P.Task("b", broken, ("a",))]).order()


def test_stream_of_files_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    src.mkdir()
    head = "seller_id,zip,city,state\n"

    def handle(batch, number):
        known = out.read("sellers") if out.exists("sellers") else None
        rows = staging.clean_sellers(batch if known is None else batch.unionByName(known.select(batch.columns)))
        out.write("sellers", rows.withColumn("_source_file", F.lit("")))

    for k, body in enumerate(("s1,1,a,sp\ns2,2,b,sp\n", "s1,9,z,rj\ns3,3,c,sp\n")):
        (src / f"{k}.csv").write_text(head + body)
        P.follow(stream_csv(spark, str(src), "sellers").rows, str(tmp_path / "cp"), handle)
    assert {r.seller_id: r.city for r in out.read("sellers").collect()} == {"s1": "Z", "s2": "B", "s3": "C"}
    assert P.committed_at(spark, str(tmp_path / "cp")) is not None and P.committed_at(spark, str(tmp_path / "no")) is None


def test_stream_joins_static_tables_and_starts_again_where_it_failed(spark, world, tmp_path):
    src, stg = tmp_path / "in", staging.stage(world)
    src.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    dims = {n: store.write(n, d) for n, d in marts.build_dims(stg, F.lit("2018-01-01").cast("date")).items()}
    head = "order_id,order_item_id,product_id,seller_id,shipping_limit,price,freight\n"
    lines = stream_csv(spark, str(src), "order_items").rows
    total = F.col("price_amt") + F.col("freight_amt")
    facts = marts.fact_items(stg | {"order_items": lines.withColumn("total_item_amt", total.cast("decimal(12,2)"))}, dims)
    got, broken = [], [True]

    def handle(batch, number):
        if broken and broken.pop():
            raise RuntimeError("the first try fails")
        got.extend((number, r.order_id, r.order_item_id, r.customer_key is not None) for r in batch.collect())

    (src / "1.csv").write_text(head + "o1,7,p1,s1,,10.00,1.00\no9,1,p1,s1,,10.00,1.00\n")
    with pytest.raises(Exception, match="first try"):
        P.follow(facts, str(tmp_path / "cp"), handle)
    assert not got
    P.follow(facts, str(tmp_path / "cp"), handle)
    (src / "2.csv").write_text(head + "o2,8,p1,s1,,5.00,1.00\n")
    P.follow(facts, str(tmp_path / "cp"), handle)
    assert got == [(0, "o1", 7, True), (1, "o2", 8, True)]


def test_staged_tables_are_refreshed_when_raw_tables_change(spark, world, tmp_path):
    raw_store, store = Store(spark, str(tmp_path / "raw")), Store(spark, str(tmp_path / "stg"))
    for name, rows in world.items():
        raw_store.write(name, rows)
    staged = P.StagedTables(store, raw_store, lag=60)
    assert staged.refresh(now=1000) and not staged.refresh(now=2000)
    raw_store.append("sellers", raw(spark, "sellers", ("s7", "1", "x", "y")))
    assert not staged.refresh(now=1030) and staged.refresh(now=1061)
    assert {r.seller_id for r in store.read("sellers").collect()} == {"s1", "s7"}


def test_declared_marts_take_no_null_keys(spark):
    good = spark.createDataFrame([(1, "s1", None, None, None)], "seller_key bigint, seller_id string, zip_code_prefix string, city string, state string")
    assert schemas.declared(good, "dim_sellers").count() == 1
    with pytest.raises(Exception, match="dim_sellers.seller_id is null"):
        schemas.declared(good.withColumn("seller_id", F.lit(None).cast("string")), "dim_sellers").collect()


def test_event_windows_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "ev"))
    out = []
    stream = P.event_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")))
    P.follow(stream, str(tmp_path / "cp"), lambda df, n: out.extend(df.collect()))
    from loomfield.plans import catalogue

    want = {(r.window_start.replace(tzinfo=None), r.event_type): r.n for r in catalogue.queries()["events_tumbling_window"](spark, sf).collect()}
    got = {(r.window_start.replace(tzinfo=None), r.event_type): r.n for r in out}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) < 60
