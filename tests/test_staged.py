"""Staged tables that follow what was added: equal to staging everything, and only touched parts are written."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest

from loomfield import schemas
from loomfield.operators import staging
from loomfield.sources.store import Store
from loomfield.streaming.staged import FollowingTables

from test_warehouse import T1, raw, world  # noqa: F401

T2 = datetime(2018, 1, 3)
NAMES = ["customers", "geolocation", "orders", "order_items", "order_payments", "order_reviews", "products", "sellers"]


@pytest.fixture
def tables(spark, world, tmp_path):  # noqa: F811
    raws, store = Store(spark, str(tmp_path / "raw")), Store(spark, str(tmp_path / "stg"))
    for name in schemas.RAW:
        raws.write(name, world[name])
    return raws, FollowingTables(store, raws, parts=8, lag=60)


def same(raws, staged):
    want = staging.stage({n: raws.read(n) for n in schemas.RAW})
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for name in NAMES:
        assert key(staged.read(name)) == key(want[name]), name


def test_refreshes_are_equal_to_staging_everything(spark, tables):
    raws, staged = tables
    assert sorted(staged.refresh(now=0)) == sorted(NAMES)
    same(raws, staged)
    assert staged.refresh(now=30) == [] and staged.refresh(now=100) == []
    ts = lambda m, day: datetime(2018, m, day)
    raws.append("sellers", raw(spark, "sellers", ("s1", "9", "new place", "rj", T1), ("s7", "1", "x", "y")))
    raws.append("order_reviews", raw(spark, "order_reviews", ("r9", "o1", 2, "t", "m", None, ts(1, 20), T1), ("r8", "o2", 4, None, None, None, None, T1)))
    raws.append("order_items", raw(spark, "order_items", ("o1", 1, "p2", "s1", None, D("7.00"), D("1.00"), T2), ("o7", 1, "p1", "s1", None, D("1.00"), D("0.00"), T2)))
    raws.append("geolocation", raw(spark, "geolocation", ("01000", 5.0, 6.0, "b", "sp"), ("07000", 1.0, 1.0, "z", "sp")))
    assert staged.refresh(now=130) == []  # the lag has not passed
    assert sorted(staged.refresh(now=300)) == ["geolocation", "order_items", "order_reviews", "sellers"]
    same(raws, staged)
    # Several loads at once, an older row that comes late, and nothing for the other tables.
    raws.append("customers", raw(spark, "customers", ("c1", "u1", "5", "late", "sp", datetime(2017, 1, 1))))
    raws.append("customers", raw(spark, "customers", ("c9", "u9", "5", "b", "sp", T2)))
    raws.append("orders", raw(spark, "orders", ("o4", "c3", "delivered", ts(4, 1), None, None, ts(4, 9), date(2018, 4, 5), T2)))
    assert sorted(staged.refresh(now=1000)) == ["customers", "orders"]
    same(raws, staged)


def test_only_touched_parts_are_written(spark, tables):
    raws, staged = tables
    staged.refresh(now=0)
    raws.append("customers", raw(spark, "customers", *[(f"c{k}", f"u{k}", "1", "x", "sp") for k in range(100, 160)]))
    staged.refresh(now=100)
    folders = lambda: {x["partition"]: x["path"] for x in staged.store._folders("customers", staged.store.versions("customers")[-1])}
    before = folders()
    raws.append("customers", raw(spark, "customers", ("c100", "u100", "2", "moved", "sp", T2)))
    assert staged.refresh(now=200) == ["customers"]
    changed = {p for p, path in folders().items() if before.get(p) != path}
    assert len(before) == 8 and len(changed) == 1
    same(raws, staged)


def test_new_names_of_categories_reach_their_products(spark, tables):
    raws, staged = tables
    staged.refresh(now=0)
    raws.append("category_names", raw(spark, "category_names", ("beleza", "health", T1), ("nada", "none", T1)))
    raws.append("products", raw(spark, "products", ("p1", "nada", 1, 1, 1, D("5.00"), None, None, None, T2), ("p4", "beleza", 1, 1, 1, None, None, None, None, T2)))
    assert staged.refresh(now=100) == ["products"]
    same(raws, staged)
    raws.append("category_names", raw(spark, "category_names", ("beleza", "beauty again", T2)))
    assert staged.refresh(now=200) == ["products"]
    same(raws, staged)


def test_a_raw_table_written_anew_is_staged_anew_and_a_refresh_goes_on(spark, tables, monkeypatch):
    raws, staged = tables
    staged.refresh(now=0)
    raws.write("sellers", raw(spark, "sellers", ("s2", "1", "x", "y")))
    raws.append("customers", raw(spark, "customers", ("c9", "u9", "5", "b", "sp", T2)))
    replace = Store.replace

    def broken(self, table, *args):
        replace(self, table, *args)
        raise RuntimeError("cut off")

    monkeypatch.setattr(Store, "replace", broken)
    with pytest.raises(RuntimeError):
        staged.refresh(now=100)
    monkeypatch.undo()
    assert staged.refresh(now=100) == ["sellers"]  # the customers were done
    same(raws, staged)
