"""Staged tables that follow their raw tables by what was added to these.

A staged table is parted by a hash of its business key. A refresh reads the rows that appends have added to
the raw tables since the last one, cleans these alone, and merges them into the parts their keys are in;
other parts keep their files, and raw history is not read again. How far a raw table has been taken is
committed with the staged rows, so a refresh that is cut off goes on where it stopped. A raw table that was
written anew is staged anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators import staging
from loomfield.sources.store import Store

C = F.col
CLEAN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "customers": staging.clean_customers, "orders": staging.clean_orders, "order_items": staging.clean_items,
    "order_payments": staging.clean_payments, "order_reviews": staging.clean_reviews, "sellers": staging.clean_sellers,
}


@dataclass
class FollowingTables:
    """Staged tables in ``store`` that follow the raw tables in ``raw``."""

    store: Store
    raw: Store
    parts: int = 64
    lag: float = 60.0

    def _part(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")

    def _added(self, name: str, source: str) -> tuple[DataFrame | None, int]:
        """What the raw table has more than the staged one has seen; None where that is to be made anew."""
        now = self.raw.versions(source)[-1]
        seen = self.store.marks(name).get(source, -1)
        return (self.raw.added(source, seen) if seen != now else self.raw.read(source).limit(0)), now

    def _merge(self, name: str, new: DataFrame, part: Column, put: Callable[[DataFrame], DataFrame], marks: dict[str, int]) -> bool:
        """Merge new rows into the parts they touch; whether there were any."""
        new = new.persist()
        try:
            touched = [str(r["p"]) for r in new.select(part.alias("p")).distinct().collect()]  # ``parts`` numbers at most
            merged = put(self.store.partitions(name, touched).unionByName(new))
            self.store.replace(name, merged, part, touched, marks)
            return bool(touched)
        finally:
            new.unpersist()

    def _follow(self, name: str, source: str, clean: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame], DataFrame], keys: list[str]) -> bool:
        part = self._part(*keys)
        added, now = self._added(name, source)
        if not self.store.exists(name) or added is None:
            self.store.write(name, clean(self.raw.read(source)), part, {source: now})
            return True
        if self.store.marks(name)[source] == now:
            return False
        return self._merge(name, clean(added), part, put, {source: now})

    def _products(self) -> bool:
        """Products follow two tables: their own rows, and the names of their categories."""
        name, part = "products", self._part("product_id")
        (rows, now), (renamed, now_names) = self._added(name, "products"), self._added(name, "category_names")
        marks, names = {"products": now, "category_names": now_names}, self.raw.read("category_names")
        if not self.store.exists(name) or rows is None or renamed is None:
            self.store.write(name, staging.clean_products(self.raw.read("products"), names), part, marks)
            return True
        if self.store.marks(name) == marks:
            return False
        staged, all_names = self.store.read(name), staging.category_names(names)
        changed = staging.category_names(renamed).select("_k")
        again = staged.join(changed, staged["category_name_pt"] == C("_k"), "left_semi").drop("category_name_en")
        named = again.join(all_names, C("category_name_pt") == C("_k"), "left").select(staged.columns)
        new = staging.clean_products(rows, names).unionByName(named)

        def put(both: DataFrame) -> DataFrame:
            # A product stands there in its old and its new name: the rows are equal but for that.
            kept = staging.latest(name, both.drop("category_name_en").dropDuplicates(["product_id", "_loaded_at", "_row_hash"]))
            return kept.join(all_names, C("category_name_pt") == C("_k"), "left").select(staged.columns)

        return self._merge(name, new, part, put, marks)

    def refresh(self, now: float | None = None) -> list[str]:
        """Bring all tables up to their raw tables, if the lag has passed; the names of those that got rows."""
        now = time.time() if now is None else now
        if self.store.exists("refreshes") and now - (self.store.read("refreshes").agg(F.max("at")).first()[0]) < self.lag:
            return []
        done = []
        for name, clean in CLEAN.items():
            if self._follow(name, name, clean, lambda rows, n=name: staging.latest(n, rows), staging.LATEST[name]):
                done.append(name)
        if self._products():
            done.append("products")
        if self._follow("geo_parts", "geolocation", staging.geo_parts, staging.geo_added, ["zip_code_prefix"]):
            done.append("geolocation")
        self.store.append("refreshes", self.store.spark.createDataFrame([(float(now), ",".join(done))], "at double, tables string"))
        return done

    def read(self, name: str) -> DataFrame:
        """A staged table; the centers of places are made from their sums."""
        return staging.geo_centers(self.store.read("geo_parts")) if name == "geolocation" else self.store.read(name)
