"""Incremental pipeline: a graph of tasks over micro-batches of changed tables, with an audit at its end."""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield import schemas
from loomfield.functions import seconds_between
from loomfield.operators import marts
from loomfield.operators.dates import calendar
from loomfield.operators.quality import Check, run_checks
from loomfield.operators.staging import stage
from loomfield.sources.store import NO_VALUE, Store

C = F.col
#: The window of the audit: a period of five minutes and one more.
AUDIT_MINUTES = 6


@dataclass
class Task:
    name: str
    run: Callable[[dict], object]
    after: tuple[str, ...] = ()
    when: Callable[[dict], bool] = lambda state: True
    active: bool = True


@dataclass
class Graph:
    """Tasks in dependency order; a task whose guard says no, or that is suspended, is skipped, one whose parent failed too.

    With a ``store`` every run is added to its table ``task_history``.
    """

    tasks: list[Task]
    active: bool = True
    history: list[dict] = field(default_factory=list)
    store: Store | None = None

    def order(self) -> list[Task]:
        todo, done, out = {t.name: t for t in self.tasks}, set(), []
        while todo:
            ready = [t for t in todo.values() if set(t.after) <= done]
            if not ready:
                raise ValueError(f"tasks wait for each other or for unknown ones: {sorted(todo)}")
            for t in ready:
                out.append(todo.pop(t.name))
                done.add(t.name)
        return out

    def _set(self, active: bool, names: tuple[str, ...]) -> None:
        if not names:
            self.active = active
        for t in self.tasks:
            if t.name in names:
                t.active = active

    def suspend(self, *names: str) -> None:
        """Suspend these tasks; without a name, the whole graph."""
        self._set(False, names)

    def resume(self, *names: str) -> None:
        self._set(True, names)

    def show(self) -> list[dict]:
        return [{"task": t.name, "after": list(t.after), "active": self.active and t.active} for t in self.order()]

    def run_once(self, state: dict, scheduled_at: datetime | None = None) -> dict[str, str]:
        """One run: name to SUCCEEDED, SKIPPED, SUSPENDED, FAILED or BLOCKED."""
        found: dict[str, str] = {}
        run, rows = uuid.uuid4().hex, []
        for t in self.order() if self.active else ():
            began, said, error = datetime.now(timezone.utc), None, None
            try:
                if any(found[a] in ("FAILED", "BLOCKED") for a in t.after):
                    found[t.name] = "BLOCKED"
                elif not t.active:
                    found[t.name] = "SUSPENDED"
                elif not t.when(state):
                    found[t.name] = "SKIPPED"
                else:
                    said = t.run(state)
                    found[t.name] = "SUCCEEDED"
            except Exception as e:
                found[t.name], error = "FAILED", str(e)
                state.setdefault("errors", {})[t.name] = error
            ended = datetime.now(timezone.utc)
            rows.append(
                {
                    "run_id": run, "task": t.name, "state": found[t.name], "scheduled_at": scheduled_at or began, "started_at": began, "ended_at": ended,
                    "seconds": (ended - began).total_seconds(), "said": said if isinstance(said, str) else None, "error": error,
                }
            )
        self.history += rows
        if self.store and rows:
            kinds = "run_id string, task string, state string, scheduled_at timestamp, started_at timestamp, ended_at timestamp, seconds double, said string, error string"
            self.store.append("task_history", self.store.spark.createDataFrame(rows, kinds))
        return found

    def schedule(self, seconds: float, state: Callable[[], dict], runs: int | None = None, stop: threading.Event | None = None) -> int:
        """Run every so many seconds until ``stop`` is set or ``runs`` are done; runs never overlap, and slots that pass meanwhile are left out."""
        stop, done, slot = stop or threading.Event(), 0, time.time()
        while not stop.is_set() and (runs is None or done < runs):
            self.run_once(state(), datetime.fromtimestamp(slot, timezone.utc))
            done += 1
            slot += seconds * max(1, math.ceil((time.time() - slot) / seconds))
            if runs is None or done < runs:
                stop.wait(max(0.0, slot - time.time()))
        return done


def task_history(store: Store, hours: float = 1, limit: int = 100) -> DataFrame:
    """Runs of tasks of the last hours, the latest first."""
    since = F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    return store.read("task_history").filter(C("scheduled_at") >= since).orderBy(C("scheduled_at").desc(), C("started_at").desc()).limit(limit)


def run_history(store: Store, limit: int = 20) -> DataFrame:
    """Pipeline runs with their duration in seconds, the latest first."""
    rows = store.read("aud_pipeline_runs").withColumn("duration_secs", seconds_between(C("started_at"), C("ended_at")))
    return rows.orderBy(C("started_at").desc(), "target").limit(limit)


def has_rows(*tables: str) -> Callable[[dict], bool]:
    return lambda state: any(t in state["batch"] and not state["batch"][t].isEmpty() for t in tables)


def warehouse_graph(store: Store, today: str) -> Graph:
    """One root, three dimensions, three facts and the audit. ``state['batch']`` has staged changes, ``state['stg']`` staged tables."""
    day = F.lit(today).cast("date")

    def customers(state: dict) -> None:
        # The version of a person follows the latest of the person's orders, whichever customer row it came by.
        people = state["batch"]["customers"].select("customer_unique_id").distinct()
        rows = state["stg"]["customers"].join(people, "customer_unique_id", "left_semi")
        store.write("dim_customers", marts.evolve(store.read("dim_customers"), marts.one_per_person(rows, state["stg"]["orders"], True), "customer_key", "customer_unique_id", marts.CUSTOMER_TRACKED, day))

    def products(state: dict) -> None:
        store.write("dim_products", marts.evolve(store.read("dim_products"), state["batch"]["products"], "product_key", "product_id", marts.PRODUCT_TRACKED, day))

    def sellers(state: dict) -> None:
        store.write("dim_sellers", marts.upsert_sellers(store.read("dim_sellers"), state["batch"]["sellers"]))

    def dims() -> dict[str, DataFrame]:
        return {n: store.read(f"dim_{n}") for n in ("customers", "products", "sellers", "geography")}

    def changed(state: dict, table: str) -> dict[str, DataFrame]:
        """The staged table cut to orders that changed themselves or through their rows."""
        keys = [state["batch"][t].select("order_id") for t in (table, "orders") if t in state["batch"]]
        ids = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
        return state["stg"] | {table: state["stg"][table].join(ids.distinct(), "order_id", "left_semi")}

    def fact(name: str, table: str, make: Callable) -> Callable[[dict], None]:
        """Merge what changed into the months that it touches; the other months are neither read whole nor written."""

        def run(state: dict) -> None:
            keys, month = marts.MERGES[name][0], marts.month_of(name)
            source = make(changed(state, table), dims()).persist()
            try:
                target = store.read(f"fact_{name}")
                # Where a key stands now: of the whole table only its keys and its month are read.
                there = target.select(*keys, month.alias("m")).join(source.select(*keys), keys, "left_semi").select("m")
                months = [r["m"] for r in there.union(source.select(month.alias("m"))).distinct().collect()]
                if months:
                    values = [NO_VALUE if m is None else str(m) for m in months]
                    merged = marts.merge_fact(store.partitions(f"fact_{name}", values), source, name)
                    store.replace(f"fact_{name}", merged, month, values)
            finally:
                source.unpersist()

        return run

    def audit(state: dict) -> str:
        state["audit"] = audit_run(store, state.get("minutes", AUDIT_MINUTES))
        return state["audit"]

    all_dims = ("customers", "products", "sellers")
    return Graph(
        [
            Task("root", lambda state: None),
            Task("customers", customers, ("root",), has_rows("customers")),
            Task("products", products, ("root",), has_rows("products")),
            Task("sellers", sellers, ("root",), has_rows("sellers")),
            Task("items", fact("items", "order_items", marts.fact_items), all_dims, has_rows("order_items", "orders")),
            Task("payments", fact("payments", "order_payments", marts.fact_payments), all_dims, has_rows("order_payments", "orders")),
            Task("reviews", fact("reviews", "order_reviews", marts.fact_reviews), all_dims, has_rows("order_reviews", "orders")),
            Task("audit", audit, ("items", "payments", "reviews")),
        ],
        store=store,
    )


def audit_run(store: Store, minutes: float) -> str:
    """Audit what the facts got in the last ``minutes``: spot checks, and a row per fact in the run log; SUCCESS, or PARTIAL if a check failed."""
    spark, began = store.spark, datetime.now(timezone.utc).replace(tzinfo=None)
    at = F.lit(began)
    fresh = lambda t: store.read(t).filter(C("_loaded_at") >= at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(minutes * 60.0)))
    no_key = C("customer_key").isNull() | C("product_key").isNull() | C("seller_key").isNull()
    checks = {
        "fact_items": [
            Check("NULL_SURROGATE_KEYS", "fact_items", "NULL_CHECK", no_key, notes="in the run's window"),
            Check("NEGATIVE_PRICE", "fact_items", "RANGE", C("price_amt") < 0, notes="in the run's window"),
        ],
        "fact_payments": [],
        "fact_reviews": [Check("BAD_REVIEW_SCORE", "fact_reviews", "RANGE", ~C("review_score").between(1, 5), notes="in the run's window")],
    }
    log, rows, run = None, [], uuid.uuid4().hex
    for table, of in checks.items():
        some = fresh(table)
        found = run_checks(some, of, at).collect() if of else []
        loaded = found[0]["total"] if found else some.count()
        rejected = sum(r["failed"] for r in found)
        notes = " ".join(f"{r['check_name']}={r['failed']}" for r in found if r["failed"])
        ended = datetime.now(timezone.utc).replace(tzinfo=None)
        rows.append((run, table, began, ended, loaded, rejected, "SUCCESS" if not rejected else "PARTIAL", notes))
        log = found if log is None else log + found
    store.append("aud_dq_checks", spark.createDataFrame(log, schemas.AUDIT_CHECKS))
    store.append("aud_pipeline_runs", spark.createDataFrame(rows, schemas.AUDIT_RUNS))
    status = "SUCCESS" if all(r[6] == "SUCCESS" for r in rows) else "PARTIAL"
    issues = " ".join(r[7] for r in rows if r[7])
    return f"{status} | loaded={sum(r[4] for r in rows)}" + (f" | {issues}" if issues else "")


def follow(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], every: str | None = None):
    """Run ``handle`` for every micro-batch; the checkpoint's offset moves on once it has returned.

    Without ``every`` what is there now is handled and the query ends; with it (as ``5 minutes``) the
    query goes on and is returned running. The batch is persisted while it is handled, so that every
    step in it sees the same rows.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                handle(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def committed_at(spark: SparkSession, checkpoint: str) -> datetime | None:
    """When the offset of a stream last moved on; its lag is the time since then."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getModificationTime() for x in fs.listStatus(p)] if fs.exists(p) else []
    return datetime.fromtimestamp(max(found) / 1000, timezone.utc) if found else None


@dataclass
class StagedTables:
    """Staged tables kept in the store, made anew from the raw tables when one of these has a new version and the lag has passed."""

    store: Store
    raw: Store
    lag: float = 60.0

    def refresh(self, now: float | None = None) -> bool:
        now = time.time() if now is None else now
        seen = {t: self.raw.versions(t)[-1] for t in schemas.RAW if self.raw.exists(t)}
        last = self.store.read("refreshes").orderBy(C("at").desc()).first() if self.store.exists("refreshes") else None
        if last and (json.loads(last["versions"]) == seen or now - last["at"] < self.lag):
            return False
        for name, rows in stage({t: self.raw.read(t, n) for t, n in seen.items()}).items():
            self.store.write(name, rows)
        self.store.append("refreshes", self.store.spark.createDataFrame([(float(now), json.dumps(seen))], "at double, versions string"))
        return True


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows; rows later than ``late`` are dropped once their window has closed."""
    timed = events.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(C("w.start").alias("window_start"), "event_type", "n", "total")


def initial_load(store: Store, stg: dict[str, DataFrame], today: str) -> None:
    """Dimensions and facts of an empty warehouse, in their declared schemas; facts are parted by month."""
    dims = marts.build_dims(stg, F.lit(today).cast("date"))
    stored = {n: store.write(f"dim_{n}", schemas.declared(d, f"dim_{n}")) for n, d in dims.items()}
    facts = {"items": marts.fact_items(stg, stored), "payments": marts.fact_payments(stg, stored), "reviews": marts.fact_reviews(stg, stored)}
    for n, f in facts.items():
        store.write(f"fact_{n}", schemas.declared(f, f"fact_{n}"), marts.month_of(n))


def monthly_revenue_by_state(spark: SparkSession, store: Store) -> DataFrame:
    """Orders, revenue and mean item value by month and state, canceled orders left out."""
    return marts.revenue_by_month_and_state(store.read("fact_items"), calendar(spark), store.read("dim_customers"))
