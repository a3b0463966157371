"""The model graph and a warehouse that stores each model as a Parquet table once.

Staging is stored as well, so the raw files are scanned once per build. Intermediate
models stay lazy and are inlined into the facts that use them.
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bazarlytics.operators.grouping import has_hot_key
from bazarlytics.plans import dimensions as dim
from bazarlytics.plans import facts as fct
from bazarlytics.plans import intermediate as inter
from bazarlytics.plans import marts as mart
from bazarlytics.plans import staging as stg
from bazarlytics.quality.checks import Check, duplicates, scan_counts
from bazarlytics.session import scratch_path
from bazarlytics.sources.files import append_table, write_table
from bazarlytics.sources.schemas import MODEL_HISTORY

# date filters of the analyses prune whole months
PARTITION_BY = {"fct_orders": "order_month"}

# tables that meet by order lie in buckets of it and are not shuffled again
BUCKET_BY = {
    "stg_orders": "order_id",
    "stg_order_items": "order_id",
    "fct_order_items": "order_id",
    "fct_payments": "order_id",
    "fct_reviews": "order_id",
}


# jobs that write at the same time: a stage with few tasks or a long last one leaves cores to the others
AT_ONCE = 4


class Warehouse:
    """Tables by name; a model is built from its inputs the first time it is asked for."""

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, Callable[[], DataFrame]],
        path: str | None = None,
        as_of: str | None = None,
        dedup_reviews: bool = False,
        checks: Sequence[Check] = (),
        lookup_by: Mapping[str, str] | None = None,
    ):
        """Of the checks, the row and total rules of every model are counted while it is written;
        ``observed`` has their failures by name. ``lookup_by`` names, per model, the column whose
        single values are searched; the model's files are then laid out for it."""
        self.spark = spark
        self.raw = raw
        self.path = path or scratch_path(spark, "warehouse")
        self.as_of = as_of
        self.dedup_reviews = dedup_reviews
        self.checks = checks
        self.lookup_by = lookup_by or {}
        self.observed: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self._stored: dict[str, DataFrame] = {}
        self._sources: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.RLock] = defaultdict(threading.RLock)
        self._guard = threading.Lock()
        self._spent = threading.local()

    def plan(self, name: str) -> DataFrame:
        """A model as a lazy frame over its stored inputs."""
        return MODELS[name](self)

    def __getitem__(self, name: str) -> DataFrame:
        """A model as a table, stored on first use.

        Intermediate models stay lazy, and ``raw_<source>`` is a source as it is read.
        """
        if name.startswith("raw_"):
            return self._raw(name.removeprefix("raw_"))
        if name.startswith("int_"):
            return self.plan(name)
        before, began = getattr(self._spent, "inputs", 0.0), time.monotonic()
        table = self._once(name, lambda: self._timed(name))
        self._spent.inputs = before + time.monotonic() - began  # for the model that asked for this one
        return table

    def _once(self, name: str, write: Callable[[], DataFrame]) -> DataFrame:
        """A stored table; who asks while another thread writes it waits for that thread. A model
        only asks for models before it, so that no two threads wait for each other."""
        with self._guard:
            lock = self._locks[name]
        with lock:
            if name not in self._stored:
                self._stored[name] = write()
            return self._stored[name]

    def _timed(self, name: str) -> DataFrame:
        """Write a model and note its seconds without those of the inputs it had to ask for."""
        self._spent.inputs, began = 0.0, time.monotonic()
        table = self._write(name)
        self.seconds[name] = time.monotonic() - began - self._spent.inputs
        return table

    def together(self, asks: Iterable[Callable[[], object]]) -> None:
        """Make calls that read this warehouse's tables, several at a time, so that models that do
        not wait for each other are written at the same time. Those before others come first."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda ask: ask(), asks))

    def _write(self, name: str) -> DataFrame:
        counts = scan_counts([c for c in self.checks if c.table == name])
        metrics = [F.expr(count).alias(check) for check, count in counts.items()]
        observation = Observation(f"checks_{name}") if metrics else None
        balanced = BALANCED.get(name)
        table = write_table(
            balanced(self) if balanced else self.plan(name), f"{self.path}/{name}",
            PARTITION_BY.get(name), observation, metrics, self.lookup_by.get(name),
            self._bucket_by(name), balanced is not None,
        )
        if observation:
            self.observed.update({k: int(v) for k, v in observation.get.items() if v is not None})
        return table

    def _bucket_by(self, name: str) -> str | None:
        """No buckets where the files are laid out for a lookup."""
        return None if name in self.lookup_by else BUCKET_BY.get(name)

    def observed_checks(self) -> DataFrame:
        """One row (name, failures) per check that the writes have counted so far."""
        rows = sorted(self.observed.items())
        return self.spark.createDataFrame(rows, "name string, failures long")

    def stored(
        self, name: str, plan: Callable[[Warehouse], DataFrame], bucket_by: str | None = None
    ) -> DataFrame:
        """Any frame over the warehouse as a table, stored on first use."""
        return self._once(
            name, lambda: write_table(plan(self), f"{self.path}/{name}", bucket_by=bucket_by)
        )

    def _raw(self, source: str) -> DataFrame:
        with self._guard:
            lock = self._locks[f"raw_{source}"]
        with lock:
            if source not in self._sources:
                self._sources[source] = self.raw[source]()
            return self._sources[source]

    def build(self) -> dict[str, float]:
        """Store every model and return the seconds each took."""
        for name in MODELS:
            if not name.startswith("int_"):
                self[name]
        return dict(self.seconds)

    def publish(self, database: str = "default") -> None:
        """Enter the stored tables in the session's catalog, over the files already written."""
        for name in self._stored:
            table = f"{database}.{name}"
            self.spark.catalog.createTable(table, path=f"{self.path}/{name}", source="parquet")
            if name in PARTITION_BY:
                self.spark.catalog.recoverPartitions(table)

    def register_views(self) -> None:
        for name, table in self._stored.items():
            table.createOrReplaceTempView(name)

    def log_build(self, path: str, invocation_id: str) -> None:
        """Append the recorded build times to a model history table."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [
            (invocation_id, name, "warehouse", "table", "success", s, None, now, f"model.{name}")
            for name, s in self.seconds.items()
        ]
        append_table(self.spark.createDataFrame(rows, MODEL_HISTORY), path)


def _staging(name: str) -> Callable[[Warehouse], DataFrame]:
    model, source = stg.MODELS[name]
    return lambda w: model(w[f"raw_{source}"])


def _places(w: Warehouse) -> DataFrame:
    """The customer of every order, stored once for the facts."""
    return w.stored(
        "order_places", lambda w: inter.order_places(w["stg_orders"], w["stg_customers"]), "order_id"
    )


def _context(w: Warehouse) -> DataFrame:
    """Orders with their customer's place; both lie in buckets of the order."""
    return inter.order_context(w["stg_orders"], _places(w))


def _fct_orders(w: Warehouse, by_month: bool = False) -> DataFrame:
    return fct.fct_orders(
        inter.orders_at_places(w["stg_orders"], _places(w), w["stg_reviews"], w.dedup_reviews),
        w["int_order_payments_aggregated"],
        w["stg_order_items"],
        by_month,
    )


def _sold_by_category(w: Warehouse) -> DataFrame:
    """Staged lines with the known category of their product, in buckets of the order.

    Where the line fact is stored and no product is listed twice, the fact tells the category of
    every order's products; else the products are asked.
    """
    items, name = w["stg_order_items"], "product_category_name"
    products = w["stg_products"].select("product_id", name)
    facts = w._stored.get("fct_order_items")
    if facts is not None and duplicates(products, ["product_id"]).isEmpty():
        told = facts.select("order_id", "product_id", name).distinct()
    else:
        told = inter.brought(items, "order_id", "product_id", products)
    return items.join(told.filter(F.col(name).isNotNull()), ["order_id", "product_id"])


def _subtotals(w: Warehouse, key: str) -> DataFrame:
    """Order subtotals of the line fact per product or seller, stored once."""
    name, column, items = f"{key}_order_subtotals", f"{key}_id", w["fct_order_items"]
    hot = has_hot_key(items, column)
    return w.stored(
        name, lambda w: mart.order_subtotals(items, column, hot), bucket_by=None if hot else column
    )


def _product_mart(w: Warehouse, items: DataFrame) -> DataFrame:
    return mart.mart_product_performance(
        w["dim_products"], w["dim_category"], items, w["fct_reviews"], _subtotals(w, "product")
    )


def _seller_baskets(w: Warehouse) -> DataFrame:
    return w.stored("seller_baskets", lambda w: dim.seller_baskets(w["stg_order_items"]), "order_id")


MODELS: dict[str, Callable[[Warehouse], DataFrame]] = {
    **{name: _staging(name) for name in stg.MODELS},
    "int_orders_enriched": lambda w: inter.int_orders_enriched(
        w["stg_orders"], w["stg_customers"], w["stg_reviews"], w.dedup_reviews
    ),
    "int_order_items_enriched": lambda w: inter.int_order_items_enriched(
        w["stg_order_items"], w["stg_products"], w["stg_sellers"], w["stg_category_translation"]
    ),
    "int_order_payments_aggregated": lambda w: inter.int_order_payments_aggregated(
        w["stg_payments"]
    ),
    "fct_orders": lambda w: _fct_orders(w),
    "fct_order_items": lambda w: fct.fct_order_items(
        inter.lines_in_context(
            w["stg_order_items"], w["stg_products"], w["stg_sellers"],
            w["stg_category_translation"], _context(w),
            inter.order_products(w["stg_order_items"], w["stg_products"]),
        )
    ),
    "fct_payments": lambda w: fct.fct_payments(w["stg_payments"], _context(w)),
    "fct_reviews": lambda w: fct.fct_reviews(
        w["stg_reviews"], _context(w), w["stg_order_items"]
    ),
    "dim_customers": lambda w: dim.dim_customers(w["stg_customers"], w["fct_orders"], w.as_of),
    "dim_products": lambda w: dim.dim_products(
        w["stg_products"], w["stg_category_translation"], w["stg_order_items"]
    ),
    "dim_sellers": lambda w: dim.dim_sellers(
        w["stg_sellers"], w["stg_order_items"], w["stg_orders"], w["stg_reviews"],
        _seller_baskets(w),
    ),
    "dim_category": lambda w: dim.dim_category(
        w["stg_category_translation"], w["stg_products"], w["stg_order_items"], _sold_by_category(w)
    ),
    "dim_geography": lambda w: dim.dim_geography(
        w["stg_geolocation"], w["stg_customers"], w["stg_sellers"]
    ),
    "dim_date": lambda w: dim.dim_date(w["stg_orders"]),
    "mart_customer_analytics": lambda w: mart.mart_customer_analytics(
        w["dim_customers"], w["fct_orders"], w["fct_order_items"], w["dim_geography"], w.as_of
    ),
    "mart_executive_dashboard": lambda w: mart.mart_executive_dashboard(
        w["fct_orders"], w["fct_order_items"], w["fct_payments"], w["fct_reviews"], w["dim_date"]
    ),
    "mart_executive_dashboard_fanout_safe": lambda w: mart.mart_executive_dashboard(
        w["fct_orders"], w["fct_order_items"], w["fct_payments"], w["fct_reviews"], w["dim_date"],
        fanout_safe=True,
    ),
    "mart_product_performance": lambda w: _product_mart(w, w["fct_order_items"]),
    "mart_seller_scorecard": lambda w: mart.mart_seller_scorecard(
        w["dim_sellers"], w["dim_geography"], w["fct_order_items"], _subtotals(w, "seller")
    ),
}


# models whose plan for a write has rebalanced its rows already
BALANCED: dict[str, Callable[[Warehouse], DataFrame]] = {
    "fct_orders": lambda w: _fct_orders(w, by_month=True)
}


class StoredTables(Mapping[str, DataFrame]):
    """The tables of a built warehouse, read from its folder and never written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def __getitem__(self, name: str) -> DataFrame:
        if name not in MODELS or name.startswith("int_"):
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __iter__(self):
        return (name for name in MODELS if not name.startswith("int_"))

    def __len__(self) -> int:
        return sum(1 for _ in self)


def csv_warehouse(spark: SparkSession, folder: str, **options) -> Warehouse:
    """A warehouse over the nine raw CSV files of a folder."""
    from bazarlytics.sources.files import read_raw_csv
    from bazarlytics.sources.schemas import RAW

    raw = {t: (lambda t=t: read_raw_csv(spark, folder, t)) for t in RAW}
    return Warehouse(spark, raw, **options)


def retail_warehouse(spark: SparkSession, folder: str, **options) -> Warehouse:
    """A warehouse over tables derived from a general retail schema in Parquet."""
    from bazarlytics.sources import retail

    raw = {t: (lambda make=make: make(spark, folder)) for t, make in retail.TABLES.items()}
    return Warehouse(spark, raw, **options)
