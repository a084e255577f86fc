"""The metrics store: insert with key check, scans, aggregates, running state, retention."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import InvalidArgument
from tidemark.operators import retention
from tidemark.operators.aggregates import SUM, AggregateFunction, GroupBy, aggregate
from tidemark.operators.windows import Sliding, Window
from tidemark.plans.backends import BACKENDS
from tidemark.plans.cache import TieredReader
from tidemark.plans.catalog import Catalog
from tidemark.plans.sql import Statements
from tidemark.schemas import METRICS_SCHEMA, require_columns
from tidemark.settings import Settings
from tidemark.sources.scans import scan


class MetricsStore:
    """Settings.engine names the backend: parquet folders under connection, or a database at the JDBC url in it. Inserts append partial aggregates to the state; reading merges them, compact() folds them."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings(), window: Window = Sliding(), clock=time.time):
        self.spark, self.settings, self.window, self.clock = spark, settings, window, clock
        if settings.engine not in BACKENDS:
            raise InvalidArgument(f"engine {settings.engine!r} is none of {', '.join(BACKENDS)}")
        self.backend = BACKENDS[settings.engine](spark, settings, window)
        self.catalog, self.statements = Catalog(spark, settings if settings.engine == "jdbc" else None), Statements(spark)
        self.timer = retention.EvictionTimer(settings.ttl_secs, clock=clock)
        self.cache = TieredReader(self.backend.metrics, settings.cache)
        self.init()

    def init(self) -> None:
        """May be called again; repairs the state and registers the built-in tables as they are now."""
        self.backend.catch_up()
        self.catalog.register("metrics", self.backend.metrics().select(*METRICS_SCHEMA.names), replace=True)
        self.catalog.register("metric_aggregations", self.state(), replace=True)

    def insert(self, records: DataFrame, on_conflict: str = "error", stream: str | None = None, batch_id: int | None = None) -> None:
        """A present or repeated key is an error; on_conflict="update" replaces the present row, and of repeated new rows one stays. A batch of a stream is applied once."""
        if on_conflict not in ("error", "update"):
            raise InvalidArgument(f"on_conflict: {on_conflict!r}")
        self._evict_if_due()
        self.backend.insert(require_columns(records, METRICS_SCHEMA), on_conflict, stream, batch_id)
        self.cache.invalidate()
        self.init()

    def rebuild_state(self) -> None:
        self.backend.rebuild_state()

    def compact(self) -> None:
        self.backend.compact()
        self.init()

    def state(self) -> DataFrame:
        return self.backend.state()

    def metrics(self, from_ts: int | None = None, to_ts: int | None = None, metric_ids=None) -> DataFrame:
        self._evict_if_due()
        return scan(self.backend.metrics(from_ts, to_ts), from_ts, to_ts, metric_ids)

    def cached_metrics(self, from_ts: int, as_of: int | None = None) -> DataFrame:
        return self.cache.read(from_ts, int(self.clock()) if as_of is None else as_of)

    def query(self, handle: bytes, recent_from: int | None = None, **args) -> DataFrame:
        """A prepared statement. With recent_from its table metrics holds the records from that time on, read from the hot tier where that covers them."""
        self.init()
        if recent_from is not None:
            self.cached_metrics(recent_from).createOrReplaceTempView("metrics")
        try:
            return self.statements.query(handle, **args)
        finally:
            if recent_from is not None:
                self.init()

    def aggregate(self, function: AggregateFunction, group_by: GroupBy = GroupBy(), from_ts: int | None = None, to_ts: int | None = None, column: str = SUM) -> DataFrame:
        self._evict_if_due()
        return aggregate(self.backend.metrics(from_ts, to_ts), function, column, group_by, from_ts, to_ts)

    def evict(self, as_of: int | None = None, max_rows: int | None = None) -> None:
        """Deletes expired records and the windows that ended before the cutoff; with max_rows the oldest records, so many at most."""
        as_of = int(self.clock()) if as_of is None else as_of
        limit = retention.cutoff(as_of, self.settings.ttl_secs)
        if limit is None:
            return
        self.backend.evict(limit, max_rows)
        self.cache.invalidate()
        self.init()

    def _evict_if_due(self) -> None:
        if self.timer.due():
            self.evict()
