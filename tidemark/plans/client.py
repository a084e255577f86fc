"""Client facade with records as dicts and pandas results; unit="ns" takes and gives nanosecond times."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.text import nanos_to_seconds
from tidemark.plans.store import MetricsStore
from tidemark.schemas import METRICS_SCHEMA, from_arrow, to_arrow
from tidemark.settings import Settings

NANOS = 1_000_000_000
#: Rows of a pandas result.
MOST_ROWS = 1_000_000


@dataclass
class MetricRecord:
    metric_id: str
    value_running_window_sum: float
    value_running_window_avg: float
    value_running_window_count: int
    timestamp: int = field(default_factory=lambda: int(time.time()))

    @classmethod
    def from_dict(cls, values: dict) -> MetricRecord:
        try:
            return cls(**values)
        except TypeError as e:
            raise InvalidArgument(str(e)) from None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def setting(cls, metric_id: str, value: float, window_size: int = 10, timestamp: int | None = None) -> MetricRecord:
        return cls(metric_id, value * window_size, value, window_size, int(time.time()) if timestamp is None else timestamp)


class MetricsClient:
    def __init__(self, spark: SparkSession, settings: Settings = Settings(), unit: str = "s"):
        if unit not in ("s", "ns"):
            raise InvalidArgument(f"unit: {unit!r}")
        self.spark, self.settings, self.factor, self._store = spark, settings, NANOS if unit == "ns" else 1, None

    def connect(self) -> MetricsClient:
        self._store = MetricsStore(self.spark, self.settings)
        return self

    def disconnect(self) -> None:
        self._store = None

    __enter__ = connect

    def __exit__(self, *_) -> None:
        self.disconnect()

    @property
    def store(self) -> MetricsStore:
        if self._store is None:
            raise ConnectionError("not connected")
        return self._store

    def set_metric(self, record: MetricRecord | dict, on_conflict: str = "error") -> None:
        self.set_metrics([record], on_conflict)

    def set_metrics(self, records: list[MetricRecord | dict] | pa.Table, on_conflict: str = "error") -> None:
        store = self.store
        if isinstance(records, pa.Table):
            df = from_arrow(self.spark, records)
        else:
            rows = [(r if isinstance(r, MetricRecord) else MetricRecord.from_dict(r)).to_dict() for r in records]
            if not rows:
                return
            df = self.spark.createDataFrame([tuple(float(x[n]) if n.endswith(("sum", "avg")) else x[n] for n in METRICS_SCHEMA.names) for x in rows], METRICS_SCHEMA)
        if self.factor > 1:
            df = df.withColumn("timestamp", nanos_to_seconds(F.col("timestamp")))
        store.insert(df, on_conflict)

    def _found(self, from_timestamp: int | None, to_timestamp: int | None, metric_ids: list[str] | None) -> DataFrame:
        bounds = [None if t is None else int(t) // self.factor for t in (from_timestamp, to_timestamp)]
        return self.store.metrics(*bounds, metric_ids).withColumn("timestamp", F.col("timestamp") * self.factor)

    def query_metrics(self, from_timestamp: int | None = None, to_timestamp: int | None = None, metric_ids: list[str] | None = None) -> pd.DataFrame:
        """An empty result keeps its columns; more than MOST_ROWS rows are an error, iter_metrics has no bound."""
        found = self._found(from_timestamp, to_timestamp, metric_ids)
        return to_arrow(found, METRICS_SCHEMA, MOST_ROWS).to_pandas()

    def iter_metrics(self, from_timestamp: int | None = None, to_timestamp: int | None = None, metric_ids: list[str] | None = None) -> Iterator[MetricRecord]:
        """The same records in their order, a partition at a time."""
        for row in self._found(from_timestamp, to_timestamp, metric_ids).toLocalIterator():
            yield MetricRecord(**row.asDict())

    def get_metrics_window(self, window_seconds: int = 60, as_of: int | None = None) -> pd.DataFrame:
        now = int(time.time()) if as_of is None else as_of
        return self.query_metrics(from_timestamp=(now - window_seconds) * self.factor)
