"""Time-to-live: which records stay, and when an eviction run is due."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cutoff(as_of: int, ttl_secs: int | None) -> int | None:
    """None means that nothing expires."""
    return as_of - ttl_secs if ttl_secs else None


def retained(df: DataFrame, as_of: int, ttl_secs: int | None, ts: str = "timestamp") -> DataFrame:
    c = cutoff(as_of, ttl_secs)
    return df if c is None else df.filter(F.col(ts) >= c)


def evicted(df: DataFrame, as_of: int, ttl_secs: int | None, ts: str = "timestamp", max_rows: int | None = None) -> DataFrame:
    """What an eviction run deletes: strictly older rows; with max_rows, the oldest of them."""
    c = cutoff(as_of, ttl_secs)
    old = df.filter(F.lit(False)) if c is None else df.filter(F.col(ts) < c)
    return old if max_rows is None else old.orderBy(ts, "metric_id").limit(max_rows)


@dataclass
class EvictionTimer:
    """due() is true once in each interval, first when one has passed since construction; never without a TTL."""

    ttl_secs: int | None
    min_interval_secs: float = 60
    clock: Callable[[], float] = time.time
    _last: float = field(init=False)

    def __post_init__(self):
        self._last = self.clock()

    def due(self) -> bool:
        if not self.ttl_secs or self.clock() - self._last < self.min_interval_secs:
            return False
        self._last = self.clock()
        return True
