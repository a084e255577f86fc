"""Hot and cold tier of a scan: the hot one answers only what it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tidemark.settings import CacheConfig
from tidemark.sources.scans import scan


@dataclass
class TieredReader:
    """load() gives the cold table. The hot tier holds every row from its low-water mark on, on memory and disk of the executors."""

    load: Callable[[], DataFrame]
    config: CacheConfig = field(default_factory=CacheConfig)
    _hot: DataFrame | None = None
    _low_water: int | None = None

    def tier(self, from_ts: int, as_of: int) -> str:
        covered = self._low_water is not None and from_ts >= self._low_water
        return "hot" if self.config.enabled and covered and from_ts >= as_of - self.config.max_duration_secs else "cold"

    def refresh(self, as_of: int) -> None:
        self.invalidate()
        if self.config.enabled:
            self._low_water = as_of - self.config.max_duration_secs
            self._hot = scan(self.load(), from_ts=self._low_water, ordered=False).persist(StorageLevel.MEMORY_AND_DISK)

    def invalidate(self) -> None:
        if self._hot is not None:
            self._hot.unpersist()
        self._hot = self._low_water = None

    def read(self, from_ts: int, as_of: int) -> DataFrame:
        """Fills the hot tier when a recent range is asked for that it does not cover yet."""
        recent = self.config.enabled and from_ts >= as_of - self.config.max_duration_secs
        if recent and self.tier(from_ts, as_of) == "cold":
            self.refresh(as_of)
        return scan(self._hot if self.tier(from_ts, as_of) == "hot" else self.load(), from_ts=from_ts)
