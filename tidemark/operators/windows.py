"""Time windows over epoch seconds.

Every row lies in exactly one window: a sliding window is assigned by its slide
alone, so nothing fans out and the windowed aggregates keep Spark's map-side
combine. hopping() is the separate operator that copies rows to all windows;
state.hopping_aggregate() copies aggregates instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument

MIN_TIME, MAX_TIME = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class NoWindow:
    def bounds(self, ts: Column) -> tuple[Column, Column]:
        return F.lit(MIN_TIME).cast("long"), F.lit(MAX_TIME).cast("long")


def _bucket(ts: Column, size: int) -> Column:
    """Truncates toward zero, also below the epoch."""
    return ts - ts % F.lit(size)


@dataclass(frozen=True)
class Fixed:
    secs: int

    def __post_init__(self):
        if self.secs < 1:
            raise InvalidArgument("a window takes a second at least")

    @property
    def bucket_secs(self) -> int:
        return self.secs

    @property
    def length_secs(self) -> int:
        return self.secs

    def bounds(self, ts: Column) -> tuple[Column, Column]:
        start = _bucket(ts, self.secs)
        return start, start + F.lit(self.secs)


@dataclass(frozen=True)
class Sliding:
    window_secs: int = 3600
    slide_secs: int = 60

    def __post_init__(self):
        if self.window_secs < 1 or self.slide_secs < 1:
            raise InvalidArgument("window and slide take a second at least")

    @property
    def bucket_secs(self) -> int:
        """Seconds whose rows share a window."""
        return self.slide_secs

    @property
    def length_secs(self) -> int:
        return self.window_secs

    def bounds(self, ts: Column) -> tuple[Column, Column]:
        start = _bucket(ts, self.slide_secs)
        return start, start + F.lit(self.window_secs)


Window = NoWindow | Fixed | Sliding


@dataclass(frozen=True)
class Lookback:
    """The last seconds before as_of, both ends included; later rows are out."""

    secs: int

    @classmethod
    def minutes(cls, n: int) -> Lookback:
        return cls(n * 60)

    @classmethod
    def hours(cls, n: int) -> Lookback:
        return cls(n * 3600)

    @classmethod
    def days(cls, n: int) -> Lookback:
        return cls(n * 86400)

    def contains(self, ts: Column, as_of: int) -> Column:
        return ts.between(F.lit(as_of - self.secs), F.lit(as_of))


def with_window(df: DataFrame, window: Window, ts: str = "timestamp") -> DataFrame:
    start, end = window.bounds(F.col(ts))
    return df.withColumns({"window_start": start, "window_end": end})


def hopping(df: DataFrame, window_secs: int, slide_secs: int, ts: str = "timestamp") -> DataFrame:
    """Copies each row to all ceil(window / slide) windows that hold it."""
    w = F.window(F.timestamp_seconds(F.col(ts)), f"{window_secs} seconds", f"{slide_secs} seconds")
    return df.withColumn("_w", w).select("*", F.unix_seconds("_w.start").alias("window_start"), F.unix_seconds("_w.end").alias("window_end")).drop("_w")


def from_json(value) -> Window:
    """null or "None", {"Fixed": duration} or {"Sliding": {"window": duration, "slide": duration}}; a duration is {"secs": n, "nanos": n}."""

    def secs(d) -> int:
        if not isinstance(d, dict) or not isinstance(d.get("secs"), int):
            raise InvalidArgument(f"not a duration: {d!r}")
        if d.get("nanos", 0):
            raise InvalidArgument("windows take whole seconds")
        return d["secs"]

    if value in (None, "None"):
        return NoWindow()
    if isinstance(value, dict) and set(value) == {"Fixed"}:
        return Fixed(secs(value["Fixed"]))
    if isinstance(value, dict) and set(value) == {"Sliding"} and isinstance(value["Sliding"], dict):
        return Sliding(secs(value["Sliding"].get("window")), secs(value["Sliding"].get("slide")))
    raise InvalidArgument(f"not a window: {value!r}")


def to_json(window: Window):
    if isinstance(window, Fixed):
        return {"Fixed": {"secs": window.secs, "nanos": 0}}
    if isinstance(window, Sliding):
        return {"Sliding": {"window": {"secs": window.window_secs, "nanos": 0}, "slide": {"secs": window.slide_secs, "nanos": 0}}}
    return "None"
