"""Grouped, per-record and look-back aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.operators.windows import Lookback, NoWindow, Window, with_window

SUM, AVG, COUNT = "value_running_window_sum", "value_running_window_avg", "value_running_window_count"


class AggregateFunction(Enum):
    COUNT = "Count"
    SUM = "Sum"
    AVG = "Avg"
    MIN = "Min"
    MAX = "Max"

    def over(self, column: str | None) -> Column:
        """Counts rows where column is None, else non-null values."""
        if self is AggregateFunction.COUNT:
            return F.count(F.lit(1) if column is None else F.col(column))
        if column is None:
            raise InvalidArgument(f"{self.value} needs a column")
        return {"Sum": F.sum, "Avg": F.avg, "Min": F.min, "Max": F.max}[self.value](F.col(column))

    @classmethod
    def parse(cls, name: str) -> AggregateFunction:
        try:
            return cls(name)
        except ValueError:
            raise InvalidArgument(f"unknown aggregate function: {name!r}") from None


@dataclass(frozen=True)
class GroupBy:
    """columns may be SQL expressions; time_column joins the keys and comes out as timestamp."""

    columns: tuple[str, ...] = ()
    time_column: str | None = None


def time_range(df: DataFrame, from_ts: int | None = None, to_ts: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Both ends are included, and each holds without the other. Where the table has a day column its partitions are pruned too."""
    for bound, keep in ((from_ts, lambda c, v: c >= v), (to_ts, lambda c, v: c <= v)):
        if bound is not None:
            df = df.filter(keep(F.col(ts), F.lit(bound)))
            if "day" in df.columns:
                df = df.filter(keep(F.col("day"), F.lit(int(bound / 86400))))
    return df


def aggregate(df: DataFrame, function: AggregateFunction, column: str | None = SUM, group_by: GroupBy = GroupBy(), from_ts: int | None = None, to_ts: int | None = None, window: Window = NoWindow(), ts: str = "timestamp") -> DataFrame:
    """One aggregate, named value, by group, optional time column and optional window. Count counts rows."""
    df = time_range(df, from_ts, to_ts, ts)
    keys = [F.expr(c).alias(c) for c in group_by.columns]
    if group_by.time_column:
        keys.append(F.col(group_by.time_column).alias("timestamp"))
    if not isinstance(window, NoWindow):
        df = with_window(df, window, ts)
        keys += [F.col("window_start"), F.col("window_end")]
    value = function.over(None if function is AggregateFunction.COUNT else column).alias("value")
    return df.groupBy(*keys).agg(value) if keys else df.agg(value)


def aggregate_columns(df: DataFrame, function: AggregateFunction, columns: list[str], group_by: GroupBy = GroupBy()) -> DataFrame:
    """The same aggregate of several columns in one pass; null values do not count."""
    keys = [F.expr(c).alias(c) for c in group_by.columns]
    aggs = [function.over(c).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def apply_function(df: DataFrame, function: AggregateFunction) -> DataFrame:
    """One double over metric records: Avg is the plain mean of their averages, Min and Max are over their sums, Count counts records; 0.0 for no record. NaN never wins Min or Max."""
    value = {
        AggregateFunction.SUM: F.sum(SUM),
        AggregateFunction.AVG: F.avg(AVG),
        AggregateFunction.MIN: F.min(F.nanvl(F.col(SUM), F.lit(None))),
        AggregateFunction.MAX: F.max(F.nanvl(F.col(SUM), F.lit(None))),
        AggregateFunction.COUNT: F.count(F.lit(1)),
    }[function]
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def lookback(df: DataFrame, function: AggregateFunction, window: Lookback, as_of: int, column: str = "value", ts: str = "timestamp") -> DataFrame:
    """Average, sum or count, as double, over all metrics of the window; 0.0 for none."""
    if function not in (AggregateFunction.AVG, AggregateFunction.SUM, AggregateFunction.COUNT):
        raise InvalidArgument(f"no look-back {function.value}")
    held = df.filter(window.contains(F.col(ts), as_of))
    value = function.over(None if function is AggregateFunction.COUNT else column)
    return held.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def average_sentiment(df: DataFrame, window_secs: int, as_of: int, column: str = "value") -> DataFrame:
    """The look-back average over the whole minutes of window_secs."""
    return lookback(df, AggregateFunction.AVG, Lookback.minutes(window_secs // 60), as_of, column)


def metric_summary(df: DataFrame, as_of: int, secs: int) -> DataFrame:
    """Samples and mean average by metric over the last secs, the largest mean first."""
    recent = df.filter((F.col("timestamp") >= as_of - secs) & (F.col("timestamp") <= as_of))
    return recent.groupBy("metric_id").agg(F.count(F.lit(1)).alias("samples"), F.avg(AVG).alias("avg_value")).orderBy(F.desc("avg_value"), "metric_id")
