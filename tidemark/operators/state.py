"""Mergeable window aggregates: partial aggregates add up, so batches can be combined in any split and order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.operators.aggregates import COUNT, SUM
from tidemark.operators.windows import Sliding, Window, with_window
from tidemark.schemas import AGG_KEY


PARTIALS = ("running_sum", "running_count", "row_count", "min_value", "max_value")


def partials() -> list[Column]:
    """Sum, min and max of the records' sums; running_count adds their counts, row_count counts them. NaN is no min or max."""
    value = F.nanvl(F.col(SUM), F.lit(None))
    made = (F.sum(SUM), F.sum(COUNT), F.count(F.lit(1)), F.min(value), F.max(value))
    return [c.alias(n) for c, n in zip(made, PARTIALS)]


def batch_aggregate(metrics: DataFrame, window: Window = Sliding()) -> DataFrame:
    """The partials by metric and window."""
    return with_window(metrics, window).groupBy(*AGG_KEY).agg(*partials())


def hopping_aggregate(metrics: DataFrame, window_secs: int, slide_secs: int) -> DataFrame:
    """The partials by metric and hopping window, in all ceil(window / slide) windows that hold a record: records are combined to panes first, and panes are copied."""
    if window_secs < 1 or slide_secs < 1:
        raise InvalidArgument("window and slide take a second at least")
    pane = math.gcd(window_secs, slide_secs)
    start = F.col("timestamp") - F.pmod("timestamp", F.lit(pane))
    panes = metrics.withColumn("pane", start).groupBy("metric_id", "pane").agg(*partials())
    last = F.col("pane") - F.pmod("pane", F.lit(slide_secs))
    copies = panes.withColumn("window_start", F.explode(F.transform(F.sequence(F.lit(0), F.lit((window_secs - 1) // slide_secs)), lambda k: last - k * slide_secs)))
    held = copies.filter(F.col("window_start") + window_secs > F.col("pane")).withColumn("window_end", F.col("window_start") + window_secs)
    return merge_state(held)


def merge_state(*states: DataFrame) -> DataFrame:
    """One state of many: sums and counts add, extremes combine."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*AGG_KEY).agg(*[F.sum(c).alias(c) for c in ("running_sum", "running_count", "row_count")], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


def rollup_as_metrics(state: DataFrame) -> DataFrame:
    """Window aggregates as metric records stamped with the window's start; the average is sum / count over rows."""
    count = F.col("row_count")
    return state.select("metric_id", F.col("window_start").alias("timestamp"), F.col("running_sum").alias(SUM), F.when(count != 0, F.col("running_sum") / count).alias("value_running_window_avg"), count.alias(COUNT))
