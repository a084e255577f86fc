"""Scans of the metrics table: filters reach the parquet reader, columns are pruned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import time_range
from tidemark.schemas import METRICS_SCHEMA


def scan(df: DataFrame, from_ts: int | None = None, to_ts: int | None = None, metric_ids: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
    """Both times are included; all conditions hold together; by time, ties by metric."""
    df = time_range(df, from_ts, to_ts)
    if metric_ids is not None:
        df = df.filter(F.col("metric_id").isin(list(metric_ids)))
    df = df.select(*METRICS_SCHEMA.names)
    return df.orderBy("timestamp", "metric_id") if ordered else df


def last_window(df: DataFrame, as_of: int, secs: int = 60, metric_ids: Sequence[str] | None = None) -> DataFrame:
    return scan(df, from_ts=as_of - secs, metric_ids=metric_ids)
