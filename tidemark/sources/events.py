"""Metric records of a raw event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import AVG, COUNT, SUM


def events_to_metrics(events: DataFrame) -> DataFrame:
    """One record for each (event type, second): sum, mean and number of its values."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("metric_id"), second.alias("timestamp")).agg(F.sum("value").alias(SUM), F.avg("value").alias(AVG), F.count("value").alias(COUNT))
