"""Producer of the running-window columns from raw values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import AVG, COUNT, SUM


#: Records of a metric in a task of running_rows; seconds of a task of running_range, and so many of its frames, are the least.
CHUNK, SLOT_SECS, SLOT_FRAMES = 100_000, 3600, 16


def _running(df: DataFrame, frame, value: str) -> DataFrame:
    return df.select("*", F.sum(value).over(frame).alias(SUM), F.avg(value).over(frame).alias(AVG), F.count(value).over(frame).alias(COUNT))


def _slot(ts: Column, secs: int) -> Column:
    return ((ts - F.pmod(ts, F.lit(secs))) / secs).cast("long")


def running_rows(df: DataFrame, rows: int, value: str = "value", order: tuple[str, ...] = ("timestamp",), chunk: int = CHUNK) -> DataFrame:
    """Over the last rows records of each metric, the present one included.

    Records are numbered within each metric, day by day, and dealt in chunks of numbers; the last rows - 1 of a chunk go
    along to the next one. So the records of one metric are shared by many tasks.
    """
    size = max(chunk, rows)
    days = df.withColumn("_day", _slot(F.col("timestamp"), 86400))
    before = Window.partitionBy("metric_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.groupBy("metric_id", "_day").agg(F.count(F.lit(1)).alias("_n")).select("metric_id", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("metric_id", "_day").orderBy(*order)
    numbered = days.withColumn("_k", F.row_number().over(own) - 1).join(starts, ["metric_id", "_day"]).withColumn("_k", F.col("_k") + F.col("_start"))
    at = _slot(F.col("_k"), size)
    copied = numbered.withColumns({"_own": at, "_chunk": F.explode(F.when(F.pmod("_k", F.lit(size)) > size - rows, F.array(at, at + 1)).otherwise(F.array(at)))})
    frame = Window.partitionBy("metric_id", "_chunk").orderBy("_k").rowsBetween(1 - rows, 0)
    return _running(copied, frame, value).filter("_chunk = _own").select(*df.columns, SUM, AVG, COUNT)


def running_range(df: DataFrame, secs: int, value: str = "value") -> DataFrame:
    """Over the last secs of each metric; records of one second see each other.

    Time is dealt in slots; records of the last secs of a slot go along to the next one. So the records of one metric are
    shared by many tasks.
    """
    size = max(SLOT_SECS, SLOT_FRAMES * secs)
    ts = F.col("timestamp")
    at = _slot(ts, size)
    copied = df.withColumns({"_own": at, "_slot": F.explode(F.when(F.pmod(ts, F.lit(size)) >= size - secs, F.array(at, at + 1)).otherwise(F.array(at)))})
    frame = Window.partitionBy("metric_id", "_slot").orderBy("timestamp").rangeBetween(-secs, 0)
    return _running(copied, frame, value).filter("_slot = _own").select(*df.columns, SUM, AVG, COUNT)


def expand_setting(df: DataFrame, value: str = "value", window_size: str = "window_size") -> DataFrame:
    """Records of (metric_id, timestamp, value, window_size): sum is value * size, average the value, count the size."""
    v, n = F.col(value), F.col(window_size)
    return df.select("metric_id", "timestamp", (v * n).alias(SUM), v.cast("double").alias(AVG), n.cast("long").alias(COUNT))
