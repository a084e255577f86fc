"""Streaming runs of the in-flight processor and of the running aggregates."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.errors import Internal, InvalidArgument
from tidemark.operators import inflight, state
from tidemark.operators.windows import NoWindow, Sliding, Window
from tidemark.schemas import AGG_SCHEMA
from tidemark.sources.versioned import VersionedTable


def process_stream(messages: DataFrame, sink, checkpoint: str, timestamp=None, tools=None, on_empty: str = "error", available_now: bool = True) -> StreamingQuery:
    """Classifies each micro-batch and gives sink(messages, metrics, batch_id) both frames. The first error ends the query; batches before it stay.

    tools(gated) is called, on the driver, with the gated rows' frame and returns it with tool_response. The batch with its
    responses is worked out, once, and held before the sink is called, so that a message whose tool fails has no metric. A
    batch that is retried calls its tools again.
    """
    stamp = F.unix_seconds(F.current_timestamp()) if timestamp is None else timestamp

    def each(batch: DataFrame, batch_id: int) -> None:
        found = inflight.classify(batch, on_empty=on_empty)
        gate = inflight.tool_gate(found)
        if tools is None:
            found = found.withColumn("tool_response", F.lit(None).cast("string"))
        else:
            found = tools(found.filter(gate)).unionByName(found.filter(~gate), allowMissingColumns=True)
        found = found.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found.count()  # fills the held batch, all columns of it
            metrics = inflight.to_metrics(found, stamp)
            try:
                sink(found, metrics, batch_id)
            except Exception as e:
                raise Internal(f"Failed to ingest metric: {e}") from e
        finally:
            found.unpersist()

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_state(metrics: DataFrame, window: Window = Sliding(), watermark: str | None = None) -> DataFrame:
    """The windowed state as a streaming aggregate, for update or complete mode.

    With a watermark on the event time, for append mode too: buckets that it has passed leave the state, and rows that come
    later than it allows go. Buckets are then counted down from the epoch, also before it.
    """
    if not watermark:
        return state.batch_aggregate(metrics, window)
    if isinstance(window, NoWindow):
        raise InvalidArgument("a watermark needs a window")
    timed = metrics.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", watermark)
    bucket = F.window("event_time", f"{window.bucket_secs} seconds")
    start = F.unix_seconds("bucket.start")
    return timed.groupBy("metric_id", bucket.alias("bucket")).agg(*state.partials()).select("metric_id", start.alias("window_start"), (start + window.length_secs).alias("window_end"), *state.PARTIALS)


def windowed_counts(events: DataFrame, ts: str, size: str, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """Event-time windows with late rows allowed for the watermark; a time without zone is taken as UTC."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("window_start"), F.unix_seconds("window.end").alias("window_end"), *keys, "n")


def upsert_state(metrics: DataFrame, table_path: str, checkpoint: str, window: Window = Sliding(), name: str = "state") -> StreamingQuery:
    """Appends each micro-batch's partial aggregates, once a batch; merge_state over the table gives the state."""
    table = VersionedTable(metrics.sparkSession, table_path, AGG_SCHEMA)
    each = lambda batch, batch_id: table.append(state.batch_aggregate(batch, window), name, batch_id)
    return metrics.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
