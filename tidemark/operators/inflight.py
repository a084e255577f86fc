"""Classification of streamed messages and the metric each one gives. Plain projections: they run alike on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions import text as X

METRIC_NAME = "llm_stream"


def classify(messages: DataFrame, content: str = "content", on_empty: str = "error") -> DataFrame:
    """Adds intent, urgent and size. An empty message fails the query, or with on_empty="drop" goes."""
    c = F.col(content)
    if on_empty == "drop":
        messages = messages.filter(c != "")
    elif on_empty == "error":
        messages = messages.withColumn(content, X.require_content(c))
    else:
        raise InvalidArgument(f"on_empty: {on_empty!r}")
    return messages.withColumns({"intent": X.intent(c), "urgent": X.is_urgent(c), "size": X.byte_length(c)})


def tool_gate(classified: DataFrame) -> Column:
    """Only urgent messages with an intent reach a tool."""
    return F.col("urgent") & (F.col("intent") != "None")


def call_tool(classified: DataFrame, tool: Column | Callable[[Column, Column], Column] | None, content: str = "content") -> DataFrame:
    """Adds tool_response: what tool(intent, content) gives for gated messages, else null. tool is a column function, such as a registered pandas UDF."""
    out = F.lit(None).cast("string") if tool is None else F.when(tool_gate(classified), tool(F.col("intent"), F.col(content)))
    return classified.withColumn("tool_response", out)


def to_metrics(messages: DataFrame, timestamp: Column, content: str = "content") -> DataFrame:
    """One metric a message: its size in bytes, with the labels type, size, intent and urgent in this order."""
    c = X.require_content(F.col(content))
    return messages.select(timestamp.cast("long").alias("timestamp"), F.lit(METRIC_NAME).alias("name"), X.byte_length(c).cast("double").alias("value"), X.metric_labels(c).alias("labels"))
