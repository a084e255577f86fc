"""Text out of server-sent-event payload lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import sse_delta


def sse_messages(lines: DataFrame, data: str = "data") -> DataFrame:
    """Adds content, the trimmed delta of each payload; end marks, malformed JSON and blank deltas go."""
    return lines.withColumn("content", sse_delta(F.col(data))).filter(F.col("content").isNotNull())
