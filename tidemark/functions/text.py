"""Column functions of the in-flight text processor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_CONTENT = "Empty message content"


def intent(content: Column) -> Column:
    """Weather wins over Calendar; the case 'None' is a text, not a null."""
    c = F.lower(content)
    return F.when(F.contains(c, F.lit("weather")), "Weather").when(F.contains(c, F.lit("schedule")) | F.contains(c, F.lit("meeting")), "Calendar").otherwise("None")


def is_urgent(content: Column) -> Column:
    """Starts with urgent, in any case; leading space counts against it."""
    return F.startswith(F.upper(content), F.lit("URGENT"))


def byte_length(content: Column) -> Column:
    return F.octet_length(content)


def metric_labels(content: Column) -> Column:
    pairs = (("type", F.lit("message")), ("size", byte_length(content).cast("string")), ("intent", F.concat(F.lit("Some("), intent(content), F.lit(")"))), ("urgent", is_urgent(content).cast("string")))
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])


def require_content(content: Column) -> Column:
    """The content; an empty or null one fails the query."""
    return F.when(content != "", content).otherwise(F.raise_error(F.lit(EMPTY_CONTENT)))


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sse_delta(data: Column) -> Column:
    """choices[0].delta.content of a server-sent payload, trimmed; null where there is none or it is no string."""
    content = F.try_variant_get(F.try_parse_json(data), "$.choices[0].delta.content", "variant")
    text = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    delta = trim_unicode(F.coalesce(text, F.lit("")))
    return F.when((data != "[DONE]") & (delta != ""), delta)


def nanos_to_seconds(ns: Column) -> Column:
    """Whole seconds, truncated toward zero in integers."""
    return ((ns - ns % F.lit(1_000_000_000)) / F.lit(1_000_000_000)).cast("long")


def nanos_to_timestamp(ns: Column) -> Column:
    """Microsecond resolution; the rest is cut."""
    seconds, rest = nanos_to_seconds(ns), ns % F.lit(1_000_000_000)
    return F.timestamp_micros(seconds * F.lit(1_000_000) + ((rest - rest % F.lit(1000)) / F.lit(1000)).cast("long"))
