"""Fixed schemas of the engine and the mapping of Arrow types to Spark types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument

#: One row for each (metric_id, timestamp); the timestamp is in Unix seconds.
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("metric_id", T.StringType(), False),
        T.StructField("timestamp", T.LongType(), False),
        T.StructField("value_running_window_sum", T.DoubleType(), False),
        T.StructField("value_running_window_avg", T.DoubleType(), False),
        T.StructField("value_running_window_count", T.LongType(), False),
    ]
)
METRIC_KEY = ("metric_id", "timestamp")

#: Mergeable aggregate of one metric in one window.
AGG_SCHEMA = T.StructType(
    [
        T.StructField("metric_id", T.StringType(), False),
        T.StructField("window_start", T.LongType(), False),
        T.StructField("window_end", T.LongType(), False),
        T.StructField("running_sum", T.DoubleType(), True),
        T.StructField("running_count", T.LongType(), True),
        T.StructField("row_count", T.LongType(), True),
        T.StructField("min_value", T.DoubleType(), True),
        T.StructField("max_value", T.DoubleType(), True),
    ]
)
AGG_KEY = ("metric_id", "window_start", "window_end")

LABELS_TYPE = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))

#: A metric with labels, as the in-flight processor emits it. The list keeps order and repeated keys.
LABELLED_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("labels", LABELS_TYPE),
    ]
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("intent", T.StringType()),
        T.StructField("tool_response", T.StringType()),
    ]
)

_ARROW_SIMPLE = {
    pa.bool_(): T.BooleanType(),
    pa.int8(): T.ByteType(),
    pa.int16(): T.ShortType(),
    pa.int32(): T.IntegerType(),
    pa.int64(): T.LongType(),
    # unsigned types widen, so that no value is lost
    pa.uint8(): T.ShortType(),
    pa.uint16(): T.IntegerType(),
    pa.uint32(): T.LongType(),
    pa.uint64(): T.DecimalType(20, 0),
    pa.float32(): T.FloatType(),
    pa.float64(): T.DoubleType(),
    pa.string(): T.StringType(),
    pa.large_string(): T.StringType(),
    pa.binary(): T.BinaryType(),
    pa.large_binary(): T.BinaryType(),
    pa.date32(): T.DateType(),
    pa.date64(): T.DateType(),
}


def spark_type(arrow_type: pa.DataType) -> T.DataType:
    """The Spark type that holds every value of an Arrow type; times become microseconds of the day."""
    if arrow_type in _ARROW_SIMPLE:
        return _ARROW_SIMPLE[arrow_type]
    if pa.types.is_time(arrow_type):
        return T.LongType()
    if pa.types.is_timestamp(arrow_type):
        return T.TimestampType() if arrow_type.tz else T.TimestampNTZType()
    raise InvalidArgument(f"unsupported column type: {arrow_type}")


def spark_schema(arrow_schema: pa.Schema) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable) for f in arrow_schema])


def from_arrow(spark, table: pa.Table):
    """A DataFrame of an Arrow table, after the casts that Spark's reader needs."""
    schema, columns = spark_schema(table.schema), []
    for field, column in zip(table.schema, table.columns):
        if pa.types.is_uint64(field.type):
            column = column.cast(pa.decimal128(20, 0))
        elif pa.types.is_unsigned_integer(field.type):
            column = column.cast({8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[field.type.bit_width])
        elif pa.types.is_time(field.type):
            column = column.cast(pa.time64("us")).cast(pa.int64())
        elif pa.types.is_date64(field.type):
            column = column.cast(pa.date32())
        columns.append(column)
    return spark.createDataFrame(pa.table(columns, names=table.column_names), schema=schema)


def require_columns(df, schema: T.StructType):
    """The schema's columns of df by name, in its order; a missing or mistyped column is an InvalidArgument."""
    have = {f.name: f.dataType for f in df.schema}
    for field in schema:
        if field.name not in have:
            raise InvalidArgument(f"missing column: {field.name}")
        if have[field.name] != field.dataType:
            raise InvalidArgument(f"column {field.name}: {have[field.name].simpleString()}, not {field.dataType.simpleString()}")
    return df.select(*[field.name for field in schema])


def to_arrow(df, schema: T.StructType = METRICS_SCHEMA, most: int = 1_000_000) -> pa.Table:
    """The records as an Arrow table on the driver; more than most rows are an error."""
    table = require_columns(df, schema).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise InvalidArgument(f"more than {most} rows; write them to a table instead")
    return table
