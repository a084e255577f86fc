"""Named tables and aggregation views over them, and the JSON commands that manage both."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import AlreadyExists, InvalidArgument, NotFound
from tidemark.operators import windows as W
from tidemark.operators.aggregates import AggregateFunction, GroupBy, aggregate
from tidemark.schemas import spark_schema
from tidemark.settings import Settings
from tidemark.sources import jdbc


@dataclass(frozen=True)
class AggregationView:
    source_table: str
    function: AggregateFunction
    group_by: GroupBy
    window: W.Window
    aggregate_columns: tuple[str, ...]

    @classmethod
    def from_json(cls, data: dict) -> AggregationView:
        try:
            group = data["group_by"]
            return cls(data["source_table"], AggregateFunction.parse(data["function"]), GroupBy(tuple(group["columns"]), group.get("time_column")), W.from_json(data["window"]), tuple(data["aggregate_columns"]))
        except (KeyError, TypeError, AttributeError) as e:
            raise InvalidArgument(f"bad view definition: {e!r}") from None

    def to_json(self) -> dict:
        return {"source_table": self.source_table, "function": self.function.value, "group_by": {"columns": list(self.group_by.columns), "time_column": self.group_by.time_column}, "window": W.to_json(self.window), "aggregate_columns": list(self.aggregate_columns)}


class Catalog:
    """Tables are DataFrames or catalog tables of the session, or with external settings tables of that database; views stay lazy plans over them."""

    def __init__(self, spark: SparkSession, external: Settings | None = None):
        self.spark, self.external = spark, external
        self._frames: dict[str, DataFrame] = {}
        self._created: set[str] = set()
        self._views: dict[str, AggregationView] = {}

    # tables

    def register(self, name: str, df: DataFrame, replace: bool = False) -> None:
        if not replace and name in self.list_tables():
            raise AlreadyExists(f"table {name}")
        self._frames[name] = df
        df.createOrReplaceTempView(name)

    def create_table(self, name: str, schema: T.StructType | pa.Schema) -> None:
        taken = jdbc.exists(self.spark, self.external, name) if self.external else self.spark.catalog.tableExists(name)
        if name in self.list_tables() or taken:
            raise AlreadyExists(f"table {name}")
        schema = spark_schema(schema) if isinstance(schema, pa.Schema) else schema
        if self.external:
            jdbc.create(self.spark, self.external, name, schema)
        else:
            self.spark.catalog.createTable(name, source="parquet", schema=schema)
        self._created.add(name)

    def insert(self, name: str, df: DataFrame) -> None:
        """Appends by position."""
        if name not in self._created:
            raise NotFound(f"table {name}")
        if len(df.columns) != len(self.schema(name)):
            raise InvalidArgument(f"{len(df.columns)} columns for {len(self.schema(name))} of {name}")
        if self.external:
            jdbc.append(df.toDF(*self.schema(name).names), self.external, name)
        else:
            df.write.insertInto(name)

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """All columns, or exactly the given columns and expressions in their order."""
        if name in self._frames:
            df = self._frames[name]
        elif name in self._created:
            df = jdbc.read(self.spark, self.external, name) if self.external else self.spark.table(name)
        else:
            raise NotFound(f"table {name}")
        return df if columns is None else df.selectExpr(*columns)

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema

    def list_tables(self) -> list[str]:
        return sorted({*self._frames, *self._created})

    def drop_table(self, name: str) -> None:
        """Views on the table stay and fail when they are read."""
        if name in self._frames:
            del self._frames[name]
            self.spark.catalog.dropTempView(name)
        elif name in self._created:
            self._created.remove(name)
            if self.external:
                jdbc.execute(self.spark, self.external, [f"DROP TABLE {name}"])
            else:
                self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        else:
            raise NotFound(f"table {name}")

    # views

    def create_view(self, view: AggregationView, name: str | None = None) -> str:
        """Checks source, columns and name first. A view has a column value, or with several aggregate columns one of each name."""
        name = name or f"agg_view_{view.source_table}"
        source = self.table(view.source_table)
        if name in self._views or name in self.list_tables():
            raise AlreadyExists(f"view {name}")
        if missing := [c for c in view.aggregate_columns if c not in source.columns]:
            raise InvalidArgument(f"no column {', '.join(missing)} in {view.source_table}")
        if not view.aggregate_columns and view.function is not AggregateFunction.COUNT:
            raise InvalidArgument("a view needs an aggregate column")
        self._views[name] = view
        self.view(name).createOrReplaceTempView(name)
        return name

    def view_definition(self, name: str) -> AggregationView:
        if name not in self._views:
            raise NotFound(f"view {name}")
        return self._views[name]

    def view(self, name: str) -> DataFrame:
        v = self.view_definition(name)
        df = self.table(v.source_table)
        if len(v.aggregate_columns) < 2:
            return aggregate(df, v.function, v.aggregate_columns[0] if v.aggregate_columns else None, v.group_by, window=v.window)
        if not isinstance(v.window, W.NoWindow):
            df = W.with_window(df, v.window)
        keys = [*v.group_by.columns, *([v.group_by.time_column] if v.group_by.time_column else []), *([] if isinstance(v.window, W.NoWindow) else ["window_start", "window_end"])]
        aggs = [v.function.over(c).alias(c) for c in v.aggregate_columns]
        return df.groupBy(*keys).agg(*aggs)

    def list_views(self) -> list[str]:
        return sorted(self._views)

    def drop_view(self, name: str) -> None:
        self.view_definition(name)
        del self._views[name]
        self.spark.catalog.dropTempView(name)

    # commands

    def execute_command(self, text: str | bytes) -> str | None:
        """One of create_table (name, schema_bytes: an Arrow IPC schema message), create_aggregation_view, drop_table and drop_aggregation_view (name)."""
        try:
            command = json.loads(text)
            kind, data = command["type"], command["data"]
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidArgument(f"bad command: {e!r}") from None
        if not isinstance(data, dict):
            raise InvalidArgument("data is not an object")
        if kind == "create_aggregation_view":
            return self.create_view(AggregationView.from_json(data), data.get("name"))
        name = data.get("name")
        if not isinstance(name, str):
            raise InvalidArgument("a command needs a name")
        if kind == "create_table":
            self.create_table(name, decode_schema(data.get("schema_bytes")))
        elif kind == "drop_table":
            self.drop_table(name)
        elif kind == "drop_aggregation_view":
            self.drop_view(name)
        else:
            raise InvalidArgument(f"unknown command: {kind!r}")
        return name


def decode_schema(schema_bytes: list[int] | None) -> pa.Schema:
    """An Arrow IPC schema message without its length prefix, as a list of byte values."""
    try:
        raw = bytes(schema_bytes)
        return pa.ipc.read_schema(pa.py_buffer(struct.pack("<Ii", 0xFFFFFFFF, len(raw)) + raw))
    except (TypeError, ValueError, pa.ArrowException, OSError) as e:
        raise InvalidArgument(f"bad schema bytes: {e}") from None


def encode_schema(schema: pa.Schema) -> list[int]:
    return list(schema.serialize().to_pybytes()[8:])
