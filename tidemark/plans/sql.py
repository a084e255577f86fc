"""Prepared SQL texts over the session's tables and views."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import InvalidArgument


class Statements:
    def __init__(self, spark: SparkSession):
        self.spark, self._texts, self._ids = spark, {}, itertools.count()

    def prepare(self, text: str) -> bytes:
        """A handle of 8 bytes."""
        handle = next(self._ids).to_bytes(8, "little")
        self._texts[handle] = text
        return handle

    def query(self, handle: bytes, **args) -> DataFrame:
        """args fill the named parameters, written :name in the text."""
        if len(handle) != 8 or handle not in self._texts:
            raise InvalidArgument("unknown statement handle")
        return self.spark.sql(self._texts[handle], args=args or None)
