"""A finite text stream as a Structured Streaming source."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class TextListSource(DataSource):
    """format("text_list") with option messages, a JSON list of texts, and option per_batch: rows (seq, content) in order."""

    @classmethod
    def name(cls) -> str:
        return "text_list"

    def schema(self) -> str:
        return "seq bigint, content string"

    def simpleStreamReader(self, schema):
        return _Reader(json.loads(self.options.get("messages", "[]")), int(self.options.get("per_batch", "100")))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, messages: list[str], per_batch: int):
        self.messages, self.per_batch = messages, per_batch

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict):
        end = min(start["seq"] + self.per_batch, len(self.messages))
        return iter([(i, self.messages[i]) for i in range(start["seq"], end)]), {"seq": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(i, self.messages[i]) for i in range(start["seq"], end["seq"])])


def register(spark) -> None:
    spark.dataSource.register(TextListSource)
