"""A parquet table with atomic versions.

Data folders are written once and never changed. A version is a small manifest
that lists the folders of the table, one a write and, where the table is
partitioned, a partition; writing manifest N is the commit. Readers keep the
version they opened, so a table can be read and rewritten at once. All file
access goes through Hadoop's file systems. Two writers at once are safe where a
rename fails if its target is there, as on HDFS; elsewhere, as on the local file
system and most object stores, a table takes one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import AlreadyExists


@dataclass(frozen=True)
class Version:
    number: int = -1
    folders: tuple[str, ...] = ()
    applied: dict = field(default_factory=dict)  # stream name -> last batch id


class VersionedTable:
    """partition_by names whole-number columns; the first of them is what folders are told apart by."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, folder = self._fs(), self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number."""
        names = [n for n in self._names("_versions") if n.endswith(".json") and not n.startswith(".") and number in (None, int(n[:-5]))]
        if not names:
            return Version()
        stream = self._fs().open(self._path("_versions", names[-1]))
        try:
            content = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(content["number"], tuple(content["folders"]), content["applied"])

    def _commit(self, base: Version, folders: tuple[str, ...], applied: dict) -> Version:
        """Fails where another writer has committed on the same base."""
        new = Version(base.number + 1, folders, applied)
        fs, name = self._fs(), f"{new.number:012d}.json"
        part, final = self._path("_versions", f".{uuid.uuid4().hex}"), self._path("_versions", name)
        out = fs.create(part, True)
        out.write(json.dumps({"number": new.number, "folders": folders, "applied": applied}).encode())
        out.close()
        if fs.exists(final) or not fs.rename(part, final):
            fs.delete(part, False)
            raise AlreadyExists(f"version {new.number} of {self.path} was committed by another writer")
        return new

    def partition_of(self, folder: str) -> int:
        return int(folder.rsplit("=", 1)[1])

    def partitions(self, version: Version | None = None) -> dict[int, list[str]]:
        """Partition -> its folders."""
        out: dict[int, list[str]] = {}
        for f in (version or self.version()).folders:
            out.setdefault(self.partition_of(f), []).append(f)
        return out

    def read(self, version: Version | None = None, keep: Callable[[int], bool] | None = None, folders: Iterable[str] | None = None) -> DataFrame:
        """Of a partitioned table, only the partitions that keep is true for are listed; folders takes those instead of a version's."""
        found = list((version or self.version()).folders if folders is None else folders)
        if keep is not None:
            found = [f for f in found if keep(self.partition_of(f))]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in found]).select(*self.schema.names)

    def _write(self, df: DataFrame) -> tuple[str, ...]:
        folder = f"data/write={uuid.uuid4().hex}"
        writer = df.select(*self.schema.names).write
        if not self.partition_by:
            writer.parquet(f"{self.path}/{folder}")
            return (folder,)
        writer.partitionBy(*self.partition_by).parquet(f"{self.path}/{folder}")
        return tuple(f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{self.partition_by[0]}="))

    def append(self, df: DataFrame, stream: str | None = None, batch_id: int | None = None) -> Version:
        """A batch of a stream that is in the table already is skipped."""
        base = self.version()
        if stream is not None and base.applied.get(stream, -1) >= batch_id:
            return base
        applied = base.applied | ({stream: batch_id} if stream is not None else {})
        return self._commit(base, (*base.folders, *self._write(df)), applied)

    def rewrite(self, df: DataFrame, base: Version | None = None, applied: dict | None = None) -> Version:
        """df takes the place of everything; it may read this table."""
        base = base or self.version()
        return self._commit(base, self._write(df), base.applied | (applied or {}))

    def replace(self, gone: Callable[[int], bool], df: DataFrame | None = None, base: Version | None = None, applied: dict | None = None) -> Version:
        """df, if there is one, takes the place of the partitions that gone is true for; the others are not touched."""
        base = base or self.version()
        stay = tuple(f for f in base.folders if not gone(self.partition_of(f)))
        return self._commit(base, (*stay, *(() if df is None else self._write(df))), base.applied | (applied or {}))

    def vacuum(self) -> int:
        """Deletes the folders of writes that the newest version does not list; not while older versions are being read."""
        fs, keep, gone = self._fs(), {f.split("/")[1] for f in self.version().folders}, 0
        for name in self._names("data"):
            if name not in keep:
                gone += fs.delete(self._path("data", name), True)
        return gone
