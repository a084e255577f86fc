"""Shared helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters between words, in all operators: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

#: Rows and characters that a Python step holds at once, but for one long text.
SLICE_ROWS, SLICE_CHARS = 1000, 4_000_000


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batch: pa.RecordBatch, text: int, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts (column number text) are bounded in number and in bytes."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or held + size > chars):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def map_texts(df: DataFrame, keep: list[str], text: str, fields: dict[str, str], step: Callable[[list[str | None]], list[list]], drop: Callable[[list[list]], list[bool]] | None = None, replace: str | None = None, kind: str = "string") -> DataFrame:
    """The kept columns and new ones (name -> Spark type) that step gives for the texts of a slice, column by column.

    drop, over those columns, says which rows stay. Where replace names a field, its values take the place of the text
    and no other field comes out. kind="binary" is for columns of bytes. Narrow: no shuffle, and a lost task is just run again.
    """
    importable(df.sparkSession)
    mine = "__text"
    while mine in keep:
        mine += "_"
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast(kind).alias(mine))
    out = T.StructType([*[source.schema[c] for c in keep], *([] if replace else [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()])])
    if replace:
        out = T.StructType([source.schema[c] if c != text else T.StructField(text, T.StringType()) for c in keep])
    names, kinds, at = list(fields), [ARROW[k] for k in fields.values()], len(keep)

    def run(batches):
        let_go()
        for batch in batches:
            for part in slices(batch, at):
                got = step(part.column(at).to_pylist())
                columns = list(part.columns[:at])
                if replace:
                    columns[keep.index(text)] = pa.array(got[names.index(replace)], ARROW["string"])
                else:
                    columns += [pa.array(v, k) for v, k in zip(got, kinds)]
                made = pa.RecordBatch.from_arrays(columns, names=out.names)
                yield made if drop is None else made.filter(pa.array(drop(got), pa.bool_()))

    return source.mapInArrow(run, out)


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Names what this Python worker keeps between the tasks of one operator, and how it is let go."""
    _held[name] = clear


def let_go() -> None:
    """A worker that goes on to another operator gives back what the one before has kept."""
    while _held:
        _held.popitem()[1]()


def crc_mod(doc_id: Column, n: int, r: int) -> Column:
    """Whether crc32 of the id's text leaves remainder r; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n == r, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def shared_folder(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors share; one is set only where there is none."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir("tidemark-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut from its lineage by a written table in the shared folder. Unlike a checkpoint, the table brings none of the plan's partitionings and constraints along, which grow without end over rounds of joins."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def importable(spark) -> None:
    """Python workers find this package where the driver has it, if that folder is on their machine too; else it comes by --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    # freed memory goes back to the machine, and batches of long texts stay small on both sides
    environment.setdefault("MALLOC_ARENA_MAX", "2")
    environment.setdefault("MALLOC_TRIM_THRESHOLD_", "1000000")
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    if int(spark.conf.get(BATCH, "10000")) > SLICE_ROWS:
        spark.conf.set(BATCH, str(SLICE_ROWS))
    if home not in (held := environment.get("PYTHONPATH", "")).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (held, home) if x)
