"""Where a metrics store keeps its two tables: versioned parquet folders, or an external database."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as SW
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import AlreadyExists, InvalidArgument
from tidemark.operators import state
from tidemark.operators.aggregates import SUM, time_range
from tidemark.operators.windows import NoWindow, Window, with_window
from tidemark.schemas import AGG_SCHEMA, METRIC_KEY, METRICS_SCHEMA
from tidemark.settings import Settings
from tidemark.sources import jdbc
from tidemark.sources.versioned import Version, VersionedTable

DAY = 86400


def day_of(ts: Column) -> Column:
    """Whole days, truncated toward zero."""
    return ((ts - ts % DAY) / DAY).cast("long")


def with_day(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("day", T.LongType())])


def newest(records: DataFrame) -> DataFrame:
    """One row a key: of repeated ones that with the largest count, then sum."""
    w = SW.partitionBy(*METRIC_KEY).orderBy(F.desc("value_running_window_count"), F.desc(SUM))
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def refuse_repeats(records: DataFrame, present: DataFrame, keys: tuple[str, ...]) -> None:
    twice = records.groupBy(*METRIC_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    clash = records.join(present, list(keys), "left_semi").select(*METRIC_KEY)
    if not twice.unionByName(clash).isEmpty():
        raise AlreadyExists("a record with this metric_id and timestamp")


class ParquetBackend:
    """Both tables are partitioned by day, the state by the day its windows start. Writes touch the days of their rows only.

    The state's manifest names the version of the metrics that it covers; what a failed write has left out is caught up
    before the next use.
    """

    def __init__(self, spark: SparkSession, settings: Settings, window: Window):
        self.window = window
        self.table = VersionedTable(spark, f"{settings.connection}/metrics", with_day(METRICS_SCHEMA), ("day",))
        self.states = VersionedTable(spark, f"{settings.connection}/metric_aggregations", with_day(AGG_SCHEMA), ("day",))

    def metrics(self, from_ts: int | None = None, to_ts: int | None = None) -> DataFrame:
        days = [None if t is None else int(t / DAY) for t in (from_ts, to_ts)]
        keep = lambda d: (days[0] is None or d >= days[0]) and (days[1] is None or d <= days[1])
        return self.table.read(keep=keep)

    def state(self) -> DataFrame:
        return state.merge_state(self.states.read())

    def _partial(self, metrics: DataFrame) -> DataFrame:
        return self._dated(state.batch_aggregate(metrics.select(*METRICS_SCHEMA.names), self.window))

    def _dated(self, states: DataFrame) -> DataFrame:
        return states.withColumn("day", F.lit(0).cast("long") if isinstance(self.window, NoWindow) else day_of(F.col("window_start")))

    def catch_up(self) -> None:
        """Brings the state to the newest version of the metrics: folders that came are added, else all is worked out again."""
        now = self.table.version()
        covered = self.states.version().applied.get("metrics", -1)
        if covered == now.number:
            return
        old = self.table.version(covered) if covered >= 0 else Version()
        if set(old.folders) <= set(now.folders):
            self.states.append(self._partial(self.table.read(folders=[f for f in now.folders if f not in set(old.folders)])), "metrics", now.number)
        else:
            self.rebuild_state()

    def rebuild_state(self) -> None:
        now = self.table.version()
        self.states.rewrite(self._partial(self.table.read(now)), applied={"metrics": now.number})

    def insert(self, records: DataFrame, on_conflict: str, stream: str | None, batch_id: int | None) -> None:
        self.catch_up()
        base = self.table.version()
        if stream is not None and base.applied.get(stream, -1) >= batch_id:
            return
        records = records.withColumn("day", day_of(F.col("timestamp")))
        days = {r["day"] for r in records.select("day").distinct().collect()}  # days of one batch
        present = self.table.read(base, keep=days.__contains__)
        if on_conflict == "error":
            refuse_repeats(records, present, (*METRIC_KEY, "day"))
            self.table.append(records, stream, batch_id)
            self.catch_up()
            return
        new = newest(records)
        applied = {stream: batch_id} if stream is not None else {}
        after = self.table.replace(days.__contains__, present.join(new, [*METRIC_KEY, "day"], "left_anti").select(*new.columns).unionByName(new), base, applied)
        self._renew(records, after)

    def _renew(self, records: DataFrame, after: Version) -> None:
        """Works out the windows of the records' days again, from the days that such windows reach."""
        if isinstance(self.window, NoWindow):
            self.rebuild_state()
            return
        starts = with_window(records, self.window).select(day_of(F.col("window_start")).alias("d")).distinct()
        days = {r["d"] for r in starts.collect()}
        reach = -(-self.window.bucket_secs // DAY)
        near = {d + k for d in days for k in range(-reach, reach + 1)}
        renewed = self._partial(self.table.read(after, keep=near.__contains__)).filter(F.col("day").isin(sorted(days)))
        self.states.replace(days.__contains__, renewed, applied={"metrics": after.number})

    def compact(self) -> None:
        """Days of more than one folder get one; the state of each window gets one row."""
        self.catch_up()
        for table in (self.table, self.states):
            base = table.version()
            many = {d for d, own in table.partitions(base).items() if len(own) > 1}
            if many:
                rows = table.read(base, keep=many.__contains__)
                after = table.replace(many.__contains__, rows if table is self.table else self._dated(state.merge_state(rows)), base)
                if table is self.table:  # the same rows in other folders
                    self.states.replace(lambda d: False, applied={"metrics": after.number})

    def evict(self, limit: int, max_rows: int | None = None) -> bool:
        """Whole days go from the manifest; only the day of the limit is written again. With max_rows only so many of the oldest records go."""
        self.catch_up()
        base, last = self.table.version(), int(limit / DAY)
        old = self.table.read(base, keep=lambda d: d <= last).filter(F.col("timestamp") < limit)
        if old.isEmpty():
            return False
        if max_rows is not None:
            gone = old.orderBy("timestamp", "metric_id").limit(max_rows).select(*METRIC_KEY)  # a bound that the caller states
            days = {r["day"] for r in gone.select(day_of(F.col("timestamp")).alias("day")).distinct().collect()}
            rest = self.table.read(base, keep=days.__contains__).join(F.broadcast(gone), list(METRIC_KEY), "left_anti").select(*self.table.schema.names)
            after = self.table.replace(days.__contains__, rest, base)
            self._renew(gone, after)
            return True
        edge = self.table.read(base, keep=lambda d: d == last).filter(F.col("timestamp") >= limit)
        after = self.table.replace(lambda d: d <= last, edge, base)
        if isinstance(self.window, NoWindow):
            self.states.replace(lambda d: False, applied={"metrics": after.number})
            return True
        size = self.window.length_secs
        ends = lambda d: d * DAY + size <= limit  # noqa: E731  a window of that day may have ended
        rest = self.states.read(keep=ends).filter(F.col("window_end") > limit)
        self.states.replace(ends, rest, applied={"metrics": after.number})
        return True


class JdbcBackend:
    """Both tables in an external database. Rows are staged by the executors and come in, with their aggregates, by one transaction of the database."""

    def __init__(self, spark: SparkSession, settings: Settings, window: Window):
        self.spark, self.settings, self.window = spark, settings, window
        for name, schema in (("metrics", METRICS_SCHEMA), ("metric_aggregations", AGG_SCHEMA)):
            jdbc.create(spark, settings, name, schema, jdbc.STRING_TYPE)

    def metrics(self, from_ts: int | None = None, to_ts: int | None = None) -> DataFrame:
        """Split over connections by time where rows are known to lie far enough apart."""
        q = jdbc.quoter(self.spark, self.settings)
        lo, hi = jdbc.rows(self.spark, self.settings, f"SELECT min({q('timestamp')}) AS lo, max({q('timestamp')}) AS hi FROM metrics")[0]
        bounds = None
        if lo is not None:
            bounds = max(lo, lo if from_ts is None else from_ts), min(hi, hi if to_ts is None else to_ts) + 1
            bounds = bounds if bounds[1] - bounds[0] > DAY else None
        return time_range(jdbc.read(self.spark, self.settings, "metrics", bounds), from_ts, to_ts)

    def state(self) -> DataFrame:
        return state.merge_state(jdbc.read(self.spark, self.settings, "metric_aggregations"))

    def catch_up(self) -> None:
        """Nothing to do: the transaction brings records and aggregates together."""

    def _staged(self, df: DataFrame) -> str:
        name = f"staged_{uuid.uuid4().hex[:16]}"
        jdbc.create(self.spark, self.settings, name, df.schema, jdbc.STRING_TYPE)
        jdbc.append(df, self.settings, name)
        return name

    def _run(self, statements: list[str], staged: list[str]) -> None:
        try:
            jdbc.execute(self.spark, self.settings, statements)
        finally:
            jdbc.execute(self.spark, self.settings, [f"DROP TABLE {s}" for s in staged])

    def _columns(self, schema: T.StructType) -> str:
        return ", ".join(map(jdbc.quoter(self.spark, self.settings), schema.names))

    def insert(self, records: DataFrame, on_conflict: str, stream: str | None, batch_id: int | None) -> None:
        if stream is not None:
            raise InvalidArgument("batches of a stream go to the parquet engine, which knows what it has applied")
        lo, hi = records.agg(F.min("timestamp"), F.max("timestamp")).first()
        if lo is None:
            return
        if on_conflict == "error":
            refuse_repeats(records, time_range(jdbc.read(self.spark, self.settings, "metrics"), lo, hi), METRIC_KEY)
        new = newest(records)
        rows, q = self._staged(new), jdbc.quoter(self.spark, self.settings)
        columns, into = self._columns(METRICS_SCHEMA), self._columns(AGG_SCHEMA)
        if on_conflict == "error":
            sums = self._staged(state.batch_aggregate(new, self.window))
            self._run([f"INSERT INTO metrics ({columns}) SELECT {columns} FROM {rows}", f"INSERT INTO metric_aggregations ({into}) SELECT {into} FROM {sums}"], [rows, sums])
            return
        same = " AND ".join(f"s.{q(k)} = metrics.{q(k)}" for k in METRIC_KEY)
        self._run([f"DELETE FROM metrics WHERE EXISTS (SELECT 1 FROM {rows} s WHERE {same})", f"INSERT INTO metrics ({columns}) SELECT {columns} FROM {rows}"], [rows])
        self.rebuild_state()

    def _fill_state(self, df: DataFrame) -> None:
        sums, into = self._staged(df), self._columns(AGG_SCHEMA)
        self._run(["DELETE FROM metric_aggregations", f"INSERT INTO metric_aggregations ({into}) SELECT {into} FROM {sums}"], [sums])

    def rebuild_state(self) -> None:
        self._fill_state(state.batch_aggregate(self.metrics(), self.window))

    def compact(self) -> None:
        self._fill_state(self.state())

    def evict(self, limit: int, max_rows: int | None = None) -> bool:
        if max_rows is not None:
            raise InvalidArgument("a database deletes all that is old at once")
        q = jdbc.quoter(self.spark, self.settings)
        jdbc.execute(self.spark, self.settings, [f"DELETE FROM metrics WHERE {q('timestamp')} < {int(limit)}", f"DELETE FROM metric_aggregations WHERE {q('window_end')} <= {int(limit)}"])
        return True


BACKENDS = {"parquet": ParquetBackend, "jdbc": JdbcBackend}
