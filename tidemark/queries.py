"""Registered queries of the engine's own operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import inflight, retention, running, state
from tidemark.operators import windows as W
from tidemark.operators.aggregates import AVG, COUNT, SUM, AggregateFunction, GroupBy, aggregate, aggregate_columns, apply_function, average_sentiment, lookback, metric_summary
from tidemark.plans.cache import TieredReader
from tidemark.plans.catalog import AggregationView, Catalog
from tidemark.plans.sql import Statements
from tidemark.plans.store import MetricsStore
from tidemark.settings import CacheConfig, Settings
from tidemark.sources import jdbc
from tidemark.sources.events import events_to_metrics
from tidemark.sources.scans import last_window, scan
from tidemark.sources.sse import sse_messages

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
SPLIT = 1705276800  # 2024-01-15 00:00:00 UTC
WEEK, DAY, HOUR = 7 * 86400, 86400, 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_metrics(table(spark, sf_dir, "events"))


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """To 4 digits; the nudge keeps values half-way between two results, as means of 8 can be, from falling to either side."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-7), 4) for c in columns})


M = """WITH metrics AS (
  SELECT event_type AS metric_id, epoch_us(ts) // 1000000 AS timestamp, sum(value) AS value_running_window_sum,
         avg(value) AS value_running_window_avg, count(value) AS value_running_window_count
  FROM events GROUP BY 1, 2) """
RECORD = "metric_id, timestamp, round(value_running_window_sum, 4) AS value_running_window_sum, round(value_running_window_avg + 1e-7, 4) AS value_running_window_avg, value_running_window_count"


def record(df: DataFrame) -> DataFrame:
    return rounded(df, SUM, AVG)


# scans


@query(M + f"SELECT metric_id, count(*) AS samples, round(avg(value_running_window_avg) + 1e-7, 4) AS avg_value FROM metrics WHERE timestamp BETWEEN {AS_OF - WEEK} AND {AS_OF} GROUP BY 1")
def flagship_metric_summary(spark, d):
    return rounded(metric_summary(metrics(spark, d), AS_OF, WEEK), "avg_value")


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {SPLIT}")
def metrics_scan_from(spark, d):
    return record(scan(metrics(spark, d), SPLIT))


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp BETWEEN {SPLIT} AND {SPLIT + WEEK} AND metric_id IN ('click', 'view')")
def metrics_filter_range_ids(spark, d):
    return record(scan(metrics(spark, d), SPLIT, SPLIT + WEEK, ["click", "view"]))


@query(M + f"SELECT {RECORD} FROM metrics")
def metrics_filter_none(spark, d):
    return record(scan(metrics(spark, d)))


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {AS_OF - 3 * DAY}")
def metrics_last_window(spark, d):
    return record(last_window(metrics(spark, d), AS_OF, 3 * DAY))


@query(M + "SELECT metric_id, timestamp, strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM metrics")
def metrics_ts_format(spark, d):
    at = X.nanos_to_timestamp(F.col("timestamp") * F.lit(1_000_000_000))
    return scan(metrics(spark, d)).select("metric_id", "timestamp", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


def _catalog(spark, d) -> Catalog:
    c = Catalog(spark)
    c.register("user_metrics", metrics(spark, d))
    c.register("user_events", table(spark, d, "events"))
    return c


@query("SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000000 AS ts FROM events")
def table_scan_all(spark, d):
    return _catalog(spark, d).table("user_events").withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("SELECT value, event_id, upper(event_type) AS kind FROM events")
def table_scan_projected(spark, d):
    return _catalog(spark, d).table("user_events", ["value", "event_id", "upper(event_type) AS kind"])


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {AS_OF - 4 * DAY}")
def cached_scan_hot(spark, d):
    reader = TieredReader(lambda: metrics(spark, d), CacheConfig(True, WEEK))
    return record(reader.read(AS_OF - 4 * DAY, AS_OF))


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {AS_OF - 10 * DAY}")
def cached_scan_cold(spark, d):
    reader = TieredReader(lambda: metrics(spark, d), CacheConfig(True, WEEK))
    return record(reader.read(AS_OF - 10 * DAY, AS_OF))


# aggregates

for _f, _sql in ((AggregateFunction.COUNT, "count(*)"), (AggregateFunction.SUM, f"round(sum({SUM}), 4)"), (AggregateFunction.AVG, f"round(avg({SUM}) + 1e-7, 4)"), (AggregateFunction.MIN, f"round(min({SUM}), 4)"), (AggregateFunction.MAX, f"round(max({SUM}), 4)")):

    def _by_metric(spark, d, f=_f):
        out = aggregate(metrics(spark, d), f, group_by=GroupBy(("metric_id",)))
        return out if f is AggregateFunction.COUNT else rounded(out, "value")

    query(M + f"SELECT metric_id, {_sql} AS value FROM metrics GROUP BY 1", f"agg_{_f.value.lower()}_by_metric")(_by_metric)


@query(M + f"SELECT metric_id, round(sum({SUM}), 4) AS value FROM metrics WHERE timestamp BETWEEN {SPLIT} AND {SPLIT + WEEK} GROUP BY 1")
def agg_sum_range(spark, d):
    return rounded(aggregate(metrics(spark, d), AggregateFunction.SUM, SUM, GroupBy(("metric_id",)), SPLIT, SPLIT + WEEK), "value")


@query(M + f"SELECT round(max({SUM}), 4) AS value FROM metrics WHERE timestamp <= {SPLIT}")
def agg_max_until(spark, d):
    return rounded(aggregate(metrics(spark, d), AggregateFunction.MAX, to_ts=SPLIT), "value")


@query(M + "SELECT count(*) AS value FROM metrics")
def agg_global(spark, d):
    return aggregate(metrics(spark, d), AggregateFunction.COUNT)


@query(M + f"SELECT timestamp, round(sum({SUM}), 4) AS value FROM metrics GROUP BY 1")
def agg_sum_by_time(spark, d):
    return rounded(aggregate(metrics(spark, d), AggregateFunction.SUM, group_by=GroupBy((), "timestamp")), "value")


@query("SELECT event_type, count(nullif(value, round(value))) AS of_column, count(*) AS of_rows FROM events GROUP BY 1")
def agg_count_col_vs_star(spark, d):
    df = table(spark, d, "events").withColumn("v", F.nullif(F.col("value"), F.round("value")))
    return df.groupBy("event_type").agg(AggregateFunction.COUNT.over("v").alias("of_column"), AggregateFunction.COUNT.over(None).alias("of_rows"))


@query(M + f"SELECT metric_id, round(sum({SUM}), 4) AS {SUM}, round(sum({AVG}), 4) AS {AVG}, CAST(sum({COUNT}) AS BIGINT) AS {COUNT} FROM metrics GROUP BY 1")
def agg_running_columns(spark, d):
    return rounded(aggregate_columns(metrics(spark, d), AggregateFunction.SUM, [SUM, AVG, COUNT], GroupBy(("metric_id",))), SUM, AVG)


for _f, _sql in ((AggregateFunction.SUM, f"sum({SUM})"), (AggregateFunction.AVG, f"avg({AVG})"), (AggregateFunction.MIN, f"min({SUM})"), (AggregateFunction.MAX, f"max({SUM})"), (AggregateFunction.COUNT, "count(*)")):

    def _apply(spark, d, f=_f):
        return rounded(apply_function(metrics(spark, d), f), "value")

    query(M + f"SELECT round(CAST({_sql} AS DOUBLE) + 1e-7, 4) AS value FROM metrics", f"apply_{_f.value.lower()}")(_apply)


@query("SELECT unnest(['Sum', 'Avg', 'Min', 'Max', 'Count']) AS fn, 0.0::DOUBLE AS value")
def apply_empty(spark, d):
    none = metrics(spark, d).filter(F.col("metric_id").isNull())
    out = [apply_function(none, f).select(F.lit(f.value).alias("fn"), "value") for f in AggregateFunction]
    for x in out[1:]:
        out[0] = out[0].union(x)
    return out[0]


# windows


def _window_sql(start: str, end: str) -> str:
    return M + f"SELECT metric_id, {start} AS window_start, {end} AS window_end, round(sum({SUM}), 4) AS running_sum, CAST(sum({COUNT}) AS BIGINT) AS running_count, count(*) AS row_count, round(min({SUM}), 4) AS min_value, round(max({SUM}), 4) AS max_value FROM metrics GROUP BY ALL"


def _state(df: DataFrame) -> DataFrame:
    return rounded(df, "running_sum", "min_value", "max_value")


@query(_window_sql("(-9223372036854775808)::BIGINT", "9223372036854775807::BIGINT"))
def window_none_agg(spark, d):
    return _state(state.batch_aggregate(metrics(spark, d), W.NoWindow()))


for _secs in (300, 1800, 3600, 86400):

    def _fixed(spark, d, secs=_secs):
        return _state(state.batch_aggregate(metrics(spark, d), W.Fixed(secs)))

    query(_window_sql(f"timestamp // {_secs} * {_secs}", f"timestamp // {_secs} * {_secs} + {_secs}"), "window_fixed_agg" if _secs == 300 else f"window_fixed_{_secs}")(_fixed)


@query(_window_sql("timestamp // 60 * 60", "timestamp // 60 * 60 + 3600"))
def window_sliding_agg(spark, d):
    return _state(state.batch_aggregate(metrics(spark, d), W.Sliding(3600, 60)))


@query(M + f"SELECT metric_id, timestamp // 900 * 900 - k * 900 AS window_start, timestamp // 900 * 900 - k * 900 + 3600 AS window_end, round(sum({SUM}), 4) AS total, count(*) AS n FROM metrics, range(4) r(k) GROUP BY ALL")
def window_hopping_agg(spark, d):
    out = state.hopping_aggregate(metrics(spark, d), 3600, 900)
    return out.select("metric_id", "window_start", "window_end", F.round("running_sum", 4).alias("total"), F.col("row_count").alias("n"))


@query(M + f"SELECT metric_id, timestamp, timestamp // 900 * 900 - k * 900 AS window_start, timestamp // 900 * 900 - k * 900 + 3600 AS window_end FROM metrics, range(4) r(k) WHERE timestamp < {SPLIT}")
def window_hopping_rows(spark, d):
    return W.hopping(metrics(spark, d).filter(F.col("timestamp") < SPLIT), 3600, 900).select("metric_id", "timestamp", "window_start", "window_end")


_NAN = M + f", n AS (SELECT metric_id, timestamp, CASE WHEN timestamp % 3 = 0 THEN 'NaN'::DOUBLE ELSE {SUM} END AS x FROM metrics) "


def _with_nan(df: DataFrame) -> DataFrame:
    return df.withColumn(SUM, F.when(F.col("timestamp") % 3 == 0, F.lit(float("nan"))).otherwise(F.col(SUM)))


@query(_NAN + "SELECT metric_id, timestamp // 3600 * 3600 AS window_start, round(min(x) FILTER (NOT isnan(x)), 4) AS min_value, round(max(x) FILTER (NOT isnan(x)), 4) AS max_value, count(*) AS row_count FROM n GROUP BY 1, 2")
def agg_state_nan(spark, d):
    out = state.batch_aggregate(_with_nan(metrics(spark, d)), W.Fixed(HOUR))
    return rounded(out.select("metric_id", "window_start", "min_value", "max_value", "row_count"), "min_value", "max_value")


@query(_NAN + "SELECT round(min(x) FILTER (NOT isnan(x)), 4) AS least, round(max(x) FILTER (NOT isnan(x)), 4) AS most FROM n")
def apply_min_max_nan(spark, d):
    m = _with_nan(metrics(spark, d))
    least, most = (rounded(apply_function(m, f), "value") for f in (AggregateFunction.MIN, AggregateFunction.MAX))
    return least.withColumnRenamed("value", "least").join(most.withColumnRenamed("value", "most"), how="full")


@query(_window_sql("timestamp // 86400 * 86400", "timestamp // 86400 * 86400 + 86400"))
def agg_state_upsert(spark, d):
    m, day = metrics(spark, d), W.Fixed(DAY)
    parts = (m.filter(F.col("timestamp") < SPLIT), m.filter(F.col("timestamp") >= SPLIT))
    return _state(state.merge_state(*[state.batch_aggregate(p, day) for p in parts]))


@query(M + f"SELECT metric_id, timestamp // 3600 * 3600 AS timestamp, round(sum({SUM}), 4) AS {SUM}, round(sum({SUM}) / count(*) + 1e-7, 4) AS {AVG}, count(*) AS {COUNT} FROM metrics GROUP BY 1, 2")
def agg_rollup_as_metrics(spark, d):
    return record(state.rollup_as_metrics(state.batch_aggregate(metrics(spark, d), W.Fixed(HOUR))))


_EVENT_ROWS = "SELECT event_id, event_type AS metric_id, epoch_us(ts) // 1000000 AS timestamp, value FROM events"


def _event_rows(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("metric_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), "value")


def _running_sql(frame: str) -> str:
    return f"WITH e AS ({_EVENT_ROWS}) SELECT event_id, metric_id, timestamp, round(sum(value) OVER w, 4) AS {SUM}, round(avg(value) OVER w + 1e-7, 4) AS {AVG}, count(value) OVER w AS {COUNT} FROM e WINDOW w AS (PARTITION BY metric_id ORDER BY {frame})"


@query(_running_sql("timestamp, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW"))
def running_window_rows(spark, d):
    return record(running.running_rows(_event_rows(spark, d), 10, order=("timestamp", "event_id")).drop("value"))


@query(_running_sql("timestamp RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW"))
def running_window_range(spark, d):
    return record(running.running_range(_event_rows(spark, d), HOUR).drop("value"))


@query(f"SELECT event_type AS metric_id, epoch_us(ts) // 1000000 AS timestamp, round(value * 10, 4) AS {SUM}, round(value, 4) AS {AVG}, 10::BIGINT AS {COUNT} FROM events")
def cli_set_metric_expand(spark, d):
    return record(running.expand_setting(_event_rows(spark, d).withColumn("window_size", F.lit(10))))


# look-back

for _name, _fn, _w, _sql in (
    ("lookback_avg_minutes", AggregateFunction.AVG, W.Lookback.minutes(5000), f"avg({SUM})"),
    ("lookback_sum_hours", AggregateFunction.SUM, W.Lookback.hours(48), f"sum({SUM})"),
    ("lookback_count_days", AggregateFunction.COUNT, W.Lookback.days(7), "count(*)"),
    ("lookback_empty", AggregateFunction.AVG, W.Lookback.minutes(0), f"avg({SUM})"),
):

    def _lookback(spark, d, fn=_fn, w=_w):
        return rounded(lookback(metrics(spark, d), fn, w, AS_OF, SUM), "value")

    query(M + f"SELECT round(CAST(coalesce({_sql}, 0) AS DOUBLE) + 1e-7, 4) AS value FROM metrics WHERE timestamp BETWEEN {AS_OF - _w.secs} AND {AS_OF}", _name)(_lookback)


# in-flight text

LITERALS = ("URGENT: What's the weather like?", "Schedule a meeting for tomorrow", "Just a normal message", "schedule the weather", "urgently meeting", " URGENT weather", "WEATHER", "é")
_VALUES = ", ".join(f"({-1 - i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(LITERALS))
_MESSAGES = f"WITH m AS (SELECT conv_id * 1000 + turn AS seq, text AS content FROM conversations WHERE text <> '' UNION ALL SELECT * FROM (VALUES {_VALUES}) v(seq, content)) "
_INTENT = "CASE WHEN contains(lower(content), 'weather') THEN 'Weather' WHEN contains(lower(content), 'schedule') OR contains(lower(content), 'meeting') THEN 'Calendar' ELSE 'None' END"
_URGENT = "starts_with(upper(content), 'URGENT')"


def messages(spark, d) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(LITERALS)], "seq bigint, content string")
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("content")).filter("content <> ''").unionByName(own)


@query(_MESSAGES + f"SELECT seq, content, {_INTENT} AS intent, {_URGENT} AS urgent, strlen(content) AS size FROM m")
def inflight_classify(spark, d):
    return inflight.classify(messages(spark, d)).withColumn("size", F.col("size").cast("long"))


@query(_MESSAGES + f"SELECT seq AS timestamp, 'llm_stream' AS name, CAST(strlen(content) AS DOUBLE) AS value, 'type=message,size=' || strlen(content) || ',intent=Some(' || {_INTENT} || '),urgent=' || CAST({_URGENT} AS VARCHAR) AS labels FROM m")
def inflight_metrics(spark, d):
    out = inflight.to_metrics(messages(spark, d), F.col("seq"))
    return out.withColumn("labels", F.array_join(F.transform("labels", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))


@query(_MESSAGES + f"SELECT seq, CASE WHEN {_URGENT} AND {_INTENT} <> 'None' THEN {_INTENT} || ' info (urgent response)' END AS tool_response FROM m")
def inflight_tool_gate(spark, d):
    tool = lambda intent, content: F.concat(intent, F.lit(" info (urgent response)"))
    return inflight.call_tool(inflight.classify(messages(spark, d)), tool).select("seq", "tool_response")


@query(_MESSAGES + f"SELECT round(avg(strlen(content)) + 1e-7, 4) AS value FROM m WHERE seq BETWEEN {5000 - 2 * 60} AND 5000")
def lookback_avg_sentiment(spark, d):
    return rounded(average_sentiment(inflight.to_metrics(messages(spark, d), F.col("seq")), 170, 5000), "value")


# fixed values: payload lines of every kind that the rules tell apart
PAYLOADS = ('{"choices":[{"delta":{"content":5}}]}', '{"choices":[{"delta":{"content":{"a":"b"}}}]}', '{"choices":[{"delta":{"content":null}}]}', '{"choices":[{"delta":{"content":" Once"}}]}', '{"choices":[{"delta":{}}]}', "not json", "[DONE]", '{"choices":[{"delta":{"content":"  "}}]}')
_SSE = ", ".join(f"({-1 - i}, '{x}')" for i, x in enumerate(PAYLOADS))
_DELTA = "json_extract_string(data, '$.choices[0].delta.content')"


@query(
    f"WITH l AS (SELECT conv_id * 1000 + turn AS seq, '{{\"choices\":[{{\"delta\":{{\"content\":' || to_json(text)::VARCHAR || '}}}}]}}' AS data FROM conversations UNION ALL SELECT * FROM (VALUES {_SSE}) v(seq, data)), "
    f"c AS (SELECT seq, CASE WHEN json_valid(data) AND json_type(data, '$.choices[0].delta.content') = 'VARCHAR' THEN regexp_replace({_DELTA}, '^\\s+|\\s+$', '', 'g') END AS content FROM l) SELECT seq, content FROM c WHERE content <> ''"
)
def sse_delta_extract(spark, d):
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    lines = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), payload.alias("data"))
    own = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(PAYLOADS)], "seq bigint, data string")
    return sse_messages(lines.unionByName(own)).select("seq", "content")


# views, retention


def _view(spark, d, function, window, columns) -> DataFrame:
    c = _catalog(spark, d)
    return c.view(c.create_view(AggregationView("user_metrics", function, GroupBy(("metric_id",)), window, columns)))


@query(M + "SELECT metric_id, count(*) AS value FROM metrics GROUP BY 1")
def view_count(spark, d):
    return _view(spark, d, AggregateFunction.COUNT, W.NoWindow(), (SUM,))


@query(M + f"SELECT metric_id, timestamp // 300 * 300 AS window_start, timestamp // 300 * 300 + 300 AS window_end, round(sum({SUM}), 4) AS value FROM metrics GROUP BY ALL")
def view_fixed_sum(spark, d):
    return rounded(_view(spark, d, AggregateFunction.SUM, W.Fixed(300), (SUM,)), "value")


@query(M + f"SELECT metric_id, timestamp // 60 * 60 AS window_start, timestamp // 60 * 60 + 3600 AS window_end, round(avg({AVG}) + 1e-7, 4) AS value FROM metrics GROUP BY ALL")
def view_sliding_avg(spark, d):
    return rounded(_view(spark, d, AggregateFunction.AVG, W.Sliding(3600, 60), (AVG,)), "value")


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {AS_OF - 10 * DAY}")
def ttl_retained(spark, d):
    return record(retention.retained(metrics(spark, d), AS_OF, 10 * DAY))


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp < {AS_OF - 10 * DAY}")
def ttl_evicted(spark, d):
    return record(retention.evicted(metrics(spark, d), AS_OF, 10 * DAY))


# an external database, here one that runs in the driver, on its disk


def _external(spark) -> Settings:
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tidemark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return Settings(engine="jdbc", connection=f"jdbc:derby:{folder}/db;create=true", options={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "string_type": "VARCHAR(200)"})


def _released(spark, settings: Settings, df: DataFrame) -> DataFrame:
    """On a cluster the rows of df have been written for the executors, so the database closes and its files go; else df reads it still."""
    if jdbc.driver_only(spark, settings):
        home = settings.connection.removeprefix("jdbc:derby:").partition(";")[0]
        with contextlib.suppress(Py4JJavaError):  # that it has closed is told as an error
            spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{home};shutdown=true")
        shutil.rmtree(os.path.dirname(home), ignore_errors=True)
    return df


def _external_store(spark, d) -> MetricsStore:
    store, m = MetricsStore(spark, _external(spark), W.Fixed(DAY)), metrics(spark, d)
    for part in (m.filter(F.col("timestamp") < SPLIT), m.filter(F.col("timestamp") >= SPLIT)):
        store.insert(part)
    return store


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp BETWEEN {SPLIT} AND {SPLIT + WEEK} AND metric_id IN ('click', 'view')")
def jdbc_metrics_range(spark, d):
    store = _external_store(spark, d)
    return _released(spark, store.settings, record(store.metrics(SPLIT, SPLIT + WEEK, ["click", "view"])))


@query(M + f"SELECT metric_id, round(sum({SUM}), 4) AS value FROM metrics WHERE timestamp >= {SPLIT} GROUP BY 1")
def jdbc_agg_sum(spark, d):
    store = _external_store(spark, d)
    return _released(spark, store.settings, rounded(store.aggregate(AggregateFunction.SUM, GroupBy(("metric_id",)), from_ts=SPLIT), "value"))


@query(_window_sql("timestamp // 86400 * 86400", "timestamp // 86400 * 86400 + 86400"))
def jdbc_state(spark, d):
    store = _external_store(spark, d)
    return _released(spark, store.settings, _state(store.state()))


@query(M + f"SELECT {RECORD} FROM metrics WHERE timestamp >= {AS_OF - 10 * DAY}")
def jdbc_evicted(spark, d):
    store = _external_store(spark, d)
    store.backend.evict(AS_OF - 10 * DAY)
    return _released(spark, store.settings, record(store.metrics()))


def _external_orders(spark, d) -> Catalog:
    c, orders = Catalog(spark, _external(spark)), table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("o_time"))
    c.create_table("user_orders", orders.schema)
    c.insert("user_orders", orders)
    return c


@query("SELECT o_totalprice, o_orderkey, lower(o_orderstatus) AS status FROM orders WHERE o_totalprice > 100000")
def jdbc_table_projected(spark, d):
    c = _external_orders(spark, d)
    return _released(spark, c.external, c.table("user_orders", ["o_totalprice", "o_orderkey", "lower(o_orderstatus) AS status"]).filter("o_totalprice > 100000"))


@query("SELECT o_orderstatus, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 AS window_start, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 + 86400 AS window_end, round(max(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def jdbc_view_max(spark, d):
    c = _external_orders(spark, d)
    c.register("timed", c.table("user_orders").withColumnRenamed("o_time", "timestamp"), replace=True)
    view = c.create_view(AggregationView("timed", AggregateFunction.MAX, GroupBy(("o_orderstatus",)), W.Fixed(DAY), ("o_totalprice",)), "max_by_day")
    return _released(spark, c.external, c.view(view).withColumn("value", F.round("value", 2)))


# plain SQL over the registered tables


def _sql(name: str, text: str, oracle: str | None = None, tables: tuple[str, ...] = ("events",), **args):
    def run(spark, d):
        statements = Statements(spark)
        for t in tables:
            table(spark, d, t).createOrReplaceTempView(t)
        return statements.query(statements.prepare(text), **args)

    query(oracle or text, name)(run)


_sql("sql_passthrough_simple", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > :least GROUP BY event_type", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 10 GROUP BY event_type", least=10)
_sql("sql_join_inner", "SELECT c.c_mktsegment, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2", tables=("orders", "customer", "nation"))
_sql("sql_join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", ("customer", "orders"))
_sql("sql_join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", ("customer", "orders"))
_sql(
    "sql_join_asof",
    "SELECT event_id, last(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY unix_micros(CAST(ts AS timestamp)), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
)
_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", tables=("orders",))
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", tables=("lineitem",))
_sql("sql_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
_sql(
    "sql_session",
    "SELECT user_id, unix_seconds(CAST(w.start AS timestamp)) AS session_start, n FROM (SELECT user_id, session_window(CAST(ts AS timestamp), '6 hours') AS w, count(*) AS n FROM events GROUP BY user_id, session_window(CAST(ts AS timestamp), '6 hours'))",
    "WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS first, event_id FROM events), s AS (SELECT user_id, t, sum(first) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(t) // 1000000 AS session_start, count(*) AS n FROM s GROUP BY user_id, s",
)
