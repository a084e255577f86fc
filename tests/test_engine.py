"""Store, catalog, client, settings, retention and streams on literal rows."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.errors import AlreadyExists, InvalidArgument, NotFound
from tidemark.operators import inflight, state
from tidemark.operators import windows as W
from tidemark.operators.aggregates import AggregateFunction, GroupBy, lookback
from tidemark.operators.retention import EvictionTimer
from tidemark.plans.cache import TieredReader
from tidemark.plans.catalog import Catalog, encode_schema
from tidemark.plans.client import MetricsClient
from tidemark.plans.sql import Statements
from tidemark.plans.store import MetricsStore
from tidemark.schemas import AGG_SCHEMA, METRICS_SCHEMA, from_arrow
from tidemark.settings import CacheConfig, Settings
from tidemark.sources import textstream
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import runner

NOW = 1_700_000_000


def records(spark, rows):
    return spark.createDataFrame(rows, METRICS_SCHEMA)


def random_records(spark, n=200, seed=1):
    rng = random.Random(seed)
    keys = rng.sample([(m, t) for m in "abc" for t in range(NOW, NOW + 4000, 7)], n)
    return [(m, t, float(rng.randint(0, 99)), 1.0, rng.randint(1, 5)) for m, t in keys]


def test_insert_scan_filter(spark, tmp_path):
    with MetricsClient(spark, Settings(connection=str(tmp_path))) as c:
        c.set_metric({"metric_id": "m1", "timestamp": NOW, "value_running_window_sum": 10.0, "value_running_window_avg": 2.0, "value_running_window_count": 5})
        c.set_metrics([{"metric_id": f"m{i}", "timestamp": NOW + i, "value_running_window_sum": 10.0 * i, "value_running_window_avg": float(i), "value_running_window_count": 10} for i in (2, 3, 4)])
        assert c.query_metrics(metric_ids=["m1"])["value_running_window_avg"].tolist() == [2.0]
        assert set(c.query_metrics(metric_ids=["m2", "m3", "m4"])["metric_id"]) == {"m2", "m3", "m4"}
        assert len(c.query_metrics(NOW - 3600, NOW)) == 1
        assert len(c.get_metrics_window(60, as_of=NOW + 60)) == 4
        assert list(c.query_metrics(metric_ids=["none"]).columns) == METRICS_SCHEMA.names
    with pytest.raises(ConnectionError):
        c.query_metrics()


def test_nanosecond_client(spark, tmp_path):
    with MetricsClient(spark, Settings(connection=str(tmp_path)), unit="ns") as c:
        table = pa.table({"metric_id": ["a"], "timestamp": [NOW * 10**9 + 5], "value_running_window_sum": [1.0], "value_running_window_avg": [1.0], "value_running_window_count": [1]})
        c.set_metrics(table)
        assert c.query_metrics(NOW * 10**9)["timestamp"].tolist() == [NOW * 10**9]


def test_key_conflicts(spark, tmp_path):
    s = MetricsStore(spark, Settings(connection=str(tmp_path)))
    s.insert(records(spark, [("a", NOW, 1.0, 1.0, 1)]))
    for rows in ([("a", NOW, 2.0, 2.0, 1)], [("b", NOW, 2.0, 2.0, 1)] * 2):
        with pytest.raises(AlreadyExists):
            s.insert(records(spark, rows))
    s.insert(records(spark, [("a", NOW, 5.0, 5.0, 2)]), on_conflict="update")
    assert [r[2] for r in s.metrics().collect()] == [5.0]
    assert [(r["running_sum"], r["running_count"]) for r in s.state().collect()] == [(5.0, 2)]


def test_state_is_independent_of_splits(spark, tmp_path):
    rows = random_records(spark)
    whole = sorted(map(tuple, state.batch_aggregate(records(spark, rows)).collect()))
    s = MetricsStore(spark, Settings(connection=str(tmp_path)))
    for part in (rows[:50], rows[50:51], rows[51:]):
        s.insert(records(spark, part))
    assert sorted(map(tuple, s.state().select(*[f.name for f in AGG_SCHEMA]).collect())) == sorted(map(tuple, state.batch_aggregate(records(spark, rows)).select(*[f.name for f in AGG_SCHEMA]).collect()))
    s.compact()
    assert s.state().count() == len(whole)


def test_eviction_and_cache(spark, tmp_path):
    now = [float(NOW + 5000)]
    s = MetricsStore(spark, Settings(connection=str(tmp_path), ttl_secs=3000, cache=CacheConfig(True, 1000)), clock=lambda: now[0])
    s.insert(records(spark, random_records(spark)))
    cut = int(now[0]) - 3000
    before = s.metrics().count()
    now[0] += 61
    after = s.metrics()
    assert after.filter(F.col("timestamp") < cut + 61).count() == 0 and after.count() < before
    reader = TieredReader(s.backend.metrics, CacheConfig(True, 4000))
    assert reader.tier(NOW + 3000, NOW + 5000) == "cold"
    assert reader.read(NOW + 3000, NOW + 5000).count() == s.metrics(NOW + 3000).count()
    assert reader.tier(NOW + 3000, NOW + 5000) == "hot" and reader.tier(NOW, NOW + 5000) == "cold"


def test_eviction_timer():
    t = [0.0]
    timer = EvictionTimer(10, 60, lambda: t[0])
    assert not timer.due()
    t[0] = 60
    assert timer.due() and not timer.due()
    assert not EvictionTimer(None, 0, lambda: t[0]).due()


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), METRICS_SCHEMA)
    one = records(spark, [("a", 1, 1.0, 1.0, 1)])
    t.append(one, "s", 0)
    t.append(one, "s", 0)
    assert t.read().count() == 1
    base = t.version()
    t.rewrite(t.read().filter("timestamp > 5"))
    assert t.read().count() == 0 and t.read(base).count() == 1
    with pytest.raises(AlreadyExists):
        t.rewrite(one, base)


def test_catalog_commands(spark):
    c = Catalog(spark)
    schema = pa.schema([("id", pa.int64()), ("v", pa.float64()), ("s", pa.string())])
    c.execute_command(json.dumps({"type": "create_table", "data": {"name": "user_t", "schema_bytes": encode_schema(schema)}}))
    c.insert("user_t", spark.createDataFrame([(1, 2.0, None), (1, 3.0, "x")], "id bigint, v double, s string"))
    assert sorted(r[0] for r in c.table("user_t", ["v"]).collect()) == [2.0, 3.0]
    view = {"source_table": "user_t", "function": "Sum", "group_by": {"columns": ["id"], "time_column": None}, "window": "None", "aggregate_columns": ["v"]}
    name = c.execute_command(json.dumps({"type": "create_aggregation_view", "data": view}))
    assert name == "agg_view_user_t" and [tuple(r) for r in spark.table(name).collect()] == [(1, 5.0)]
    assert c.view_definition(name).to_json() == view
    with pytest.raises(AlreadyExists):
        c.execute_command(json.dumps({"type": "create_aggregation_view", "data": view}))
    for bad in ("{", '{"type":"x","data":{"name":"a"}}', '{"type":"drop_table","data":{}}', json.dumps({"type": "create_aggregation_view", "data": view | {"aggregate_columns": ["no"], "name": "q"}})):
        with pytest.raises(InvalidArgument):
            c.execute_command(bad)
    c.execute_command('{"type":"drop_aggregation_view","data":{"name":"agg_view_user_t"}}')
    c.execute_command('{"type":"drop_table","data":{"name":"user_t"}}')
    with pytest.raises(NotFound):
        c.drop_table("user_t")


def test_arrow_types(spark):
    t = pa.table({"a": pa.array([2**64 - 1], pa.uint64()), "b": pa.array([255], pa.uint8()), "c": pa.array([5], pa.time32("s"))})
    assert [tuple(map(int, r)) for r in from_arrow(spark, t).collect()] == [(2**64 - 1, 255, 5_000_000)]
    with pytest.raises(InvalidArgument):
        from_arrow(spark, pa.table({"a": pa.array([[1]])}))


def test_statements(spark):
    s = Statements(spark)
    assert s.query(s.prepare("SELECT :x + 1 AS y"), x=2).collect()[0][0] == 3
    with pytest.raises(InvalidArgument):
        s.query(b"12345678")


def test_windows_truncate(spark):
    df = spark.createDataFrame([(-7,), (7,)], "timestamp bigint")
    assert [tuple(r)[1:] for r in W.with_window(df, W.Fixed(5)).collect()] == [(-5, 0), (5, 10)]
    with pytest.raises(InvalidArgument):
        W.from_json({"Fixed": {"secs": 0, "nanos": 5}})


def test_lookback(spark):
    df = spark.createDataFrame([(NOW, "t", 1.0), (NOW + 10, "future", 9.0)], "timestamp bigint, name string, value double")
    got = lambda f, d: lookback(d, f, W.Lookback.minutes(5), NOW).collect()[0][0]
    assert got(AggregateFunction.AVG, df) == 1.0
    assert [got(f, df.limit(0)) for f in (AggregateFunction.AVG, AggregateFunction.SUM, AggregateFunction.COUNT)] == [0.0] * 3


def test_settings():
    assert settings.load(environ={}).engine == "parquet" and settings.load(environ={}).cache.enabled
    s = settings.load({"engine": "parquet"}, {"TIDEMARK_ENGINE": "jdbc", "TIDEMARK_CACHE_MAX_DURATION_SECS": "9"}, options=["a=b=c"], username="u")
    assert s.engine == "jdbc" and s.cache.max_duration_secs == 9 and s.options == {"a": "b=c"} and s.credentials == {}
    with pytest.raises(InvalidArgument):
        settings.load({"engine": "test"}, {})


def run_stream(spark, tmp_path, messages, **options):
    textstream.register(spark)
    out = []
    source = spark.readStream.format("text_list").option("messages", json.dumps(messages)).option("per_batch", "2").load()
    q = runner.process_stream(source, lambda m, x, i: out.extend(zip(m.orderBy("seq").collect(), x.collect())), str(tmp_path / "ck"), F.lit(NOW), available_now=False, **options)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_stream_of_texts(spark, tmp_path):
    tool = lambda gated: gated.withColumn("tool_response", F.concat("intent", F.lit(" info (urgent response)")))
    out = run_stream(spark, tmp_path, ["Process", "this", "stream", "URGENT: What's the weather"], tools=tool)
    got = {m["content"]: (m["intent"], m["tool_response"]) for m, _ in out}
    assert got["URGENT: What's the weather"] == ("Weather", "Weather info (urgent response)") and got["this"] == ("None", None)
    assert sorted(x["value"] for _, x in out) == [4.0, 6.0, 7.0, 26.0]


def test_stream_stops_at_an_empty_message(spark, tmp_path):
    with pytest.raises(Exception, match="Empty message content"):
        run_stream(spark, tmp_path, ["ok", "fine", ""])


def test_failing_sink_is_named(spark, tmp_path):
    textstream.register(spark)
    source = spark.readStream.format("text_list").option("messages", '["test message"]').load()

    def sink(*_):
        raise RuntimeError("Ingestion error")

    q = runner.process_stream(source, sink, str(tmp_path / "ck"), F.lit(NOW), available_now=False)
    with pytest.raises(Exception, match="Failed to ingest metric"):
        q.processAllAvailable()
    q.stop()


def test_large_message(spark):
    df = spark.createDataFrame([("x" * 1_000_000,)], "content string")
    assert inflight.classify(df).collect()[0]["size"] == 1_000_000


def test_stream_and_batch_agree(spark, tmp_path):
    rows = random_records(spark)
    for k, part in enumerate((rows[:120], rows[120:])):
        records(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    runner.upsert_state(source, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    merged = state.merge_state(VersionedTable(spark, str(tmp_path / "state"), AGG_SCHEMA).read())
    columns = [f.name for f in AGG_SCHEMA]
    want = sorted(map(tuple, state.batch_aggregate(records(spark, rows)).select(*columns).collect()))
    assert sorted(map(tuple, merged.select(*columns).collect())) == want
    q = runner.running_state(source).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("running").select(*columns).collect())) == want


def test_aggregate_view_columns(spark):
    c = Catalog(spark)
    c.register("m", records(spark, random_records(spark)), replace=True)
    from tidemark.plans.catalog import AggregationView

    name = c.create_view(AggregationView("m", AggregateFunction.MAX, GroupBy(("metric_id",)), W.Fixed(60), ("value_running_window_sum", "value_running_window_avg")), "both")
    assert spark.table(name).columns == ["metric_id", "window_start", "window_end", "value_running_window_sum", "value_running_window_avg"]
    assert c.list_views() == ["both"] and "m" in c.list_tables()
    c.drop_view("both")
    with pytest.raises(NotFound):
        c.view("both")


DAY = 86400


def day_rows(days, per_day=3, value=1.0):
    return [("a", d * DAY + 100 * k, value + k, 1.0, 1) for d in days for k in range(per_day)]


def state_rows(df):
    return sorted(map(tuple, df.select(*AGG_SCHEMA.names).collect()))


def test_inserts_and_scans_list_the_days_they_need(spark, tmp_path):
    s = MetricsStore(spark, Settings(connection=str(tmp_path)))
    s.insert(records(spark, day_rows(range(100, 110))))
    assert len(s.backend.table.version().folders) == 10
    assert {f.split("day=")[1].split("/")[0] for f in s.metrics(105 * DAY, 106 * DAY + 5).inputFiles()} == {"105", "106"}
    seen = []
    read = s.backend.table.read
    s.backend.table.read = lambda *a, **k: seen.append(read(*a, **k)) or seen[-1]
    s.insert(records(spark, [("b", 103 * DAY, 1.0, 1.0, 1)]))
    assert {f.split("day=")[1].split("/")[0] for df in seen[:1] for f in df.inputFiles()} == {"103"}


@pytest.mark.parametrize("window", [W.Sliding(), W.Fixed(7000), W.Fixed(3 * DAY), W.NoWindow()])
def test_update_eviction_and_compaction_touch_their_days(spark, tmp_path, window):
    now = [130.0 * DAY]
    s = MetricsStore(spark, Settings(connection=str(tmp_path), ttl_secs=20 * DAY), window, clock=lambda: now[0])
    s.insert(records(spark, day_rows(range(100, 120))))
    before = set(s.backend.table.version().folders)
    s.insert(records(spark, day_rows([112], 2, 50.0) + [("c", 112 * DAY, 7.0, 7.0, 1)] * 2), on_conflict="update")
    assert len(before - set(s.backend.table.version().folders)) == 1
    whole = lambda: state_rows(state.batch_aggregate(s.metrics().select(*METRICS_SCHEMA.names), window))
    assert s.metrics().count() == 61 and state_rows(s.state()) == whole()
    s.insert(records(spark, [("d", 115 * DAY + 5, 1.0, 1.0, 1)]))
    s.compact()
    assert len(s.backend.table.version().folders) == 20 and state_rows(s.state()) == whole()
    kept = set(s.backend.table.version().folders)
    s.evict(int(130 * DAY + 150))  # before 110 * DAY + 150
    after = set(s.backend.table.version().folders)
    assert len(after - kept) == 1 and len(after) == 10
    assert s.metrics().agg(F.min("timestamp")).first()[0] == 110 * DAY + 200
    limit = 110 * DAY + 150
    assert all(r["window_end"] > limit for r in s.state().collect())
    again = MetricsStore(spark, s.settings, window, clock=lambda: now[0])
    assert state_rows(again.state()) == state_rows(s.state())
    s.evict(int(132 * DAY), max_rows=2)
    assert s.metrics().agg(F.min("timestamp")).first()[0] == 111 * DAY + 100
    assert s.backend.table.vacuum() and s.metrics().count() > 0


def test_state_is_caught_up_after_a_failed_write(spark, tmp_path):
    s = MetricsStore(spark, Settings(connection=str(tmp_path)))
    s.insert(records(spark, day_rows([100])), stream="in", batch_id=0)

    def fails(*_, **__):
        raise OSError("gone")

    s.backend.states.append = fails
    with pytest.raises(OSError):
        s.insert(records(spark, day_rows([101])), stream="in", batch_id=1)
    again = MetricsStore(spark, Settings(connection=str(tmp_path)))
    want = state_rows(state.batch_aggregate(records(spark, day_rows([100, 101]))))
    assert state_rows(again.state()) == want
    again.insert(records(spark, day_rows([101])), stream="in", batch_id=1)  # the retry
    assert again.metrics().count() == 6 and state_rows(again.state()) == want
    again.backend.states.replace = fails
    with pytest.raises(OSError):
        again.insert(records(spark, day_rows([101], 1, 9.0)), on_conflict="update")
    assert state_rows(MetricsStore(spark, again.settings).state()) == state_rows(state.batch_aggregate(again.backend.metrics()))


def derby(spark, name, **options):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return Settings(engine="jdbc", connection=f"jdbc:derby:memory:{name};create=true", options=options)


def test_database_backend(spark):
    from tidemark.sources import jdbc

    settings = derby(spark, "backend", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    s = MetricsStore(spark, settings, W.Fixed(DAY))
    s.insert(records(spark, day_rows(range(100, 104))))
    for rows in (day_rows([103], 1), [("b", 1, 2.0, 2.0, 1)] * 2):
        with pytest.raises(AlreadyExists):
            s.insert(records(spark, rows))
    assert s.metrics(101 * DAY, 102 * DAY).count() == 4 and s.metrics(metric_ids=["a"]).rdd.getNumPartitions() >= 1
    assert "PushedFilters: [*IsNotNull(timestamp)" in s.metrics(101 * DAY)._jdf.queryExecution().executedPlan().toString()
    s.insert(records(spark, day_rows([103], 2, 5.0) + [("b", 5, 1.0, 1.0, 1)]), on_conflict="update")
    assert s.metrics().count() == 13 and state_rows(s.state()) == state_rows(state.batch_aggregate(s.metrics(), W.Fixed(DAY)))
    assert [r["value"] for r in s.aggregate(AggregateFunction.MAX, GroupBy(("metric_id",)), from_ts=100 * DAY).collect()] == [6.0]
    assert spark.table("metrics").count() == 13 and s.query(s.statements.prepare("SELECT count(*) AS n FROM metrics")).first()["n"] == 13
    s.compact()
    assert jdbc.rows(spark, settings, "SELECT count(*) AS n FROM metric_aggregations")[0][0] == 5
    s.backend.evict(101 * DAY)
    assert s.metrics().count() == 9 and state_rows(s.state()) == state_rows(state.batch_aggregate(s.metrics(), W.Fixed(DAY)))
    with pytest.raises(Exception, match="NOWHERE"):  # all or nothing
        jdbc.execute(spark, settings, ["DELETE FROM metrics", "DELETE FROM nowhere"])
    assert MetricsStore(spark, settings, W.Fixed(DAY)).metrics().count() == 9
    with pytest.raises(InvalidArgument):
        MetricsStore(spark, Settings(engine="other"))


def test_database_catalog(spark):
    c = Catalog(spark, derby(spark, "catalog"))
    schema = pa.schema([("id", pa.int64()), ("v", pa.float64()), ("s", pa.string())])
    c.create_table("kept", schema)
    c.insert("kept", spark.createDataFrame([(1, 2.0, None), (1, 3.0, "x")], "a bigint, b double, c string"))
    assert sorted(tuple(r) for r in c.table("kept", ["v", "s"]).collect()) == [(2.0, None), (3.0, "x")]
    with pytest.raises(AlreadyExists):
        c.create_table("kept", schema)
    from tidemark.plans.catalog import AggregationView

    name = c.create_view(AggregationView("kept", AggregateFunction.SUM, GroupBy(("id",)), W.NoWindow(), ("v",)))
    assert [tuple(r) for r in spark.table(name).collect()] == [(1, 5.0)]
    c.drop_view(name)
    c.drop_table("kept")
    c.create_table("kept", schema)
    assert c.table("kept").count() == 0


ON_A_CLUSTER = """
import json, sys
sys.path[:0] = [{repo!r}]
from pyspark.sql import SparkSession
from tidemark import queries
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={conf!r}).getOrCreate()
for name in {names!r}:
    queries.QUERIES[name](spark, {sf!r}).write.parquet(f"{tmp}/out/{{name}}")
"""


def test_database_in_the_driver_on_a_cluster(tmp_path):
    import pathlib
    import subprocess
    import sys

    import duckdb
    import pyspark
    from oracle import connection, rows_of

    from tidemark.queries import ORACLES, QUERIES

    home, sf = tmp_path / "home", "/root/testdata/sf0.001"
    (home / "work").mkdir(parents=True)
    for p in pathlib.Path(pyspark.__file__).parent.iterdir():  # executors log to a folder of Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    names = sorted(n for n in QUERIES if n.startswith("jdbc_"))
    conf = {"spark.executor.memory": "1024m", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.warehouse.dir": f"{tmp_path}/warehouse", "spark.checkpoint.dir": f"file://{tmp_path}/shared"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONDONTWRITEBYTECODE": "1"}
    code = ON_A_CLUSTER.format(repo=repo, conf=conf, names=names, sf=sf, tmp=tmp_path)
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300, stdin=subprocess.DEVNULL)
    assert ran.returncode == 0, ran.stderr[-3000:]
    for name in names:
        got, want = duckdb.sql(f"SELECT * FROM read_parquet('{tmp_path}/out/{name}/*.parquet')"), connection(sf).sql(ORACLES[name])
        assert rows_of(got.columns, got.fetchall()) == rows_of(want.columns, want.fetchall()) != []


def test_store_accessors(spark, tmp_path):
    s = MetricsStore(spark, Settings(connection=str(tmp_path), cache=CacheConfig(True, 2 * DAY)), clock=lambda: 120.0 * DAY)
    s.insert(records(spark, day_rows(range(110, 120))))
    assert {"metrics", "metric_aggregations"} <= set(s.catalog.list_tables())
    assert [r["value"] for r in s.aggregate(AggregateFunction.SUM, GroupBy(("metric_id",)), 118 * DAY).collect()] == [12.0]
    count = s.statements.prepare("SELECT count(*) AS n FROM metrics")
    assert s.query(count).first()["n"] == 30
    hot = s.query(count, recent_from=119 * DAY)
    assert hot.first()["n"] == 3 and s.cache.tier(119 * DAY, 120 * DAY) == "hot"
    assert "InMemoryTableScan" in hot._jdf.queryExecution().executedPlan().toString()
    assert s.query(count).first()["n"] == 30


def test_arrow_and_row_results_of_the_client(spark, tmp_path):
    from tidemark.schemas import require_columns, to_arrow

    with MetricsClient(spark, Settings(connection=str(tmp_path))) as c:
        c.set_metrics([MetricRecordLike(i) for i in range(3)])
        assert [r.timestamp for r in c.iter_metrics(NOW + 1)] == [NOW + 1, NOW + 2]
        table = to_arrow(c.store.metrics())
        assert table.column_names == METRICS_SCHEMA.names and table.num_rows == 3 and table.schema.field("timestamp").type == pa.int64()
        with pytest.raises(InvalidArgument, match="more than 2"):
            to_arrow(c.store.metrics(), most=2)
        c.set_metrics(table.set_column(1, "timestamp", pa.array([1, 2, 3], pa.int64())))
        assert len(c.query_metrics()) == 6
    with pytest.raises(InvalidArgument, match="missing column: timestamp"):
        require_columns(spark.createDataFrame([("a",)], "metric_id string"), METRICS_SCHEMA)
    with pytest.raises(InvalidArgument, match="column timestamp: string, not bigint"):
        require_columns(spark.createDataFrame([("a", "x")], "metric_id string, timestamp string"), METRICS_SCHEMA)


def MetricRecordLike(i):
    from tidemark.plans.client import MetricRecord

    return MetricRecord.setting(f"m{i}", 2.0, 5, NOW + i)


def test_nan_is_no_extreme(spark):
    from tidemark.operators.aggregates import apply_function

    nan = float("nan")
    df = records(spark, [("a", 1, nan, 1.0, 1), ("a", 2, 3.0, 1.0, 1), ("b", 3, nan, 1.0, 1)])
    assert [apply_function(df, f).first()[0] for f in (AggregateFunction.MIN, AggregateFunction.MAX)] == [3.0, 3.0]
    got = {r["metric_id"]: (r["min_value"], r["max_value"]) for r in state.batch_aggregate(df, W.NoWindow()).collect()}
    assert got == {"a": (3.0, 3.0), "b": (None, None)}


def test_bounded_eviction(spark):
    from tidemark.operators.retention import evicted

    df = records(spark, day_rows(range(100, 110)))
    assert [r["timestamp"] for r in evicted(df, 120 * DAY, 12 * DAY, max_rows=4).collect()] == [100 * DAY, 100 * DAY + 100, 100 * DAY + 200, 101 * DAY]
    assert evicted(df, 120 * DAY, None, max_rows=4).count() == 0


def test_payloads_that_are_no_text(spark):
    from tidemark.functions.text import sse_delta

    payload = lambda c: '{"choices":[{"delta":{"content":%s}}]}' % c
    rows = [(i, x) for i, x in enumerate([payload('" a "'), payload("7"), payload('{"b":1}'), payload("null"), payload("true"), "[DONE]", "{", None, payload('"5"')])]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i int, data string").select("i", sse_delta(F.col("data")).alias("x")).collect()}
    assert got == {0: "a", 8: "5"} | dict.fromkeys(range(1, 8))


@pytest.mark.parametrize("rows", [1, 2, 7, 50])
def test_running_windows_do_not_depend_on_their_parts(spark, monkeypatch, rows):
    from pyspark.sql import Window

    from tidemark.operators import running

    rng = random.Random(rows)
    data = [(i, m, rng.randint(-3 * DAY, 3 * DAY) if i % 3 else 5000, float(rng.randint(0, 9)) if i % 7 else None) for i, m in enumerate(rng.choices("aab", k=400))]
    df = spark.createDataFrame(data, "id int, metric_id string, timestamp bigint, value double")
    whole = lambda frame: sorted(map(tuple, df.select("*", F.sum("value").over(frame).alias("s"), F.avg("value").over(frame).alias("a"), F.count("value").over(frame).alias("c")).collect()))
    by = Window.partitionBy("metric_id")
    assert sorted(map(tuple, running.running_rows(df, rows, order=("timestamp", "id"), chunk=16).collect())) == whole(by.orderBy("timestamp", "id").rowsBetween(1 - rows, 0))
    monkeypatch.setattr(running, "SLOT_SECS", 1000)
    monkeypatch.setattr(running, "SLOT_FRAMES", 1)
    assert sorted(map(tuple, running.running_range(df, rows * 100).collect())) == whole(by.orderBy("timestamp").rangeBetween(-rows * 100, 0))


@pytest.mark.parametrize("size", [(60, 60), (3600, 900), (100, 30), (100, 70)])
def test_hopping_aggregates_of_panes(spark, size):
    df = records(spark, [("a", t, 1.0, 1.0, 2) for t in range(-500, 500, 7)])
    keys = ("metric_id", "window_start", "window_end")
    want = W.hopping(df, *size).groupBy(*keys).agg(F.sum("value_running_window_sum"), F.count(F.lit(1))).collect()
    got = state.hopping_aggregate(df, *size).select(*keys, "running_sum", "row_count").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_failing_tool_stops_the_metric(spark, tmp_path):
    def tool(gated):
        return gated.withColumn("tool_response", F.raise_error(F.lit("tool is down")).cast("string"))

    seen = []
    textstream.register(spark)
    source = spark.readStream.format("text_list").option("messages", json.dumps(["fine", "URGENT: weather"])).load()
    q = runner.process_stream(source, lambda m, x, i: seen.extend(x.collect()), str(tmp_path / "ck"), F.lit(NOW), tools=tool, available_now=False)
    with pytest.raises(Exception, match="tool is down"):
        q.processAllAvailable()
    q.stop()
    assert seen == []


def test_a_tool_runs_once_a_batch(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def tool(gated):
        def run(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b.append_column("tool_response", pa.array(["done"] * b.num_rows))

        return gated.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in gated.schema), "tool_response string"]))

    out = []
    textstream.register(spark)
    source = spark.readStream.format("text_list").option("messages", json.dumps(["URGENT: weather", "URGENT: meeting", "x"])).load()
    q = runner.process_stream(source, lambda m, x, i: out.extend([m.count(), x.count(), len(m.collect())]), str(tmp_path / "ck"), F.lit(NOW), tools=tool)
    q.awaitTermination()
    assert out == [3, 3, 3] and calls.value == 2


def files_in_order(spark, tmp_path, batches):
    import os

    for k, rows in enumerate(batches):
        path = str(tmp_path / "in" / str(k))
        records(spark, rows).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


#: The watermark that a batch sets drops rows from the next but one on.
LATE = ([("a", NOW // 60 * 60 + 5, 1.0, 1.0, 1)], [("a", NOW // 60 * 60 + 7200, 2.0, 1.0, 1)], [("b", NOW // 60 * 60 + 7200, 2.0, 1.0, 1)], [("a", NOW // 60 * 60 + 10, 4.0, 1.0, 1), ("a", NOW // 60 * 60 + 7190, 8.0, 1.0, 1)], [("a", NOW // 60 * 60 + 20_000, 16.0, 1.0, 1)])


@pytest.mark.parametrize("mode", ["append", "update"])
def test_watermark_drops_late_rows_and_finished_windows(spark, tmp_path, mode):
    source = files_in_order(spark, tmp_path, LATE)
    out = runner.running_state(source, W.Sliding(3600, 60), watermark="10 minutes")
    q = out.writeStream.outputMode(mode).format("memory").queryName(f"late_{mode}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    start = NOW // 60 * 60
    got = sorted((r["window_start"] - start, r["window_end"] - r["window_start"], r["running_sum"]) for r in spark.table(f"late_{mode}").collect())
    assert [x for x in got if x[0] < 20_000 // 60 * 60] == [(0, 3600, 1.0), (7140, 3600, 8.0), (7200, 3600, 2.0), (7200, 3600, 2.0)]
    last = q.lastProgress["stateOperators"][0]
    assert last["numRowsTotal"] <= 1 and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress) == 1
    with pytest.raises(InvalidArgument):
        runner.running_state(source, W.NoWindow(), watermark="1 minute")


def test_late_rows_are_merged_without_a_watermark(spark, tmp_path):
    source = files_in_order(spark, tmp_path, LATE)
    runner.upsert_state(source, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    merged = state.merge_state(VersionedTable(spark, str(tmp_path / "state"), AGG_SCHEMA).read())
    assert state_rows(merged) == state_rows(state.batch_aggregate(records(spark, [r for b in LATE for r in b])))
    assert max(r["running_count"] for r in merged.collect()) == 2


def test_windowed_counts_take_rows_within_the_watermark(spark, tmp_path):
    rows = [[("2024-01-01 00:00:10", "a"), ("2024-01-01 00:01:10", "a")], [("2024-01-01 00:00:20", "a")], [("2024-01-03 00:00:00", "a")], [("2024-01-03 00:00:01", "a")], [("2024-01-01 00:00:30", "a")]]
    import os

    for k, part in enumerate(rows):
        path = str(tmp_path / "in" / str(k))
        spark.createDataFrame(part, "t string, k string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "k").coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (1_000_000 + 100 * k,) * 2)
    source = spark.readStream.schema("ts timestamp_ntz, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = runner.windowed_counts(source, "ts", "1 minute", ["k"], "1 hour").writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["window_start"] % DAY, r["n"]) for r in spark.table("counted").collect())[:2] == [(0, 2), (60, 1)]
