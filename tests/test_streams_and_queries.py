import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logaudit.jobs import inputs, registry
from logaudit.streaming import streams
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


@pytest.fixture()
def signals(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 8, 1) + dt.timedelta(hours=h)
    rows = [("h", "a", t(0), 1.0), ("h", "a", t(1), 5.0), ("h", "a", t(1), 6.0), ("h", "b", t(0), 2.0), ("h", "a", t(9), 7.0)]
    spark.createDataFrame(rows, "host string, key string, observed_at timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "s"))
    return spark.readStream.schema("host string, key string, observed_at timestamp, value double").parquet(str(tmp_path / "s"))


def test_stream_windows_equal_batch(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    got = run(streams.tumbling_counts(streams.timed(events), ["event_type"]), "tumbling", "complete")
    want = streams.tumbling_counts(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_repeats(spark, signals):
    out = streams.once(signals.withWatermark("observed_at", "60 minutes"), ("host", "key", "observed_at"))
    assert run(out, "once").count() == 4


def test_stream_previous(spark, signals):
    rows = run(streams.with_previous(signals), "previous").where("key = 'a'").orderBy("observed_at", "value").collect()
    assert [r.prev for r in rows] == [None, 1.0, 1.0, 6.0]


def test_stream_silence(spark, signals):
    rows = run(streams.silences(signals.withWatermark("observed_at", "1 minute"), 4), "silence").collect()
    assert [(r.key, r.silent_since.hour) for r in rows] == [("b", 0)]


def test_stream_suppression(spark, signals):
    briefs = signals.select(F.lit("s").alias("sink"), F.col("key").alias("digest"), F.col("observed_at").alias("as_of"))
    rows = run(streams.suppressed(briefs, 480), "sent").where("digest = 'a'").orderBy("as_of", F.desc("send")).collect()
    assert [r.send for r in rows] == [True, False, False, True]


def test_stream_spool(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"alerts": []}))
    (tmp_path / "in" / "2.json").write_text("{")
    assert sorted(r.accepted for r in run(streams.alert_spool(spark, str(tmp_path / "in")), "spool").collect()) == [False, True]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert rows_of(got[list(want.columns)]) == rows_of(want)


def test_went_silent_names_every_silent_series(spark):
    silent = {}
    for r in registry.QUERIES["silent_keys"](spark, SF).collect():
        silent.setdefault((r.host, r.round_id), []).append(r.key)
    want = {at: (f"{len(keys)} series went silent", " ".join(sorted(keys))) for at, keys in silent.items()}
    got = registry.QUERIES["went_silent"](spark, SF).collect()
    assert len(got) == len(want) and {(r.host, r.round_id): (r.title, r.key) for r in got} == want
    assert max(map(len, silent.values())) > 2


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A folder of events whose first host and day make a payload of over 1 MiB."""
    path = str(tmp_path_factory.mktemp("large"))
    day = F.when(F.col("id") < 8000, "2024-01-08 10:00:00").otherwise("2024-01-09 10:00:00").cast("timestamp_ntz")
    rows = spark.range(8010).select(F.col("id").alias("event_id"), day.alias("ts"), (F.col("id") % 500 * 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{path}/events.parquet")
    assert inputs.payloads(spark, path).agg(F.max(F.octet_length("body"))).first()[0] > 1 << 20
    return path


@pytest.mark.parametrize("name", ["ingest_gate", "alert_signals", "alert_firing", "alert_spool", "alerts_firing"])
def test_large_payloads_are_read(spark, large, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{large}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, large).toPandas()
    assert len(want) and rows_of(got[list(want.columns)]) == rows_of(want)
