import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logaudit.operators import history, rules, suppression
from logaudit.sources import tables
from logaudit.streaming import spool, state, streams

T0 = dt.datetime(2026, 8, 1)
KIND = "host string, key string, observed_at timestamp, value double"


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    state.use_rocksdb(spark)
    yield
    spark.conf.set(name, old)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def stream(spark, tmp_path, *batches, kind=KIND):
    """Each batch is a file, and a micro-batch of its own."""
    import os

    for i, rows in enumerate(batches):
        path = str(tmp_path / f"{i}")
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(path)
        (part,) = (tmp_path / f"{i}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


PAST = [("h", "a", at(0), 3.0), ("h", "b", at(0), 100.0), ("h", "gone", at(1), 1.0)]
NOW = [[("h", "a", at(2), 30.0), ("h", "b", at(2), 90.0), ("h", "a", at(2), 31.0)], [("h", "a", at(3), 40.0), ("h", "new", at(3), 1.0)]]


def test_a_stream_started_from_history_gives_the_batchs_spikes(spark, tmp_path, rocksdb):
    past = spark.createDataFrame(PAST, KIND)
    got = run(state.with_previous(stream(spark, tmp_path, *NOW).withWatermark("observed_at", "1 hour"), past, keep_hours=48), "state_previous")
    every = [r for b in NOW for r in b]
    batch = history.with_previous(spark.createDataFrame(PAST + every, KIND).withColumnRenamed("value", "value_num"), ("value_num",))
    want = batch.where(F.col("observed_at") >= F.lit(at(2))).select("host", "key", "observed_at", "value_num", "prev.value_num")
    plain = lambda rows: sorted((r[1], r[2], r[3], -1 if r[4] is None else r[4]) for r in rows)
    assert plain(got.collect()) == plain(want.collect()) and len(got.collect()) == 5
    labels = F.create_map().cast("map<string,string>")
    signals = got.select("host", F.lit("r").alias("round_id"), F.lit("failures_total").alias("name"), "key", labels.alias("labels"), F.col("value").alias("value_num"), "observed_at", F.when(F.col("prev").isNotNull(), F.struct(F.col("prev").alias("value_num"), F.lit(None).cast("string").alias("value_text"), F.lit(at(0)).alias("observed_at"))).alias("prev"))
    assert sorted(r.title for r in rules.rate_spike(signals).collect()) == ["failures_total 3 to 30", "failures_total 3 to 31"]


def test_a_stream_started_from_history_tells_the_batchs_silences(spark, tmp_path, rocksdb):
    later = [[("h", "a", at(9), 1.0)], [("h", "a", at(10), 1.0)]]
    rows = stream(spark, tmp_path, *NOW, *later).withWatermark("observed_at", "1 minute")
    got = run(state.silences(rows, 4, spark.createDataFrame(PAST, KIND)), "state_silence")
    assert sorted((r.key, r.silent_since) for r in got.collect()) == [("a", at(3)), ("b", at(2)), ("gone", at(1)), ("new", at(3))]


def test_a_stream_started_from_the_ledger_decides_as_the_batch(spark, tmp_path, rocksdb):
    kind = "sink string, digest string, as_of timestamp"
    ledger = spark.createDataFrame([("s", "d", at(0)), ("s", "d", at(-30))], "sink string, digest string, sent_at timestamp")
    batches = [[("s", "d", at(5)), ("s", "d", at(13)), ("s", "e", at(5))], [("s", "d", at(14)), ("s", "d", at(25)), ("s", "e", at(6))]]
    got = run(state.suppressed(stream(spark, tmp_path, *batches, kind=kind).withWatermark("as_of", "12 hours"), 720, ledger), "state_sent")
    want = suppression.should_send(spark.createDataFrame([r for b in batches for r in b], kind).withColumn("severity", F.lit(3)), 720, ledger=ledger)
    plain = lambda df: sorted((r.digest, r.as_of, r.send) for r in df.collect())
    assert plain(got) == plain(want) and [s for *_, s in plain(got)] == [False, True, False, True, True, False]


def test_late_rows_become_a_signal(spark, tmp_path):
    late = state.LateRows()
    spark.streams.addListener(late)
    try:
        rows = stream(spark, tmp_path, [("h", "a", at(10), 1.0)], [("h", "a", at(11), 1.0)], [("h", "b", at(1), 1.0), ("h", "c", at(2), 1.0), ("h", "d", at(10.9), 1.0)], [("h", "e", at(0), 1.0)])
        run(streams.once(rows.withWatermark("observed_at", "30 minutes"), ("host", "key", "observed_at")), "late_lines")
        for _ in range(50):  # the listener is told a little later
            if sum(n for *_, n in late.dropped.values()) >= 3:
                break
            import time

            time.sleep(0.2)
        (r,) = late.signals(spark, "h").collect()
        assert (r.name, r.kind, r.value_num, r.value_text, r.key) == ("late_rows", "error", 3.0, "3 rows came too late", "late_rows{query=late_lines}")
        assert rules.collection_errors(late.signals(spark, "h")).first().detail == "3 rows came too late"
    finally:
        spark.streams.removeListener(late)
    assert state.LateRows().signals(spark, "h").count() == 0


def test_a_spool_stopped_between_its_sinks_holds_each_body_once(spark, tmp_path, monkeypatch):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    bodies = {"1.json": json.dumps({"alerts": []}), "2.json": "{", "3.json": json.dumps({"alerts": [], "x": "y" * 3000}), "4.json": '{"alerts": 5}'}
    for name, body in bodies.items():
        (inbox / name).write_text(body)
    real, calls = tables.put, []

    def stops(rows, path, *more):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("stopped between the sinks")
        real(rows, path, *more)

    monkeypatch.setattr(tables, "put", stops)
    with pytest.raises(Exception, match="FOREACH_BATCH|stopped|failed"):
        spool.spool(spark, str(inbox), out, checkpoint, 2000).awaitTermination()
    assert spool.accepted(spark, out).count() == 1 and spool.refused(spark, out).count() == 0
    (inbox / "6.json").write_text(json.dumps({"alerts": [], "n": 6}))
    for _ in range(2):
        spool.spool(spark, str(inbox), out, checkpoint, 2000).awaitTermination()
    assert sorted(r.body for r in spool.accepted(spark, out).collect()) == sorted([bodies["1.json"], '{"alerts": [], "n": 6}'])
    got = {r.file.rsplit("/", 1)[1]: (r.reason, r.bytes) for r in spool.refused(spark, out).collect()}
    assert got == {"2.json": ("not JSON", 1), "3.json": ("too large", len(bodies["3.json"])), "4.json": ("wrong shape", 13)}
