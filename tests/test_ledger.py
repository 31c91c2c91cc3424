import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logaudit.operators import history_store, suppression
from logaudit.sources import tables

T0 = dt.datetime(2026, 8, 1)
KIND = "sink string, digest string, severity int, as_of timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def sequential(times, gap, last=None):
    """Which of some times, in order, are sent."""
    out = []
    for t in sorted(times):
        go = last is None or t - last >= gap
        last = t if go else last
        out.append((t, go))
    return out


@pytest.mark.parametrize("gap", [1, 7, 720])
def test_decisions_equal_a_sequential_reference(spark, gap):
    rnd = random.Random(gap)
    rows = [("s", d, 3, at(rnd.choice([rnd.randrange(200), rnd.randrange(9000)]))) for d in "abcdefgh" for _ in range(rnd.randrange(1, 120))]
    got = suppression.should_send(spark.createDataFrame(rows, KIND), gap).collect()
    for d in "abcdefgh":
        times = [r[3] for r in rows if r[1] == d]
        want = [t for t, go in sequential(times, dt.timedelta(minutes=gap)) if go]
        assert sorted(r.as_of for r in got if r.digest == d and r.send) == want and sum(r.digest == d for r in got) == len(times)
        assert [r.as_of for r in got if r.digest == d and r.reason == "new situation"] == [min(times)]


def test_a_hundred_thousand_briefs_of_one_digest(spark):
    rnd = random.Random(0)
    seconds = [rnd.randrange(400 * 86400) for _ in range(100_000)]
    df = spark.createDataFrame([(s,) for s in seconds], "s long").select(F.lit("s").alias("sink"), F.lit("d").alias("digest"), F.lit(3).alias("severity"), F.timestamp_seconds(F.col("s")).alias("as_of"))
    got = sorted(r.s for r in suppression.should_send(df).where("send").select(F.unix_seconds("as_of").alias("s")).collect())
    assert got == [t for t, go in sequential(seconds, 720 * 60) if go]


def test_pointers_cross_empty_buckets(spark):
    times = spark.createDataFrame([("k", t) for t in (0, 5, 9, 10, 19, 55, 100)] + [("other", 7)], "k string, at long")
    assert {(r.k, r.at): r.next for r in suppression.next_allowed(times, 10).collect()} == {("k", 0): 10, ("k", 5): 19, ("k", 9): 19, ("k", 10): 55, ("k", 19): 55, ("k", 55): 100}


def test_edges_of_decisions(spark):
    rows = [("s", "d", 3, at(0))] * 3 + [(None, None, 3, at(1)), (None, None, 3, at(2)), ("s", "e", None, at(0)), ("s", "e", 1, at(0)), ("s", "e", 3, None)]
    got = suppression.should_send(spark.createDataFrame(rows, KIND).withColumns({"k": F.lit(1), "at": F.lit(2), "row": F.lit(3), "m": F.create_map(F.lit("a"), F.lit("b"))})).collect()
    assert sorted((r.digest or "", r.reason) for r in got) == [("", "new situation"), ("", "sent lately"), ("d", "new situation"), ("d", "sent lately"), ("d", "sent lately"), ("e", "below the floor"), ("e", "no time"), ("e", "nothing to report")]
    assert all(r.k == 1 and r.row == 3 for r in got)
    assert suppression.should_send(spark.createDataFrame([], KIND)).count() == 0
    assert {r.send for r in suppression.should_send(spark.createDataFrame(rows[:5], KIND), 0).collect()} == {True}


def test_the_ledger_is_read_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    briefs = lambda *minutes: spark.createDataFrame([("s", "d", 3, at(m)) for m in minutes], KIND)

    def run(batch, *minutes):
        decided = suppression.decide(briefs(*minutes), path, batch)
        suppression.record_sent(decided.where("send").withColumn("headline", F.lit("h" * 300)), path, batch)
        return [(r.send, r.reason) for r in decided.orderBy("as_of").collect()]

    assert suppression.read_ledger(spark, path).count() == 0
    first = run("1", 0, 5)
    assert first == [(True, "new situation"), (False, "sent lately")] == run("1", 0, 5)
    rows = suppression.read_ledger(spark, path).collect()
    assert [(r.sink, r.digest, r.sent_at, len(r.headline), r.batch) for r in rows] == [("s", "d", at(0), 200, "1")]
    assert run("2", 10, 719, 720, 800, 1440) == [(False, "sent lately")] * 2 + [(True, "reminder"), (False, "sent lately"), (True, "reminder")]
    assert run("1", 0, 5) == first  # an old batch again: later messages don't count
    assert sorted(r.sent_at for r in suppression.read_ledger(spark, path).collect()) == [at(0), at(720), at(1440)]
    assert run("3", 1440) == [(False, "sent lately")]  # sent at this very time


def test_a_write_that_failed_half_way_leaves_the_table_as_it_was(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "v int, batch string"
    tables.put(spark.createDataFrame([(1, "a"), (2, "b")], kind), path, kind, ["batch"])
    broken = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("v"), F.lit("a").alias("batch"))
    with pytest.raises(Exception, match="lost"):
        tables.put(broken, path, kind, ["batch"])
    assert sorted(map(tuple, tables.read(spark, path, kind, ["batch"]).collect())) == [(1, "a"), (2, "b")]
    tables.put(spark.createDataFrame([(9, "a")], kind), path, kind, ["batch"])
    assert sorted(map(tuple, tables.read(spark, path, kind, ["batch"]).collect())) == [(2, "b"), (9, "a")]


# History


def observed(spark, rows):
    """(round, key, value) of day 1 + round // 10"""
    data = [("h", f"r{r}", T0 + dt.timedelta(days=r // 10), k, "metric", float(v)) for r, k, v in rows]
    return spark.createDataFrame(data, "host string, round_id string, as_of timestamp, key string, kind string, value_num double")


def held(spark, path, days=None):
    return sorted((r.round_id, r.key, r.value_num) for r in history_store.read(spark, path, days).collect())


def test_a_rewritten_round_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    assert held(spark, path) == []
    history_store.record(observed(spark, [(1, "a", 1), (1, "b", 2), (2, "a", 3), (11, "a", 4), (2, "a", 9)]), path, 1)
    assert held(spark, path) == [("r1", "a", 1), ("r1", "b", 2), ("r11", "a", 4), ("r2", "a", 9)]
    for _ in range(2):
        history_store.record(observed(spark, [(1, "a", 5)]), path, 2)
        assert held(spark, path) == [("r1", "a", 5), ("r11", "a", 4), ("r2", "a", 9)]
    before = held(spark, path)
    for day in ("2026-08-01", "2026-08-02", "2026-08-09"):
        history_store.compact(spark, path, day)
        history_store.compact(spark, path, day)
        assert held(spark, path) == before
    assert {(r.day, r.batch[-1]) for r in history_store.obsolete(spark, path).collect()} == {("2026-08-01", "1"), ("2026-08-01", "2"), ("2026-08-02", "1")}
    history_store.record(observed(spark, [(1, "a", 5)]), path, 2)  # a batch that a compaction holds already
    assert held(spark, path) == before
    history_store.record(observed(spark, [(2, "z", 7)]), path, 3)
    assert held(spark, path) == [("r1", "a", 5), ("r11", "a", 4), ("r2", "z", 7)] and held(spark, path, ("2026-08-02", "2026-08-02")) == [("r11", "a", 4)]
    assert history_store.rounds(spark, path).where("round_id = 'r2'").first().signals == 1
