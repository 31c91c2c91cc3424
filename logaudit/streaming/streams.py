"""The same work on streams: windows, late data, repeats, previous values, silence, suppression, spools."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logaudit.sources import snapshots


def timed(events: DataFrame, col: str = "ts", late: str = "60 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark: rows later than that are dropped and show in the query's
    progress. A time without a zone is read in the session's, which is UTC here."""
    return events.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, late)


def sliding_counts(events: DataFrame, by: list[str], length: str = "60 minutes", slide: str = "5 minutes", col: str = "ts") -> DataFrame:
    """Counts in sliding windows."""
    return events.groupBy(*by, F.window(col, length, slide).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), "n")


def tumbling_counts(events: DataFrame, by: list[str], length: str = "1 day", col: str = "ts") -> DataFrame:
    """Counts in rounds that don't overlap."""
    return sliding_counts(events, by, length, length, col)


def once(lines: DataFrame, keys: tuple[str, ...] = ("host", "file", "line_no")) -> DataFrame:
    """Each line once, though every poll reads the last hour again. The stream has a watermark."""
    return lines.dropDuplicatesWithinWatermark(list(keys))


def with_previous(signals: DataFrame) -> DataFrame:
    """``host, key, observed_at, value, prev``: each observation with the last strictly earlier one of its
    series. The state of a series is its two newest distinct times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last, before = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).sort_values(["observed_at", "value"], kind="stable")
        out = []
        for at, value in zip(rows["observed_at"], rows["value"], strict=True):
            at_us = int(at.value // 1000)
            if last_at is None or at_us > last_at:
                before, last_at, last = last, at_us, value
            elif at_us == last_at:
                last = max(last, value)
            out.append((*key, at, value, before))
        state.update((last_at, last, before))
        yield pd.DataFrame(out, columns=["host", "key", "observed_at", "value", "prev"])

    rows = signals.select("host", "key", "observed_at", "value")
    return rows.groupBy("host", "key").applyInPandasWithState(
        run, "host string, key string, observed_at timestamp, value double, prev double", "at long, value double, before double", "append", GroupStateTimeout.NoTimeout
    )


def silences(signals: DataFrame, hours: float) -> DataFrame:
    """``host, key, silent_since``: a series of which nothing has come for so long, by event time; reported once
    for each silence. The stream has a watermark on ``observed_at``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(*key, pd.Timestamp(last, unit="ms"))], columns=["host", "key", "silent_since"])
            return
        newest = max(int(f["observed_at"].max().value // 1_000_000) for f in frames)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + int(hours * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["host", "key", "silent_since"])

    return signals.select("host", "key", "observed_at").groupBy("host", "key").applyInPandasWithState(
        run, "host string, key string, silent_since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def suppressed(briefs: DataFrame, minutes: int = 720) -> DataFrame:
    """``sink, digest, as_of, send``: a situation is told if it never was, or not for so many minutes. The state is
    when it was last sent."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("as_of", kind="stable")
        out = []
        for at in rows["as_of"]:
            now = int(at.value // 1000)
            send = last is None or now - last >= minutes * 60_000_000
            last = now if send else last
            out.append((*key, at, send))
        state.update((last,))
        yield pd.DataFrame(out, columns=["sink", "digest", "as_of", "send"])

    return briefs.select("sink", "digest", "as_of").groupBy("sink", "digest").applyInPandasWithState(
        run, "sink string, digest string, as_of timestamp, send boolean", "last long", "append", GroupStateTimeout.NoTimeout
    )


def alert_spool(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Payloads that arrive in a spool folder, each file once, accepted or refused."""
    files = spark.readStream.schema("value string").option("wholetext", True).text(path)
    return snapshots.ingest_gate(files.select(F.col("value").alias("body")), most_bytes)
