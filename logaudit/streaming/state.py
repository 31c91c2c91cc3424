"""Streams with state for each series or situation, started from the batch history.

Each is a processor of ``transformWithStateInPandas``: the state store has to be RocksDB (``use_rocksdb``). The initial
state is what a batch job has stored, so a stream that takes over gives what the batch would have given next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from logaudit.schemas import SIGNAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(times: pd.Series) -> list[int]:
    return (times.astype("int64") // (1 if str(times.dtype).startswith("datetime64[us") else 1000)).tolist()


def _renew(handle: StatefulProcessorHandle, micros: int, timer_values) -> None:
    """The key's only timer, by event time."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(max(micros // 1000, timer_values.getCurrentWatermarkInMs() + 1))


class _Previous(StatefulProcessor):
    """The two newest distinct times of a series, with the greatest value of each; a timer gives them up."""

    def __init__(self, hours: float | None):
        self.keep = None if hours is None else int(hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at long, value double, before double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._step(key, initialState, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def _step(self, key, rows: pd.DataFrame, timer_values) -> list[tuple]:
        at0, last, before = self.state.get() if self.state.exists() else (None, None, None)
        rows = rows.sort_values(["observed_at", "value"], kind="stable")
        out = []
        for t, at, value in zip(rows["observed_at"], _micros(rows["observed_at"]), rows["value"], strict=True):
            if at0 is None or at > at0:
                before, at0, last = last, at, value
            elif at == at0:
                last = max(last, value)
            out.append((*key, t, value, before))
        self.state.update((at0, last, before))
        if self.keep is not None:
            _renew(self.handle, at0 + self.keep, timer_values)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield pd.DataFrame(self._step(key, pd.concat(list(rows)), timerValues), columns=["host", "key", "observed_at", "value", "prev"])


def with_previous(signals: DataFrame, history: DataFrame | None = None, keep_hours: float | None = None) -> DataFrame:
    """``host, key, observed_at, value, prev``: each observation with the last strictly earlier one of its series, from the
    stream or from ``history`` (the same columns without ``prev``, of which each series' newest is enough). With
    ``keep_hours`` the state of a series that isn't seen for so long by event time is given up; the stream then has a
    watermark on ``observed_at``."""
    columns = ["host", "key", "observed_at", "value"]
    first = None if history is None else history.select(*columns).groupBy("host", "key")
    return signals.select(*columns).groupBy("host", "key").transformWithStateInPandas(
        _Previous(keep_hours), "host string, key string, observed_at timestamp, value double, prev double", "Append", "None" if keep_hours is None else "EventTime", first
    )


class _Silence(StatefulProcessor):
    """When a series was last seen, and a timer for when that will be too long ago."""

    def __init__(self, hours: float):
        self.wait = int(hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "at long")

    def _seen(self, times: list[int], timer_values) -> list[int]:
        """Times since which the series was silent until it came back: gaps that no timer has told yet."""
        last = self.state.get()[0] if self.state.exists() else None
        newer, gaps = sorted(t for t in set(times) if last is None or t > last), []
        for t in newer:
            if last is not None and t - last >= self.wait:
                gaps.append(last)
            last = t
        if newer:
            self.state.update((last,))
            _renew(self.handle, last + self.wait, timer_values)
        return gaps

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._seen([max(_micros(initialState["observed_at"]))], timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        gaps = self._seen([t for f in rows for t in _micros(f["observed_at"])], timerValues)
        yield pd.DataFrame([(*key, pd.Timestamp(t, unit="us")) for t in gaps], columns=["host", "key", "silent_since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (last,) = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(*key, pd.Timestamp(last, unit="us"))], columns=["host", "key", "silent_since"])


def silences(signals: DataFrame, hours: float, history: DataFrame | None = None) -> DataFrame:
    """``host, key, silent_since``: a series that hasn't been seen for so long by event time, told once for each silence: by
    a timer, or when it comes back before the watermark has got there. The stream has a watermark on ``observed_at``. A series of ``history`` is awaited too, though the stream never
    brings it."""
    columns = ["host", "key", "observed_at"]
    first = None if history is None else history.select(*columns).groupBy("host", "key")
    return signals.select(*columns).groupBy("host", "key").transformWithStateInPandas(
        _Silence(hours), "host string, key string, silent_since timestamp", "Append", "EventTime", first
    )


class _Suppression(StatefulProcessor):
    """When a situation was last told. Once the interval has passed the state says nothing any more, and a timer clears it."""

    def __init__(self, minutes: int):
        self.gap = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sent", "at long")

    def _told(self, at: int, timer_values) -> None:
        self.state.update((at,))
        _renew(self.handle, at + self.gap, timer_values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        last = self.state.get() if self.state.exists() else ()
        self._told(max([*last, *_micros(initialState["sent_at"])]), timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[0] if self.state.exists() else None
        whole = pd.concat(list(rows)).sort_values("as_of", kind="stable")
        out = []
        for t, at in zip(whole["as_of"], _micros(whole["as_of"]), strict=True):
            send = last is None or at - last >= self.gap
            last = at if send else last
            out.append((*key, t, send))
        self._told(last, timerValues)
        yield pd.DataFrame(out, columns=["sink", "digest", "as_of", "send"])


def suppressed(briefs: DataFrame, minutes: int = 720, ledger: DataFrame | None = None) -> DataFrame:
    """``sink, digest, as_of, send``: a situation is told if it never was, or not for so many minutes; the stored ledger of
    messages (``sink, digest, sent_at``) is the initial state. The stream has a watermark on ``as_of``, and the state of a
    situation is cleared when that has passed the interval, so a stream that replays the past decides the same."""
    first = None if ledger is None else ledger.select("sink", "digest", "sent_at").groupBy("sink", "digest")
    return briefs.select("sink", "digest", "as_of").groupBy("sink", "digest").transformWithStateInPandas(
        _Suppression(minutes), "sink string, digest string, as_of timestamp, send boolean", "Append", "EventTime", first
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that queries have dropped behind their watermark, for as long as the session lives.

    ``spark.streams.addListener(late)`` starts it. Spark reports what stateful operators drop; an aggregation reports
    rows after it has added them up in part, ``streams.once`` reports each row."""

    def __init__(self) -> None:
        self.dropped: dict[tuple[str, int], tuple[str, str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        n = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.dropped[str(p.id), p.batchId] = (p.name or str(p.id), p.timestamp, n)  # a repeated batch counts once

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def signals(self, spark: SparkSession, host: str) -> DataFrame:
        """A signal for each query that has dropped rows: an error, since what was dropped isn't counted anywhere."""
        totals: dict[str, tuple[int, str]] = {}
        for name, at, n in self.dropped.values():
            total, newest = totals.get(name, (0, at))
            totals[name] = (total + n, max(newest, at))
        rows = [(host, name, float(n), at) for name, (n, at) in totals.items() if n]
        found = spark.createDataFrame(rows, "host string, query string, n double, at string").withColumn("at", F.to_timestamp("at"))
        values = {
            "host": F.col("host"), "round_id": F.date_format("at", "yyyy-MM-dd"), "as_of": F.col("at"), "observed_at": F.col("at"), "name": F.lit("late_rows"),
            "key": F.concat(F.lit("late_rows{query="), "query", F.lit("}")), "kind": F.lit("error"), "value_num": F.col("n"), "source": F.col("query"),
            "value_text": F.concat(F.col("n").cast("bigint").cast("string"), F.lit(" rows came too late")), "labels": F.create_map(F.lit("query"), F.col("query")),
        }
        kinds = [c.split(" ", 1) for c in SIGNAL.split(", ") if not c.startswith("evidence")]
        return found.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds])
