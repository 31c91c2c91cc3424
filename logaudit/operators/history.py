"""Observations against their own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write(observations: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("host", "round_id", "key")) -> DataFrame:
    """One row for each key of a round: the last one written."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return observations.withColumn("_r", rank).where("_r = 1").drop("_r")


def with_previous(observations: DataFrame, fields: tuple[str, ...] = ("value_num", "value_text", "observed_at"), keys: tuple[str, ...] = ("host", "key")) -> DataFrame:
    """Adds ``prev``: the newest strictly earlier observation of the same series. Equal times don't see each
    other; of several at that earlier time the greatest values count."""
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))
    before = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.struct(at.alias("_at"), *fields)).over(before)
    return observations.withColumn("prev", newest)


def last_n(observations: DataFrame, n: int = 24) -> DataFrame:
    """The newest n of each series, newest first."""
    rank = F.row_number().over(Window.partitionBy("host", "key").orderBy(F.desc("observed_at")))
    return observations.withColumn("pos", rank).where(F.col("pos") <= n)


def silent(observations: DataFrame, rounds: DataFrame, hours: int = 24, churn: tuple[str, ...] = ("source=", "service=")) -> DataFrame:
    """``host, round_id, key``: series seen in ``[as_of - hours, as_of)`` but not in the round itself.

    An observation meets the rounds of its own span of ``hours`` and of the next one alone, and of these the ones
    until the series is seen again. Series with churning labels are left out.
    """
    at = F.col("observed_at")
    follow = Window.partitionBy("host", "key").orderBy("observed_at")
    seen = observations.select("host", "key", "observed_at").distinct()
    seen = seen.where(~F.greatest(*[F.col("key").contains(c) for c in churn])).withColumn("_next", F.lead("observed_at").over(follow))
    span = lambda t: F.floor(F.unix_micros(t) / (hours * 3_600_000_000))
    r = rounds.select("host", "round_id", "as_of", span(F.col("as_of")).alias("span"))
    seen = seen.withColumn("span", F.explode(F.array(span(at), span(at) + 1)))
    met = seen.join(r, ["host", "span"]).where((at < F.col("as_of")) & (at >= F.col("as_of") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("_next").isNull() | (F.col("_next") > F.col("as_of"))))
    current = observations.select("host", "round_id", "key").distinct()
    return met.select("host", "round_id", "key").distinct().join(current, ["host", "round_id", "key"], "left_anti")


def round_stats(signals: DataFrame) -> DataFrame:
    """Signals and errors of each round."""
    return signals.groupBy("host", "round_id").agg(F.count("*").alias("signals"), F.count_if(F.col("kind") == "error").alias("errors"))


def changed(prev: Column, now: Column) -> Column:
    """Both known and different."""
    return prev.isNotNull() & ~prev.eqNullSafe(now)
