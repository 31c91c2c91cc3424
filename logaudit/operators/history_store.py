"""History as a stored table: rounds are written in batches, the last batch of a round counts, days are compacted.

The table is partitioned by day and batch. Batches sort by their names, which are numbers of one width. A round that is
written again by a later batch replaces all of its rows; a batch that is written again replaces itself. Compacting a day
writes what counts in it as one more batch, named after the last one that it holds, and everything up to there is
ignored from then on; so a compaction that fails half way changes nothing, and what it replaces can be removed later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.operators import history
from logaudit.sources import tables

OBSERVATIONS = (
    "host string, round_id string, as_of timestamp, key string, name string, kind string, value_num double, value_text string, unit string, "
    "observed_at timestamp, labels map<string,string>, day string, batch string"
)
_BY = ["day", "batch"]
_MERGED = "c"


def batch_name(number: int) -> str:
    return f"{number:012d}"


def record(signals: DataFrame, path: str, batch: int, order: str | None = None) -> None:
    """Writes the signals of rounds as a batch. Of several rows of one key in a round the last by ``order`` counts, or the
    one of greatest values. A signal's day is that of its round's end; every round has a row at least."""
    rows = signals.withColumns({c: F.lit(None).cast(kind) for c, kind in (x.split(" ", 1) for x in OBSERVATIONS.split(", ")) if c not in (*signals.columns, *_BY)})
    rows = rows.withColumn("_order", F.col(order) if order else F.struct("value_num", "value_text"))
    kept = history.last_write(rows, "_order").drop("_order")
    kept = kept.withColumns({"day": F.date_format("as_of", "yyyy-MM-dd"), "batch": F.lit(batch_name(batch))})
    tables.put(kept, path, OBSERVATIONS, _BY)


def _all(spark: SparkSession, path: str) -> DataFrame:
    return tables.read(spark, path, OBSERVATIONS, _BY)


def _batches(rows: DataFrame) -> DataFrame:
    """``day, floor``: the last compaction of each day that has one. A row for each day; the table's files aren't read but
    for their partitions."""
    return rows.where(F.col("batch").endswith(_MERGED)).groupBy("day").agg(F.max("batch").alias("floor"))


def read(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Observations of the last batch of each round, of all days or of those from one to another. ``days`` prunes
    partitions. A window holds one round."""
    rows = _all(spark, path)
    if days is not None:
        rows = rows.where(F.col("day").between(*days))
    live = rows.join(F.broadcast(_batches(rows)), "day", "left").where(F.col("floor").isNull() | (F.col("batch") >= F.col("floor"))).drop("floor")
    last = F.max("batch").over(Window.partitionBy("host", "round_id", "day"))
    return live.withColumn("_last", last).where("batch = _last").select(*[c for c in rows.columns if c != "day"], "day").drop("batch", "day")


def rounds(spark: SparkSession, path: str) -> DataFrame:
    """A row for each round: its end, signals and errors."""
    return read(spark, path).groupBy("host", "round_id").agg(F.max("as_of").alias("as_of"), F.count("*").alias("signals"), F.count_if(F.col("kind") == "error").alias("errors"))


def compact(spark: SparkSession, path: str, day: str) -> None:
    """Writes what counts on a day as one batch. A batch written again later, which it already holds, stays ignored."""
    own = _all(spark, path).where(F.col("day") == day)
    newest = own.agg(F.max("batch").alias("b")).first().b
    if newest is None or newest.endswith(_MERGED):
        return
    rows = tables.cut(read(spark, path, (day, day)), "compacted")
    tables.put(rows.withColumns({"day": F.lit(day), "batch": F.lit(newest + _MERGED)}), path, OBSERVATIONS, _BY)


def obsolete(spark: SparkSession, path: str) -> DataFrame:
    """``day, batch`` of the partitions that a compaction has replaced and that may be removed."""
    rows = _all(spark, path)
    return rows.select("day", "batch").distinct().join(F.broadcast(_batches(rows)), "day").where("batch < floor").select("day", "batch")


def in_order(captures: DataFrame) -> DataFrame:
    """Captures (``host, name, as_of`` text) with ``pos``, the order of replaying them: by the text of their time, by name
    where they have none, and by name if these are equal."""
    at = F.coalesce(F.nullif(F.trim("as_of"), F.lit("")), "name")
    return captures.withColumn("pos", F.row_number().over(Window.partitionBy("host").orderBy(at, "name")))
