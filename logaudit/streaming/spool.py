"""Bodies that arrive in a folder go into a spool, or aside with a reason: two tables, each body once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logaudit.sources import snapshots, tables

ACCEPTED = "file string, body string, bytes bigint, batch string"
REFUSED = "file string, bytes bigint, reason string, batch string"


def gated(bodies: DataFrame, most_bytes: int) -> DataFrame:
    """Bodies (``file, body``) with their size, whether they are accepted, and why not."""
    return snapshots.ingest_gate(bodies, most_bytes).withColumn("bytes", F.octet_length("body").cast("bigint"))


def _write(rows: DataFrame, path: str, batch: str) -> None:
    """Both sides of one batch. Each is a partition that a repetition writes anew, so a batch that was stopped after
    the first side, or within one, leaves each body once when it is repeated."""
    rows = rows.withColumn("batch", F.lit(batch)).persist()
    try:
        tables.put(rows.where("accepted"), f"{path}/accepted", ACCEPTED, ["batch"])
        tables.put(rows.where("not accepted"), f"{path}/refused", REFUSED, ["batch"])
    finally:
        rows.unpersist()


def spool(spark: SparkSession, inbox: str, path: str, checkpoint: str, most_bytes: int = 1 << 20, name: str = "spool") -> StreamingQuery:
    """Starts a stream from a folder of bodies, one a file, into ``path/accepted`` (as they came) and ``path/refused`` (file,
    size and reason, without the body). An empty file holds no body and is passed over. It runs over what is there and stops; start it again for more.

    A batch is named after the query and its number. Both last as long as the checkpoint, so a stream with a new
    checkpoint never writes over what an older one has left, but it reads the folder again from its beginning.
    """
    files = spark.readStream.schema("value string").option("wholetext", True).text(inbox)
    bodies = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))

    def both(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _write(rows, path, f"{query}-{number:09d}")

    started = gated(bodies, most_bytes).writeStream.queryName(name).foreachBatch(both).option("checkpointLocation", checkpoint)
    return started.trigger(availableNow=True).start()


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The bodies in the spool."""
    return tables.read(spark, f"{path}/accepted", ACCEPTED, ["batch"])


def refused(spark: SparkSession, path: str) -> DataFrame:
    """Files that were refused, and why."""
    return tables.read(spark, f"{path}/refused", REFUSED, ["batch"])
