"""What sources have delivered for a round, and what they haven't: a source that fails becomes a row, not a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logaudit.functions.text import series_key
from logaudit.schemas import SIGNAL

#: Where a source's rows lie below the root, and the parts of its path that say whose they are.
KEYS = ("host", "round_id", "source")
FAILED = "source_failed"


def expected_sources(rounds: DataFrame, sources: DataFrame) -> DataFrame:
    """The manifest ``host, round_id, as_of, source``: every source of its host in every round. ``sources``: host and
    source, a small table of configuration."""
    return rounds.select("host", "round_id", "as_of").distinct().join(sources.select("host", "source").distinct(), "host")


def deliver(signals: DataFrame, root: str) -> None:
    """Writes signals as sources do: JSON lines below ``host=/round_id=/source=``, and as the last line of a source how
    many there were. ``signals`` has those three columns and any of the declared ones of a signal."""
    own = [c for c in signals.columns if c not in KEYS]
    rows = signals.select(*KEYS, F.to_json(F.struct(*own)).alias("value"), F.lit(0).alias("last"))
    ends = signals.groupBy(*KEYS).agg(F.to_json(F.struct(F.count("*").alias("delivered"))).alias("value")).withColumn("last", F.lit(1))
    rows.unionByName(ends).repartition(*KEYS).sortWithinPartitions(*KEYS, "last").select(*KEYS, "value").write.mode("append").partitionBy(*KEYS).text(root)


def delivered(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all sources below a root. A line that is no JSON object is kept in ``_broken``; a file that can't be read
    to its end (as a damaged ``.gz``) gives what could be read of it, one that has gone nothing."""
    kinds = ", ".join(c for c in SIGNAL.replace("array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>", "E").split(", ") if c.split()[0] not in KEYS)
    schema = kinds.replace(" E", " array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>") + ", delivered bigint, _broken string, " + ", ".join(f"{k} string" for k in KEYS)
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE")
    return reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false").option("basePath", root).json(root)


def failures(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``host, round_id, source, as_of, reason`` of each source that is expected and gave nothing, gave lines that can't be
    read, or stopped before it said how many rows there were. A source that no manifest expects can fail too."""
    plain = F.col("_broken").isNull()
    seen = rows.groupBy(*KEYS).agg(
        F.count_if(~plain).alias("broken"), F.count_if(plain & F.col("delivered").isNull()).alias("n"), F.sum("delivered").alias("told"), F.max("as_of").alias("_at")
    )
    reason = (
        F.when(F.col("n").isNull(), "nothing was delivered")
        .when(F.col("broken") > 0, F.concat(F.col("broken").cast("string"), F.lit(" lines can't be read")))
        .when(F.col("told").isNull(), F.concat(F.lit("cut short after "), F.col("n").cast("string"), F.lit(" rows")))
        .when(F.col("told") != F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("told").cast("string"), F.lit(" rows")))
    )
    due = manifest.groupBy(*KEYS).agg(F.max("as_of").alias("as_of"))
    return due.join(seen, list(KEYS), "full").select(*KEYS, F.coalesce("as_of", "_at").alias("as_of"), reason.alias("reason")).where("reason is not null")


def collect_round(spark: SparkSession, root: str, manifest: DataFrame, keep_partial: bool = False) -> DataFrame:
    """The signals of all sources below a root, and an error signal for each source that failed.

    What a failed source has given before is left out, since a count that was cut short would read like a low one, unless
    ``keep_partial``; rows of other sources stay as they are. Keys are made where a source gives none. An empty root
    gives an error row for each expected source; repeated rows of a manifest count once.
    """
    rows = delivered(spark, root)
    failed = failures(rows, manifest)
    good = rows.where("_broken is null and delivered is null").drop("_broken", "delivered")
    if not keep_partial:
        good = good.join(failed.select(*KEYS), list(KEYS), "left_anti")
    good = good.withColumn("key", F.coalesce("key", series_key(F.col("name"), F.coalesce("labels", F.create_map().cast("map<string,string>")))))
    labels = F.create_map(F.lit("source"), F.col("source"))
    note = "this source gave no observations in the round: what it would have measured is unknown, not zero"
    errors = failed.select(
        "host", "round_id", "as_of", F.lit(FAILED).alias("name"), F.lit("error").alias("kind"), F.col("reason").alias("value_text"), "source",
        labels.alias("labels"), series_key(F.lit(FAILED), labels).alias("key"), F.col("as_of").alias("observed_at"), F.lit(note).alias("note"),
    )
    return good.unionByName(errors, allowMissingColumns=True)
