"""What the corpus operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``. Where that is unset and the master is local, as in
    tests on one machine, a temporary folder takes its place; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that later steps neither repeat the
    work nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for a deliberate repartitioning: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a few numbers that may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose narrow rows are known to be so many: to be broadcast if these are few enough, else to be
    joined as Spark sees fit."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges between long ids.

    Returns ``node, component`` (the smallest node that can be reached) for each node of an edge.
    Self-loops and null ends are ignored. Alternates the large-star and small-star steps; every step is a
    minimum for each node followed by a join, so a node of any degree is never gathered in one task.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(
        edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"), (x.isNull() | y.isNull()).alias("bad"))
        .where("not bad and u <> v")
        .select("u", "v")
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = written(
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "star",
        )
        # A sum of wrapped hashes and a count tell whether the edges have changed.
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    children = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return children.union(roots.join(children.select("node"), "node", "left_anti"))
