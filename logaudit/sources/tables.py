"""Stored tables in a folder that the driver and all executors share: written in batches, each of which can be repeated."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``. Where that is unset and the master is local, as in tests, a
    temporary folder takes its place; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/stored/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows from a written table: later steps neither repeat the work nor depend on an executor that may be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ensure(spark: SparkSession, path: str, schema: T.StructType, by: list[str]) -> None:
    """Makes the table's folder; appending no rows leaves what is there as it is."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema: str, by: list[str]) -> DataFrame:
    """A stored table of this schema, partitioned by these of its columns; no rows if nothing was ever written."""
    kinds = T.StructType.fromDDL(schema)
    _ensure(spark, path, kinds, by)
    return spark.read.schema(kinds).parquet(path)


def put(rows: DataFrame, path: str, schema: str, by: list[str]) -> None:
    """Writes the partitions that occur in ``rows`` in place of what they held; others stay. So a batch that is written
    again, in part or whole, adds nothing. A partition that isn't among the rows can't be emptied this way."""
    kinds = T.StructType.fromDDL(schema)
    _ensure(rows.sparkSession, path, kinds, by)
    whole = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
