"""Importance resampling towards a target distribution, over hashed runs of words.

Each text becomes a stream of 16-bit bucket numbers. The streams of many documents are packed into rows with the
documents' offsets and written once. A first pass over them sorts each packed stream, counts its runs and sums the
counts of all; a second pass gathers the buckets' gains along the streams and adds them up between the offsets. So
texts are read and hashed once, and what is kept in memory is one packed stream and one number for each bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logaudit.llm.common import written
from logaudit.llm.sharding import numbered

#: Buckets of features; they have to fit into 16 bits.
BUCKETS = 10_000
#: Words in a feature, at most.
LONGEST = 3
#: Features in a packed row: rows are closed at or above it, so that a row is a few MB or one document.
PACKED = 1 << 20
SEED = 42
#: Documents with fewer words aren't drawn.
LEAST_WORDS = 20
#: Of a hundred such documents, so many are drawn.
PERCENT = 5

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)  # A-Z lowered; what isn't part of a word becomes a blank


def bucket_stream(text: bytes | None) -> tuple[int, np.ndarray]:
    """The number of words and the buckets of all runs of 1 to 3 words: first single words, then pairs, then threes.

    The checksum of a longer run carries on from the one that is a word shorter, so no run is ever built.
    """
    words = text.translate(_FOLD).split() if text else []
    tails = [b" " + w for w in words]
    runs = list(map(zlib.crc32, words))
    parts = [runs]
    for n in range(1, LONGEST):
        runs = list(map(zlib.crc32, tails[n:], runs))
        parts.append(runs)
    crcs = np.concatenate([np.array(p, dtype=np.uint32) for p in parts])
    return len(words), (crcs % np.uint32(BUCKETS)).astype("<u2")


def _packed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        words: list[int] = []
        streams: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, pa.array(words, pa.int64()), pa.array(offsets, pa.int64()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([np.concatenate(streams).tobytes()], pa.binary())], names=names)

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                n, stream = bucket_stream(text.as_py())
                ids.append(batch.column(0).slice(i, 1))
                words.append(n)
                streams.append(stream)
                held += len(stream)
                if held >= PACKED or len(ids) >= 1 << 16:
                    yield row()
                    ids, words, streams, held = [], [], [], 0
        if ids:
            yield row()

    return run


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "streams") -> DataFrame:
    """Packed rows ``ids, words, offsets, stream``, written to the shared folder: of each document its id, its number
    of words and where its buckets begin, then the buckets themselves as little-endian 16-bit numbers."""
    key = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("ids", T.ArrayType(key)), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written(rows.mapInArrow(_packed(schema.names), schema), name)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for stream in batch.column(0):
            values = np.sort(np.frombuffer(stream.as_buffer(), dtype="<u2"), kind="stable")  # a radix sort
            if len(values):
                begins = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
                total[values[begins]] += np.diff(np.append(begins, len(values)))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])


def bucket_counts(packed: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all streams. Each task sends one row for each bucket at most; the sums, at most
    ``BUCKETS`` rows, come to the driver."""
    rows = packed.select("stream").mapInArrow(_run_lengths, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, smoothed by one, as integers."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weighed(gain, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*batch.columns, strict=True):
                bounds = offsets.values.to_numpy()
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                weights = np.zeros(len(sizes), dtype=np.int64)
                if len(some):
                    along = gain.value[np.frombuffer(stream.as_buffer(), dtype="<u2")]
                    weights[some] = np.add.reduceat(along, bounds[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=names)

    return run


def noise(id_col: Column, seed: int) -> Column:
    """A draw of the Gumbel distribution in thousandths, from a hash of seed and id. A null id counts as ''."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``<id_col>, n_words, n_features, weight, score, rank`` for each row of ``docs``.

    ``weight`` adds up the gains of a text's features, ``score`` adds noise of the row's id to it, and the rows with the
    greatest scores among those of at least ``least_words`` words are drawn: ``percent`` of a hundred, ranked from 1;
    the others have no rank. Equal scores go by the smaller id (null first), then by features and weight, so repeated
    rows have ranks of their own. A null or empty text has no features and weight 0; one text is held in one task, and
    may be of any length that a stream of 2 GB can hold; an empty table gives no rows, an empty target gives gains
    against nothing seen; further columns of either table are ignored, whatever their names.
    """
    spark = docs.sparkSession
    packed = streams(docs, id_col, text_col)
    aims = streams(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), "_id", "_text", "target")
    gain = spark.sparkContext.broadcast(gains(bucket_counts(packed), bucket_counts(aims)))  # one number for each bucket
    key = packed.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("_id", key)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    rows = packed.mapInArrow(_weighed(gain, schema.names), schema)
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "scored")
    able = F.col("n_words") >= least_words
    most = scored.where(able).count() * percent // 100
    order = scored.where(able).select("*", (-F.col("score")).alias("_low"), F.lit(0).alias("_all"))
    placed = numbered(order, "_all", ["_low", "_id", "n_features", "weight"]).withColumn("rank", F.when(F.col("slot") < most, F.col("slot") + 1))
    names = ["_id", "n_words", "n_features", "weight", "score", "rank"]
    out = placed.select(*names).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*names))
    return out.withColumnRenamed("_id", id_col)


def drawn(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that were drawn, with all their columns. Ids have to be unique: rows of one id stay or go
    together. A row without an id is never drawn."""
    return docs.join(scores.where("rank is not null").select(id_col).distinct(), id_col, "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents towards the texts of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = importance(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f"

SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)
              ORDER BY i) AS t
  FROM range(0, 256) r(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), b AS (
  SELECT {_SQL_WORDS} AS w FROM benchmark
), df AS (
  SELECT r, f, count(*) AS n FROM (SELECT r, {_SQL_FEATURES} FROM d) GROUP BY ALL
), bf AS (
  SELECT f, count(*) AS n FROM (SELECT {_SQL_FEATURES} FROM b) GROUP BY ALL
), x AS (
  SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT f FROM df UNION SELECT f FROM bf)
), k AS (
  SELECT f, xor(list_reduce(list_transform(range(0, n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM x, crc_table
), s AS (
  SELECT bucket, sum(n) AS n FROM df JOIN k USING (f) GROUP BY ALL
), t AS (
  SELECT bucket, sum(n) AS n FROM bf JOIN k USING (f) GROUP BY ALL
), g AS (
  SELECT i AS bucket,
         floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE
               / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range(0, {BUCKETS}) q(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i
), weights AS (
  SELECT r, sum(n * gain) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY ALL
), scored AS (
  SELECT doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features,
         coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place,
         count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank
FROM ranked
"""
