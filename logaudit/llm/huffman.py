"""Token ids in a binary file format: canonical length-limited Huffman codes in independent blocks.

Counts over all ids give code lengths of at most 20 bits; a code book of lengths is all that a reader needs.
A block holds consecutive documents in order of their ids. Every document starts at a byte, and every 128
tokens the block notes how many bits have passed, so that a reader can start at any of these places and
decodes all of them side by side from one table.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logaudit.llm.common import shared_dir, shuffle_width, written
from logaudit.llm.tokens import default_path, encoder

MAX_BITS = 20
SEGMENT = 128
BLOCK_TOKENS = 1 << 18
END = 0
#: Distinct ids that a code book, which every worker holds, may have.
MAX_SYMBOLS = 1 << MAX_BITS


# The code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, for counts over 0, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit into codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    own: list[np.ndarray] = []  # for each level, how many leaves are among its first k items
    packages = np.empty(0)
    for _ in range(limit):
        weights = np.concatenate((leaves, packages))
        by = np.argsort(weights, kind="stable")
        own.append(np.concatenate(([0], np.cumsum(by < n))))
        weights = weights[by]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for level in reversed(own):
        k = int(level[take])
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Book:
    """Canonical codes: shorter codes first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[by].astype(np.uint32), lengths[by].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(ids) else 1
        spans = (1 << (self.bits - self.lengths)).astype(np.int64)
        codes = (np.cumsum(spans) - spans) >> (self.bits - self.lengths)
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint8)
        self.code[self.ids], self.length[self.ids] = codes, self.lengths

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length by the next ``bits`` bits."""
        spans = 1 << (self.bits - self.lengths)
        ids, lengths = np.repeat(self.ids, spans), np.repeat(self.lengths, spans).astype(np.uint8)
        short = (1 << self.bits) - len(ids)  # a lone id leaves half of the table unused
        return np.pad(ids, (0, short)), np.pad(lengths, (0, short), constant_values=1)

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Documents end to end to bytes: the bytes, where each document starts in them, and the bits that
        each segment has."""
        n = self.length[ids].astype(np.int64)
        firsts = np.cumsum(counts) - counts
        run = np.concatenate(([0], np.cumsum(n)))
        bits = run[firsts + counts] - run[firsts]
        sizes = (bits + 7) // 8
        base = np.cumsum(sizes) - sizes
        at = run[:-1] + np.repeat(base * 8 - run[firsts], counts)
        words = np.zeros(int(sizes.sum()) // 4 + 3, dtype=np.uint64)
        if len(ids):
            value = self.code[ids] << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
            word = at >> 5
            group = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
            words[word[group]] |= np.bitwise_or.reduceat(value >> np.uint64(32), group)
            words[word[group] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), group)
        parts = -(-counts // SEGMENT)
        starts = np.repeat(firsts, parts) + _within(parts) * SEGMENT
        ends = np.minimum(starts + SEGMENT, np.repeat(firsts + counts, parts))
        return words.astype(">u4").tobytes(), base, run[ends] - run[starts]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the runs that have so many members."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def decode(table: tuple[np.ndarray, np.ndarray], bits: int, payload: bytes, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All ids of a block. ``counts``: tokens by document; ``marks``: bits by segment."""
    parts = -(-counts // SEGMENT)
    if not parts.sum():
        return np.empty(0, np.uint32)
    of = np.repeat(np.arange(len(counts)), parts)
    doc_bits = np.bincount(of, weights=marks, minlength=len(counts)).astype(np.int64)
    sizes = (doc_bits + 7) // 8
    run = np.cumsum(marks) - marks
    first = np.cumsum(parts) - parts
    run_of_doc = np.append(run, 0)[np.minimum(first, len(run) - 1)]
    at = run - run_of_doc[of] + ((np.cumsum(sizes) - sizes) * 8)[of]
    tokens = np.minimum(SEGMENT, counts[of] - _within(parts) * SEGMENT)
    out_at = np.cumsum(tokens) - tokens
    by = np.argsort(-tokens, kind="stable")
    at, out_at, tokens = at[by], out_at[by], tokens[by]
    raw = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    ids, lengths = table
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    live = np.searchsorted(-tokens, -np.arange(SEGMENT), side="left")  # segments with a token at this step
    down = np.uint32(32 - bits)
    for step in range(int(tokens[0])):
        n = live[step]
        pos = at[:n]
        key = (words[pos >> 3] << (pos & 7).astype(np.uint32)) >> down
        out[out_at[:n] + step] = ids[key]
        at[:n] = pos + lengths[key]
    return out


# The jobs


def _tokenised(path: str, end: int, names: list[str]):
    """Texts to rows of many documents: their ids, how many tokens each has, and all of these as planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at = 0
            for ids, counts in coder.encode(batch.column(1)):
                ended = np.insert(ids, np.cumsum(counts), np.uint32(end)).astype("<u4")
                docs = batch.column(0).slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), docs),
                        pa.array([(counts + 1).astype("<u4").tobytes()], pa.binary()),
                        pa.array([_planes(ended)], pa.binary()),
                    ],
                    names=names,
                )
        coder.trim()

    return run


def _planes(ids: np.ndarray) -> bytes:
    """Low and high bytes apart, and the ones above if there are any: what a general compressor does best with."""
    bytes_ = ids.view(np.uint8).reshape(-1, 4)
    return bytes_[:, : 2 if not len(ids) or ids.max() < 1 << 16 else 3].T.tobytes()


def _from_planes(planes: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint32)
    out = np.zeros((n, 4), dtype=np.uint8)
    for i, plane in enumerate(np.frombuffer(planes, dtype=np.uint8).reshape(-1, n)):
        out[:, i] = plane
    return out.view("<u4").reshape(-1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in batches:
        for counts, planes in zip(batch.column(0), batch.column(1), strict=True):
            n = int(np.frombuffer(counts.as_py(), dtype="<u4").sum(dtype=np.int64))
            now = np.bincount(_from_planes(planes.as_py(), n))
            size = max(len(now), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(now, (0, size - len(now)))
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])


def code_book(tokenised: DataFrame) -> DataFrame:
    """``id, length`` for each id that occurs. Each task counts what it reads; counts of an id are summed; the
    sums, at most ``MAX_SYMBOLS``, come to the driver."""
    counts = tokenised.select("counts", "planes").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.limit(MAX_SYMBOLS + 1).toPandas().sort_values("id")
    if len(rows) > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} distinct ids")
    rows["length"] = code_lengths(rows["n"].to_numpy())
    return tokenised.sparkSession.createDataFrame(rows[["id", "length"]], "id long, length long")


def _encoded(book, bounds: list[int]):
    """Documents to their bytes, and the range of ids that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts, planes in zip(*batch.columns, strict=True):
                all_counts = np.frombuffer(counts.as_py(), dtype="<u4").astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(all_counts)))
                ids = _from_planes(planes.as_py(), int(ends[-1]))
                for k in range(0, len(all_counts), 256):
                    counts = all_counts[k : k + 256]
                    payload, base, marks = book.value.encode(ids[ends[k] : ends[k + len(counts)]], counts)
                    parts = -(-counts // SEGMENT)
                    cut = np.cumsum(parts)[:-1]
                    own = docs.values.slice(k, len(counts))
                    key = own.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                    sizes = (np.add.reduceat(marks, np.cumsum(parts) - parts) + 7) // 8
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.searchsorted(bounds, key, side="left"), pa.int32()),
                            own,
                            pa.array(counts, pa.int64()),
                            pa.array([payload[a : a + n] for a, n in zip(base.tolist(), sizes.tolist(), strict=True)], pa.binary()),
                            pa.array([x.astype("<u2").tobytes() for x in np.split(marks, cut)], pa.binary()),
                        ],
                        names=["part", "doc_id", "n", "bits", "marks"],
                    )

    return run


def _blocks(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, block, start, tokens = None, 0, 0, 0

        def row() -> pa.RecordBatch:
            docs = [x[1] for x in held]
            counts = np.asarray([x[2] for x in held], dtype="<u4")
            values = [part, block, start, int(counts.sum(dtype=np.int64)), docs, counts.tobytes(), b"".join(x[3] for x in held), b"".join(x[4] for x in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, kinds, strict=True)], names=schema.names)

        for batch in batches:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(batch.column(1).type), pa.binary(), pa.binary(), pa.binary()]
            columns = [c.to_pylist() for c in batch.columns]
            for doc in zip(*columns, strict=True):
                if held and (doc[0] != part or tokens >= BLOCK_TOKENS):
                    yield row()
                    block, start, held = block + 1, start + tokens, []
                    tokens = 0
                if doc[0] != part:
                    part, block, start = doc[0], 0, 0
                held.append(doc)
                tokens += doc[2]
        if held:
            yield row()

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END) -> None:
    """Writes the ids of all texts, each with an end id, under ``path``: ``book`` and ``blocks``.

    Documents lie in ascending order of their integer ids: ranges of ids by quantiles, and in each its
    blocks. Null ids come first; rows of one id follow each other, shorter ones first; empty and null texts
    are an end id; a text of any length is one document of one block; an empty table gives an empty book and
    no blocks; further columns are ignored.
    """
    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("docs", T.ArrayType(key)), T.StructField("counts", T.BinaryType()), T.StructField("planes", T.BinaryType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokenised = written(rows.mapInArrow(_tokenised(tokenizer or default_path(), end, schema.names), schema), "tokenised")
    book = code_book(tokenised)
    book.coalesce(1).write.parquet(f"{path}/book")
    spark = docs.sparkSession
    codes = spark.sparkContext.broadcast(_read_book(spark, path))  # bounded: at most MAX_SYMBOLS codes
    width = shuffle_width(spark)
    fractions = [i / width for i in range(1, width)]
    each = tokenised.select(F.explode(F.col("docs").cast("array<long>")).alias("doc_id"))
    bounds = each.agg(F.percentile_approx("doc_id", fractions, 100 * width).alias("b")).first().b if fractions else []
    coded = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("doc_id", key), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.BinaryType()) for c in ("bits", "marks")]
    )
    blocks = T.StructType(
        [T.StructField("part", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("block", "start", "tokens")]
        + [T.StructField("docs", T.ArrayType(key))]
        + [T.StructField(c, T.BinaryType()) for c in ("counts", "bits", "marks")]
    )
    (
        tokenised.mapInArrow(_encoded(codes, list(bounds or [])), coded)
        .repartition(width, "part")
        .sortWithinPartitions("part", "doc_id", "n", "bits")
        .mapInArrow(_blocks(blocks), blocks)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


def _read_book(spark: SparkSession, path: str) -> Book:
    rows = spark.read.schema("id long, length long").parquet(f"{path}/book").toPandas()
    return Book(rows["id"].to_numpy(), rows["length"].to_numpy())


def _decoded(book, schema: T.StructType, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = book.value.table()
        for batch in batches:
            for k in range(len(batch)):
                start, docs, counts, payload, marks = (batch.column(i)[k] for i in range(5))
                counts = np.frombuffer(counts.as_py(), dtype="<u4").astype(np.int64)
                marks = np.frombuffer(marks.as_py(), dtype="<u2").astype(np.int64)
                raw = decode(table, book.value.bits, payload.as_py(), counts, marks).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                firsts = ends - counts
                view = memoryview(raw)
                ids = [view[4 * a : 4 * b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                last = pa.array(map(zlib.crc32, ids), pa.int64()) if digests else pa.array(map(bytes, ids), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(start.as_py() + firsts, pa.int64()), pa.array(counts, pa.int64()), last],
                    names=schema.names,
                )

    return run


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document: the ids before it in the whole, and its own as
    little-endian unsigned 32-bit integers. Each block is decoded by itself. With ``digests`` the CRC-32 of
    those bytes, ``ids_crc32``, takes their place."""
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["docs"].dataType.elementType
    codes = spark.sparkContext.broadcast(_read_book(spark, path))
    sums = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    schema = T.StructType(
        [T.StructField("doc_id", key), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()) if digests else T.StructField("ids", T.BinaryType())]
    )
    placed = blocks.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("start")).alias("start"), "docs", "counts", "bits", "marks")
    return placed.mapInArrow(_decoded(codes, schema, digests), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, written and read back."""
    path = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read(spark, path, digests=True)
