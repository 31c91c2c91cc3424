"""Hierarchical multi-length packing.

A document's full windows are sequences of their own; its rest is routed to the shortest context tier that
holds it. Tiers are packed from long to short: a rest opens a sequence of its tier, and the gap behind it is
filled from shorter tiers, whole documents first and then a piece cut to fit. So sequences come out full, at a
power of two. Each task packs what it reads and pads at most one sequence. Step groups are balanced over all
tasks: every group gets its share of each tier.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logaudit.llm.common import written
from logaudit.llm.tokens import default_path, encoder

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a training step, over all its sequences.
STEP_TOKENS = 1 << 20
#: Rests of documents that a task holds before it packs them.
POOL = 8192


class Packer:
    """Packs documents as they come. Emits (document, start, length, sequence, offset, tier) tuples."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.size = tiers[-1]
        self.sequence = 0
        #: Waiting rests as (length, order of arrival, document, start), sorted.
        self.pool: list[tuple[int, int, int, int]] = []
        self.arrived = 0
        self.out: list[tuple[int, int, int, int, int, int]] = []

    def add(self, doc: int, n: int) -> None:
        """A document of n tokens, known by a number."""
        whole = n - n % self.size
        for start in range(0, whole, self.size):
            self._emit(self.size, [(doc, start, self.size)])
        if n > whole:
            self._wait(doc, whole, n - whole)

    def _wait(self, doc: int, start: int, length: int) -> None:
        insort(self.pool, (length, self.arrived, doc, start))
        self.arrived += 1

    def _emit(self, tier: int, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.sequence, offset, tier))
            offset += length
        self.sequence += 1

    def _fill(self, tier: int, pieces: list[tuple[int, int, int]], gap: int) -> bool:
        """Fills a gap from the pool, shorter rests first choice; false if the pool runs out before."""
        while gap:
            if not self.pool:
                return False
            at = bisect_right(self.pool, (gap, self.arrived + 1, 0, 0))
            if at:  # the longest that fits whole
                length, _, doc, start = self.pool.pop(at - 1)
                pieces.append((doc, start, length))
                gap -= length
            else:  # all are longer: cut the shortest, and its rest is routed anew
                length, _, doc, start = self.pool.pop(0)
                pieces.append((doc, start, gap))
                self._wait(doc, start + gap, length - gap)
                gap = 0
        return True

    def pack(self, down_to: int) -> None:
        """Packs the longest rests until so many wait."""
        while len(self.pool) > down_to:
            length, _, doc, start = self.pool.pop()
            tier = self.tiers[bisect_left(self.tiers, length)]
            pieces = [(doc, start, length)]
            if not self._fill(tier, pieces, tier - length):
                # The last rests of a task: whole tiers come off the front, what is left shares one sequence.
                for doc, start, length in pieces:
                    self._wait(doc, start, length)
                break
            self._emit(tier, pieces)

    def finish(self) -> None:
        """Packs all that waits: rests together shorter than the tier of the longest."""
        self.pack(0)
        rests = [(doc, start, length) for length, _, doc, start in reversed(self.pool)]
        self.pool = []
        left = sum(length for _, _, length in rests)
        for tier in reversed(self.tiers):
            while left >= tier:
                pieces, gap = [], tier
                while gap:
                    doc, start, length = rests.pop(0)
                    take = min(gap, length)
                    pieces.append((doc, start, take))
                    if take < length:
                        rests.insert(0, (doc, start + take, length - take))
                    gap -= take
                self._emit(tier, pieces)
                left -= tier
        if rests:
            self._emit(self.size, rests)


def _pieces(path: str, end: int, schema: T.StructType, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, coder = TaskContext.get().partitionId(), Packer(tiers), encoder(path)
        kept: dict[int, tuple[object, bytes]] = {}  # documents that may still have pieces to come
        number = 0
        stop = np.asarray([end], dtype="<u4").tobytes()
        kind = None

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            own = [kept[x[0]] for x in out]
            doc, start, length, sequence, offset, tier = zip(*out, strict=True) if out else ((),) * 6
            columns = [
                pa.array([d for d, _ in own], type=kind),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(ids[4 * s : 4 * (s + n)]) for (_, ids), s, n in zip(own, start, length, strict=True)], pa.int64()),
                pa.array([len(ids) // 4 for _, ids in own], pa.int64()),
                pa.array([(part << 40) + s for s in sequence], pa.int64()),
                pa.array(offset, pa.int64()),
                pa.array(tier, pa.int32()),
                pa.array([part] * len(out), pa.int32()),
            ]
            waiting = {x[2] for x in packer.pool}
            for d in [d for d in kept if d not in waiting]:
                del kept[d]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            kind, at = names.type, 0
            for ids, counts in coder.encode(texts):
                raw, start = ids.tobytes(), 0
                for n in counts.tolist():
                    kept[number] = (names[at].as_py(), raw[4 * start : 4 * (start + n)] + stop)
                    packer.add(number, n + 1)
                    start, at, number = start + n, at + 1, number + 1
                if len(packer.pool) >= POOL:
                    packer.pack(POOL // 4)
                yield rows()
        coder.trim()
        packer.finish()
        if kind is not None:
            yield rows()

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end: int = END,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``. A
    document is its ids and one end id, so an empty or null text is one token. A text of any length is cut
    into windows; repeated rows are packed as often as they come; null ids are kept; an empty table gives no
    rows; further columns are ignored. The last sequence of a task may be short of its tier and is padded.
    """
    key = docs.schema[id_col].dataType
    long, integer = T.LongType(), T.IntegerType()
    schema = T.StructType(
        [T.StructField("doc_id", key)]
        + [T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField(c, integer) for c in ("tier", "part")]
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer or default_path(), end, schema, tiers), schema), "pieces")
    return stepped(pieces, step_tokens)


def stepped(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """Adds ``step_group``: with S groups, the k-th of a tier's n sequences goes to group k * S / n, so that
    groups differ by one sequence of each tier at most. Tasks report counts; only these meet in one place."""
    firsts = pieces.where("offset = 0")
    counts = firsts.groupBy("part", "tier").count()
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_tier = counts.groupBy("tier").agg(F.sum("count").alias("n"))
    total = counts.agg(F.sum(F.col("count") * F.col("tier")).alias("tokens"))
    base = (
        counts.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .join(of_tier, "tier")
        .crossJoin(total)  # one row
        .select("part", "tier", "first", "n", F.greatest(F.lit(1), F.ceil(F.col("tokens") / step_tokens)).alias("groups"))
    )
    rank = F.row_number().over(Window.partitionBy("part", "tier").orderBy("sequence_id")) - 1
    grouped = (
        firsts.select("part", "tier", "sequence_id", rank.alias("rank"))
        .join(base, ["part", "tier"])
        .select("sequence_id", F.floor((F.col("first") + F.col("rank")) * F.col("groups") / F.col("n")).alias("step_group"))
    )
    return pieces.join(grouped, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
