"""SimHash near-duplicates by pivot distance tables.

A table of Hamming distances to fixed reference fingerprints, the pivots, is computed once for each
fingerprint. By the triangle inequality two fingerprints that lie within the bound differ by no more than the
bound in any coordinate, so most pairs fall without being compared; the survivors are verified bit by bit.

A pivot keeps about four in ten of random pairs, so the table alone would still look at all pairs. Pairs are
therefore drawn from groups that agree on half of the bits: of six blocks three at least hold no difference,
so every link lies in one of twenty groups. A group that outgrows the bound is dealt anew by half of the bits
that it doesn't share yet; with eight bits left it can't outgrow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logaudit.llm.common import components, shuffle_width, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
#: Fingerprints of a group that are compared in one task.
GROUP = 2048
PIVOTS = 16
_ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if more than half of the shingles' XXH64 hashes have it set. A-Z count as a-z; fewer
    words than a shingle are one shingle; no words, or null, give 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    k = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - k]]
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), [flat[a : b - 1] for a, b in zip(starts, ends[k - 1 :], strict=True)])
    found = np.fromiter(hashes, dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, to: str = "fp") -> DataFrame:
    """The rows with their fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda x: fingerprint(x, shingle)).astype("uint64").astype("int64")

    return docs.withColumn(to, of(F.col(text_col).cast("string")))


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, far from each other."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(free: int) -> list[int]:
    """Masks of three of the six blocks into which the free bits fall."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    blocks = [sum(int(x) for x in part) for part in np.array_split(np.array(bits, dtype=object), BLOCKS)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


_KEYED = "key long, fp long, free long"
_FOUND = "a long, b long, key long, free long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint in the twenty groups into which its group so far is dealt."""
    for batch in batches:
        fp, key, free = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for mask in np.unique(free).tolist():
            own = free == mask
            for i, half in enumerate(_halves(mask)):
                new = _mixed(_mixed((fp[own] & np.uint64(half)) + np.uint64(i + 1)) ^ _mixed(key[own] + np.uint64(i)))
                left = np.full(int(own.sum()), mask & ~half & _ALL, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in (new, fp[own], left)], names=["key", "fp", "free"]
                )


def _pairs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within the distance, in runs of equal keys."""
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    n = len(key)
    end = np.searchsorted(key, key, side="right")
    i = np.flatnonzero(end - np.arange(n) > 1)
    a, b = [], []
    step = 1
    while len(i):
        x, y = i, i + step
        for j in range(PIVOTS):  # a coordinate at a time: few pairs reach the later ones
            near = np.abs(table[x, j] - table[y, j]) <= distance
            x, y = x[near], y[near]
            if not len(x):
                break
        near = np.bitwise_count(fp[x] ^ fp[y]) <= distance
        a.append(x[near])
        b.append(y[near])
        step += 1
        i = i[i + step < end[i]]
    return np.concatenate([*a, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.empty(0, np.int64)]).astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(distance: int, bound: int):
    """Sorted groups to links, as few as connect what belongs together; larger groups' rows go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        held = (empty, empty, empty)
        large: int | None = None  # the key of a group that is being passed on

        def out(a, b, key, free):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, key, free)], names=["a", "b", "key", "free"])

        def done(key, fp, free):
            """Whole groups."""
            if not len(key):
                return
            _, start, size = np.unique(key, return_index=True, return_counts=True)
            over = np.repeat(size > bound, size)
            if over.any():
                yield out(fp[over], np.full(int(over.sum()), None), key[over], free[over])
                key, fp = key[~over], fp[~over]
            if len(key):
                bits = fp.view(np.uint64)
                label = _forest(len(key), *_pairs(key, bits, distance))
                child = np.flatnonzero(label != np.arange(len(key)))
                none = np.full(len(child), None)
                yield out(fp[child], fp[label[child]], none, none)

        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key, fp, free = (np.concatenate(x) for x in zip(held, now, strict=True))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last group may go on in the next batch
            if large is not None:
                own = int(np.searchsorted(key, large, side="right"))
                if own:
                    yield out(fp[:own], np.full(own, None), key[:own], free[:own])
                    key, fp, free, cut = key[own:], fp[own:], free[own:], max(0, cut - own)
                if len(key):
                    large = None
            yield from done(key[:cut], fp[:cut], free[:cut])
            key, fp, free = key[cut:], fp[cut:], free[cut:]
            if len(key) > bound:
                large = int(key[0])
                yield out(fp, np.full(len(fp), None), key, free)
                key = fp = free = empty
            held = (key, fp, free)
        yield from done(*held)

    return run


def links(fps: DataFrame, distance: int = DISTANCE, bound: int = GROUP) -> DataFrame:
    """``a, b`` rows that connect all fingerprints (column ``fp``, distinct) which lie within the distance of
    each other, directly or over others."""
    if not 0 <= distance <= BLOCKS - 3:
        raise ValueError(f"a distance of 0 to {BLOCKS - 3}, not {distance}")
    width = shuffle_width(fps.sparkSession)
    now = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"))
    found = None
    while True:
        dealt = now.mapInArrow(_keyed, _KEYED).repartition(width, "key").sortWithinPartitions("key")
        level = written(dealt.mapInArrow(_linked(distance, bound), _FOUND), "links")
        part = level.where("b is not null").select("a", "b")
        found = part if found is None else found.union(part)
        now = level.where("b is null").select(F.col("a").alias("fp"), "key", "free")
        if now.isEmpty():
            return found


def classes(prints: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE, bound: int = GROUP) -> DataFrame:
    """``fp, first, component, component_id``: for each fingerprint of ``prints`` its own least id, the least
    fingerprint of its component, which no other component has, and the least id that can be reached from it."""
    firsts = written(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "firsts")
    joined = components(links(firsts.select("fp"), distance, bound)).withColumnRenamed("node", "fp")
    linked = written(joined.join(firsts, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(least, "component").select("fp", "component", "component_id")
    return firsts.join(of_linked, "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first").alias("component_id")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, bound: int = GROUP
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: its fingerprint in hex and the least id that can be
    reached from it over links of at most ``distance`` differing bits.

    Texts without words, empty and null ones have fingerprint zero and are linked like any others. Repeated
    rows each come back. Null ids are no component's least id unless it has no other. Very long texts are
    hashed in parts. An empty table gives no rows; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(rows).select("doc_id", "fp"), "prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes(prints, "doc_id", distance, bound), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows that stay when one of each component does: the one of least id, nulls last, and of several rows
    of that id the one of least fingerprint, then of least text hash. Components are told apart by their fingerprints, so rows without
    an id, or with an id that other texts have too, stay unless their own component has another. The columns
    are those of ``docs``."""
    own = docs.columns
    kept = [F.col(f"`{c}`") for c in own]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(fingerprints(rows).drop("text"), "with_prints")
    least = F.min(F.struct(F.col("first").isNull().alias("without"), "first", "fp")).alias("least")
    winners = classes(rows.select("doc_id", "fp"), "doc_id", distance).groupBy("component").agg(least)
    same = winners.select(F.col("least.first").alias("w_id"), F.col("least.fp").alias("w_fp"))
    staying = rows.join(same, (F.col("fp") == F.col("w_fp")) & F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")
    order = F.struct(F.xxhash64(F.col("row").getField(text_col)), F.col("row").getField(text_col))
    return staying.groupBy("doc_id", "fp").agg(F.min_by("row", order).alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

