"""Line dedup by a deletion-neighbourhood join.

Two lines whose words differ by one insertion, deletion or replacement share a variant: the line itself or the
line without one of its words. Variants are joined as hashed keys, links are verified on the words, and of
each group of linked lines the earliest stays.

Lines are compared by words, A-Z as a-z. Few lines have a partner, so variants are only emitted for lines that
share half of their words with another: one edit leaves the first or the last half as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logaudit.llm.common import components, written

#: Lines of fewer words have no variants, since one edit would make up most of them: they match if all words do.
MIN_WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(line: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return line.encode("utf-8", "surrogatepass").lower().split()


def _hash(parts: list[bytes], seed: int = 0) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(b" ".join(parts), seed)
    return x - (1 << 64) if x >> 63 else x


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of first and last halves. Lines of an odd number of words have two lengths of a half, so that
    they meet those of one word less and of one word more."""
    n = len(words)
    return [x for t in {n // 2, (n + 1) // 2} for x in (_hash(words[:t], 1), _hash(words[n - t :], 2))]


_LINES = "rid long, line int, h long, keys array<long>"


def _lines(min_words: int, short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                rid, at, h, keys = [], [], [], []
                for r, text in zip(batch.column(0).slice(k, 500).to_pylist(), batch.column(1).slice(k, 500).to_pylist(), strict=True):
                    for i, line in enumerate((text or "").split("\n")):
                        words = words_of(line)
                        if words and (short or len(words) >= min_words):
                            rid.append(r)
                            at.append(i)
                            h.append(_hash(words))
                            keys.append(half_keys(words) if len(words) >= min_words else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid, pa.int64()), pa.array(at, pa.int32()), pa.array(h, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["rid", "line", "h", "keys"],
                )

    return run


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of a text with hashes of their words."""
    import xxhash

    one = partial(xxhash.xxh64_intdigest, seed=3)
    for batch in batches:
        for texts, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = (texts or "").split("\n")
            rows = [(w["h"], np.fromiter(map(one, words_of(lines[w["line"]])), dtype=np.uint64).view(np.int64).tolist()) for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))], names=["h", "words"]
            )


def variants(words: np.ndarray) -> np.ndarray:
    """Hashes of a line's variants: the whole line first, then without its 1st, 2nd, ... word."""
    n = len(words)
    x = words.view(np.uint64)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _STEP))))  # powers of the step, wrapping
    terms = x * power[:n]
    before = np.concatenate(([np.uint64(0)], np.cumsum(terms)))
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    without = before[:-1] + (before[-1] - before[1:]) * inverse  # later words move up by one
    return np.concatenate((before[-1:], without)).view(np.int64)


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, words = batch.column(0).to_pylist(), batch.column(1)
        for k in range(0, len(batch), 2000):
            found = [variants(np.asarray(w.as_py(), dtype=np.int64)) for w in words.slice(k, 2000)]
            size = [len(x) for x in found]
            place = np.concatenate([np.arange(-1, n - 1) for n in size]) if size else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64)),
                    pa.array(place.astype(np.int32)),
                    pa.array(np.repeat(np.asarray(h[k : k + 2000], dtype=np.int64), size)),
                ],
                names=["variant", "place", "h"],
            )


def within_one(a: list[int], b: list[int]) -> bool:
    """At most one word inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, wa, wb = (batch.column(i).to_pylist() for i in range(4))
        good = [i for i in range(len(a)) if within_one(wa[i], wb[i])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])


def line_links(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """``a, b``: verified links that connect all distinct lines within one edit of each other.

    Lines that lost a word at the same place to the same variant differ in that word alone, so linking each
    with the least of them loses none, and no list of pairs grows with the square of such a group. A line
    that is the variant of longer ones is linked with each. No other pair lies within one edit.
    """
    keyed = distinct.select("h", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    near = keyed.join(shared, "key").select("h").distinct()
    wanted = distinct.join(near, "h").groupBy("rid").agg(F.collect_list(F.struct("h", "line")).alias("wanted"))
    texts = rows.select("rid", "text").join(wanted, "rid").dropDuplicates(["rid"])
    lines = written(texts.select("text", "wanted").mapInArrow(_worded, "h long, words array<long>"), "near_lines")
    varied = written(lines.mapInArrow(_varied, "variant long, place int, h long"), "variants")
    least = varied.where("place >= 0").groupBy("variant", "place").agg(F.min("h").alias("a"), F.count("*").alias("n")).where("n > 1")
    replaced = varied.where("place >= 0").join(least, ["variant", "place"]).where("h <> a").select("a", F.col("h").alias("b"))
    whole = varied.where("place < 0").select("variant", F.col("h").alias("a"))
    longer = varied.where("place >= 0").join(whole, "variant").select("a", F.col("h").alias("b"))
    found = replaced.union(longer).distinct()
    of = lambda c: lines.select(F.col("h").alias(c), F.col("words").alias(f"w{c}"))
    return found.join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "wb").mapInArrow(_verified, "a long, b long")


def with_rid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, rid``: rid is a hash of both, so repeated rows are one."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rid"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """``rid, doc_id, lines, class_sizes``: the numbers of the lines (from 0, by newlines) that aren't the
    earliest of their class, and how many occurrences each one's class has.

    A class is what links of one edit connect. Lines of fewer than ``min_words`` words are left alone or, if
    ``short`` is set, are in a class of equal words; lines without words are in none. The earliest is the first by doc_id (nulls first), then by
    text hash, then by line. Null and empty texts have no lines to compare; rows equal in id and text share
    an entry; an empty table gives no rows; other columns are ignored. Texts without such lines are absent.
    """
    rows = with_rid(docs, id_col, text_col)
    lines = written(rows.select("rid", "text").mapInArrow(_lines(min_words, short), _LINES), "lines")
    ids = written(rows.select("rid", "doc_id").distinct(), "ids")
    distinct = written(
        lines.groupBy("h").agg(F.min_by(F.struct("rid", "line", "keys"), F.struct("rid", "line")).alias("x"), F.count("*").alias("n")).select("h", "n", "x.*"),
        "distinct_lines",
    )
    joined = written(components(line_links(rows, distinct)).withColumnRenamed("node", "h"), "line_classes")
    classes = distinct.join(joined, "h", "left").select("h", "n", F.coalesce("component", "h").alias("class"))
    sizes = classes.groupBy("class").agg(F.sum("n").alias("size")).where("size > 1")
    repeated = classes.join(sizes, "class").select("h", "class", "size")
    found = lines.select("rid", "line", "h").join(repeated, "h").join(ids, "rid").select("rid", "doc_id", "line", "class", "size")
    found = written(found, "occurrences")
    order = F.struct("doc_id", "rid", "line")
    first = found.groupBy("class").agg(F.min(order).alias("first"))
    gone = found.join(first, "class").where(~order.eqNullSafe(F.col("first")))
    return gone.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_set(F.struct("line", "size"))).alias("x")).select(
        "rid", "doc_id", F.col("x.line").alias("lines"), F.col("x.size").alias("class_sizes")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without the duplicate lines in their texts, short ones too. Every row stays, if only with an empty
    text; null texts stay null; an ``n_chars`` column follows the new text."""
    gone = duplicate_lines(docs, id_col, text_col, min_words, short=True).select(F.col("rid").alias("_rid"), F.col("lines").alias("_gone"))
    text = F.col(text_col).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.xxhash64(F.col(id_col), text).alias("_rid"), text.alias("_text")).join(gone, "_rid", "left")
    kept = F.filter(F.split("_text", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    values = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text_col:
            value = F.col("_new")
        elif c == "n_chars":
            value = F.when(F.col("_gone").isNull(), value).otherwise(F.length("_new").cast(docs.schema[c].dataType))
        values.append(value.alias(c))
    return rows.withColumn("_new", new).select(*values)


def query(spark, sf_dir: str) -> DataFrame:
    """Duplicate lines of all documents: one row for each document, with none or more line numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = duplicate_lines(docs, short=True).select("rid", "lines", "class_sizes")
    rows = with_rid(docs, "doc_id", "text").select("doc_id", "rid").join(gone, "rid", "left")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("lines", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("class_sizes", F.array().cast("array<long>")).alias("class_sizes"),
    )
