"""Divergence audit of sources: how far the word frequencies of each two sources of a language lie apart.

Counts of terms become packed vectors, one for each source of a language and each chunk of the kept vocabulary.
Sources are dealt into blocks, and each vector is copied to the tiles of its block: pairs of blocks, over a span of
chunks. A tile reads its vectors chunk by chunk, holds two blocks of one chunk at a time, and adds up its part of the
matrix of pairs. Parts of different spans are added. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from logaudit.llm.common import small, written

#: Documents of its language in which a kept term stands, at least.
LEAST_DOCS = 30
#: Added to each count.
SMOOTH = 5
#: Frequencies are in billionths.
SCALE = 1_000_000_000
#: Ranks of the terms that set a source apart.
TOP = 50
#: Sources in a block, terms in a chunk (about), chunks in a span. A tile holds two blocks of a chunk: 2 * 32 * 16384 numbers, 8 MB.
BLOCK = 32
CHUNK = 16_384
SPAN = 16
#: Distinct terms that a task counts before it sends them on.
HELD = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of ASCII letters and all other characters beyond ASCII, A-Z lowered."""
    return text.translate(_FOLD).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            names = list(n)
            size = len(names) + 1  # and a row without a term: the source is there, even without any
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                    pa.array([None, *names], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, names)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            words = terms_of(text.as_py())
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in counts.values()) >= HELD:
            yield from rows()
            counts.clear()
    yield from rows()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, kept``: how often each term occurs in each source, and whether its language keeps it; a
    row of null term for each source.

    Tasks count what they read and send one row for each term of a source; these are dealt by language and term once,
    for the sums of both the source and the language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    dealt = rows.mapInArrow(_counts, _COUNTED).repartition("lang", "term")
    each = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return each.withColumn("kept", F.col("term").isNotNull() & (in_lang >= LEAST_DOCS)).drop("docs").where("kept or term is null")


def share(n: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTH) / total)`` without rounding."""
    wide = (n + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, total.cast("decimal(20,0)")).cast("long")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same over arrays: three digits of the quotient at a time, so that nothing outgrows 64 bits."""
    rest, out = n.astype(np.int64) + SMOOTH, np.zeros(np.broadcast(n, total).shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile come in order of chunk, then of group; sums of a tile are given when it ends."""
    tile: tuple | None = None
    chunk: int | None = None
    left: list[tuple] = []
    right: list[tuple] = []
    sums: dict[tuple[int, int], int] = {}

    def dense(rows: list[tuple], width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), dtype=np.int64)
        for i, (_, _, places, counts) in enumerate(rows):
            out[i, places] = counts
        return shares(out, np.array([[max(r[1], 1)] for r in rows], dtype=np.int64))

    def add(width: int) -> None:
        same = tile[1] == tile[2]
        a = dense(left, width)
        b = a if same else dense(right, width)
        theirs = left if same else right
        for i, row in enumerate(left):
            first = i + 1 if same else 0
            if first < len(theirs):
                apart = np.abs(b[first:] - a[i]).sum(axis=1)
                for other, value in zip(theirs[first:], apart.tolist(), strict=True):
                    sums[row[0], other[0]] = sums.get((row[0], other[0]), 0) + value

    def out() -> pa.RecordBatch:
        pairs = list(sums)
        columns = [pa.array([tile[0]] * len(pairs), pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()), pa.array(list(sums.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    width = 0
    for batch in batches:
        plain, packed = batch.columns[:-2], batch.columns[-2:]
        for k, (lang, i, j, span, at, wide, group, block, total) in enumerate(zip(*(c.to_pylist() for c in plain), strict=True)):
            if tile is not None and (tile, chunk) != ((lang, i, j, span), at):
                add(width)
                left, right = [], []
                if tile != (lang, i, j, span):
                    yield out()
                    sums.clear()
            tile, chunk, width = (lang, i, j, span), at, wide
            (left if block == i else right).append((group, total, *(c[k].values.to_numpy(zero_copy_only=False) for c in packed)))
    if tile is not None:
        add(width)
        yield out()


def _vectors(kept: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, chunk, width, group, block, total, places, counts``: the packed counts of each group in each chunk of its
    language's vocabulary, empty ones too, since a term that a source lacks still has a share."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / CHUNK)).cast("int")
    in_chunk = F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")
    terms = kept.select("lang", "term").distinct().join(F.broadcast(sizes.select("lang", chunks.alias("chunks"))), "lang").withColumn("chunk", in_chunk)
    placed = written(terms.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1), "places")
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    entry = F.array_sort(F.collect_list(F.struct("place", "n")))
    packed = kept.join(placed, ["lang", "term"]).groupBy("lang", "source", "chunk").agg(entry.alias("e"))
    packed = packed.select("lang", "source", "chunk", F.col("e.place").alias("places"), F.col("e.n").alias("counts"))
    each = widths.join(groups, "lang")  # each source of the language for each of its chunks
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(packed.schema[c].dataType))
    return each.join(packed, ["lang", "source", "chunk"], "left").select(
        "lang", "chunk", "width", "group", "block", "total", empty("places").alias("places"), empty("counts").alias("counts")
    )


def pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for each two groups of a language, a before b: the sum of the differences of their shares."""
    blocks = F.broadcast(groups.groupBy("lang").agg(F.max("block").alias("last")))
    tiles = F.transform(F.sequence(F.lit(0), "last"), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    copied = vectors.join(blocks, "lang").withColumn("t", F.explode(tiles)).withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int"))
    order = ["lang", "t.i", "t.j", "span"]
    sorted_ = copied.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order, "chunk", "group")
    rows = sorted_.select("lang", "t.i", "t.j", "span", "chunk", "width", "group", "block", "total", "places", "counts")
    return rows.mapInArrow(_tile, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: how far each other source of the language lies from a source, in billionths, summed over the kept
    terms; part ``term``: the terms that a source has more of than its language, up to rank ``TOP``. Ranks go by falling
    value, then by the item's bytes. Null texts, languages and sources count as ''; a source without terms has pairs but
    no terms; a language without kept terms has pairs of value 0, and one of a single source has none; a text is of any
    length that one task can hold; repeated rows count each time; an empty table gives no rows; further columns are
    ignored. Sums of counts are exact up to 9 * 10**15 terms in a language.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    kept = counts.where("kept").drop("kept")
    v = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = v.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    # Languages are at most as many as their groups.
    langs = counts.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("n", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(
        own.join(F.broadcast(langs), "lang").select("lang", "source", number.cast("long").alias("group"), F.floor(number / BLOCK).cast("int").alias("block"), (F.col("n") + SMOOTH * F.col("v")).alias("total")),
        "groups",
    )
    most = groups.count()  # pairs of groups are the result: far fewer groups than may be broadcast, but that is checked
    apart = pairs(_vectors(kept, small(groups, most), langs), groups)
    named = small(groups.select("lang", "group", "source"), most)
    # Each two groups of a language from the table of groups; languages without kept terms have no vectors, their value is 0.
    both = groups.select("lang", "group", "source").join(named.select("lang", F.col("group").alias("other"), F.col("source").alias("item")), "lang").where(F.col("group") != F.col("other"))
    both = both.select("lang", "source", "item", F.least("group", "other").alias("a"), F.greatest("group", "other").alias("b"))
    pair = both.join(apart, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    at = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.withColumn("rank", F.row_number().over(at))
    p, q = share(F.col("n"), F.col("total")), share(F.col("lang_n"), F.col("lang_total"))
    more = (
        kept.join(v.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"])
        .join(small(groups.select("lang", "source", "total"), most), ["lang", "source"])
        .join(F.broadcast(langs.select("lang", "lang_total")), "lang")
        .where("n > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    )
    term = more.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= TOP)
    return pair.unionByName(term)


def query(spark, sf_dir: str) -> DataFrame:
    """All sources of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), vs AS (
  SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept ON kept.lang = l.lang GROUP BY ALL
), g AS (
  SELECT s.lang, s.source, coalesce(sum(n), 0) + {SMOOTH} * any_value(v) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s JOIN vs USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL
), lt AS (
  SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL)
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // g.total)::BIGINT AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT p.lang, p.source, q.source AS item, sum(abs(p.p - q.p)) AS value
             FROM p JOIN p q ON q.lang = p.lang AND q.term = p.term AND q.source <> p.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT p.lang, p.source, p.term AS item, (p.p - (1 + ({SCALE}::HUGEINT * (lt.n + {SMOOTH})) // (lt.total + {SMOOTH} * vs.v)))::BIGINT AS value
  FROM p JOIN lt ON lt.lang = p.lang AND lt.term = p.term JOIN vs ON vs.lang = p.lang WHERE p.n > 0
)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term WHERE value > 0) WHERE rank <= {TOP}
"""
