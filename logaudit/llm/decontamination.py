"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all documents.

The windows of the benchmark become rows, and rows become blocks of a bounded number of windows. Each block
is broadcast and one pass over the documents tests it: rolling 64-bit hashes find the places where a window
may lie, and the words themselves confirm each of them. One block holds any usual benchmark; a larger one
takes more passes, never a larger broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logaudit.llm.common import written

N = 13
#: Windows in a broadcast block: about 100 bytes each, so 25 MB at most.
BLOCK_WINDOWS = 250_000
#: A document is contaminated if at least one in 20 of its words is hit.
SHARE = 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)  # A-Z lowered; what isn't part of a word becomes a blank
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lowered, as UTF-8. Null: none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _window_rows(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                w = words_of(text)
                for i in range(max(1, len(w) - n + 1)) if w else ():
                    out.append((b" ".join(w[i : i + n]).decode("utf-8", "surrogatepass"), item))
            yield pd.DataFrame(out, columns=["window", "item"])

    return run


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """Distinct ``window, item`` rows: every run of ``n`` words of an item; a shorter item, if it has a word,
    is one window. Items of null or wordless text have none."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(_window_rows(n), "window string, item string").distinct()


class _Block:
    """One block of windows, laid out for scanning."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.items = sorted({item for _, item in rows}, key=lambda x: (x is None, x))
        place = {item: i for i, item in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], list[int]] = {}
        for window, item in rows:
            ids = tuple(
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                for w in window.encode("utf-8", "surrogatepass").split(b" ")
            )
            by_window.setdefault(ids, []).append(place[item])
        self.of = by_window
        self.hashes: dict[int, np.ndarray] = {}
        for length in sorted({len(ids) for ids in by_window}):
            rows_ = np.array([ids for ids in by_window if len(ids) == length], dtype=np.uint64)
            self.hashes[length] = np.unique(_rolled(rows_.reshape(-1), length)[::length])

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, length, items) of each window in ids; 0 stands for a word of no window."""
        found = []
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(full):
                continue
            at = _rolled(ids, length)[full]
            near = np.minimum(np.searchsorted(hashes, at), len(hashes) - 1)
            for start in full[hashes[near] == at].tolist():
                items = self.of.get(tuple(ids[start : start + length].tolist()))
                if items is not None:
                    found.append((start, length, items))
        return found


def _rolled(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` ids."""
    out = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for i in range(length):
        out = out * _MULTIPLIER + x[i : len(x) - length + 1 + i]
    return out


def _finder(block):
    """Text to the hits of one block: words, and start, length and items of each hit."""

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, items array<string>")
    def find(texts: pd.Series) -> pd.DataFrame:
        grams, out = block.value, []
        for text in texts:
            w = words_of(text)
            ids = np.fromiter(map(grams.vocabulary.get, w, repeat(0)), dtype=np.uint64, count=len(w))
            hits = grams.scan(ids)
            items = sorted({i for _, _, found in hits for i in found})
            out.append((len(w), [s for s, _, _ in hits], [n for _, n, _ in hits], [grams.items[i] for i in items]))
        return pd.DataFrame(out, columns=["n_words", "starts", "lengths", "items"])

    return find


_SUMMARY = "n_words long, n_hit long, n_items long, items_sha256 string, span_starts array<long>, span_lengths array<long>"


def _summarise(found: pd.DataFrame) -> pd.DataFrame:
    """Counts over the union of the hit spans; the spans come back merged and in order."""
    out = []
    for n_words, starts, lengths, items in zip(*(found[c] for c in ("n_words", "starts", "lengths", "items")), strict=True):
        merged: list[list[int]] = []
        for start, length in sorted(zip(starts, lengths, strict=True)):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], start + length)
            else:
                merged.append([start, start + length])
        names = sorted({x for x in items if x is not None})
        digest = hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()
        hit = sum(e - s for s, e in merged)
        out.append((n_words, hit, len(set(items)), digest, [s for s, _ in merged], [e - s for s, e in merged]))
    return pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "span_starts", "span_lengths"])


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    n: int = N,
    share: int = SHARE,
    block_windows: int = BLOCK_WINDOWS,
    to: str = "hits",
) -> DataFrame:
    """The rows of ``docs`` with a column ``to``: counts of words, hit words and items, a digest of the items, the
    hit spans in words, and the verdict.

    One row out for each row in, in one map-only pass for each block. A null text has no words; a document
    without words is clean; an empty benchmark leaves all clean; repeated items and repeated rows count as
    they stand. Columns of the input keep their names; one named like ``to`` is replaced.
    """
    spark = docs.sparkSession
    grams = written(windows(benchmark, n=n), "windows")
    blocks = max(1, -(-grams.count() // block_windows))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != to.lower()])
    out = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    for i in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == i) if blocks > 1 else grams
        block = spark.sparkContext.broadcast(_Block([(r.window, r.item) for r in part.collect()]))
        now = out.select("*", _finder(block)("text").alias("new"))
        if i == 0:
            out = now.withColumnRenamed("new", "found")
        else:
            joined = [F.concat(f"found.{c}", f"new.{c}").alias(c) for c in ("starts", "lengths", "items")]
            out = now.withColumn("found", F.struct("new.n_words", *joined)).drop("new")
        if blocks > 1:  # a worker holds one block at a time
            out = written(out, "found")
    out = out.select("row", F.pandas_udf(_summarise, _SUMMARY)("found").alias("d"))
    verdict = (F.col("d.n_hit") > 0) & (F.lit(share) * F.col("d.n_hit") >= F.col("d.n_words"))
    return out.select("row.*", F.struct("d.*", verdict.alias("contaminated")).alias(to))


def remove_documents(scanned: DataFrame, hits: str = "hits") -> DataFrame:
    """Drops the contaminated documents and the column that ``scan`` has added."""
    return scanned.where(~F.col(f"{hits}.contaminated")).drop(hits)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all of their columns, whatever these are named."""
    to = "hits"
    while to in {c.lower() for c in docs.columns}:
        to = f"_{to}"
    return remove_documents(scan(docs, benchmark, text_col, to=to), to)


def remove_spans(scanned: DataFrame, text_col: str = "text", hits: str = "hits") -> DataFrame:
    """Cuts the hit words out of the texts, in all documents, and drops the column that ``scan`` has added.

    A span goes from the start of its first word to the start of the next word that stays, or to the end of
    its last word at the end of the text. Null texts stay null; a text that is all span becomes empty.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([_without(*x) for x in zip(texts, starts, lengths, strict=True)], dtype=object)

    cleaned = F.when(F.size(f"{hits}.span_starts") > 0, cut(text_col, f"{hits}.span_starts", f"{hits}.span_lengths")).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, cleaned).drop(hits)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _without(text: str | None, starts, lengths) -> str | None:
    if text is None or len(starts) == 0:
        return text
    at = [m.span() for m in _WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, done = [], 0
    for s, n in zip(starts, lengths, strict=True):
        out.append(text[done : at[s][0]])
        done = at[s + n][0] if s + n < len(at) else at[s + n - 1][1]
    return "".join([*out, text[done:]])


def query(spark, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return found.select("doc_id", *[F.col(f"hits.{c}").alias(c) for c in names])


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bi AS (
  SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM bi
), di AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), hit AS (
  SELECT doc_id, item_id, i, win.n FROM
    (SELECT doc_id, i, k.n, array_to_string(w[i:i + k.n - 1], ' ') AS x
     FROM di, (SELECT DISTINCT n FROM win) k WHERE i + k.n - 1 <= len(w)) q
  JOIN win ON win.n = q.n AND win.x = q.x
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(0, 13) r(k) WHERE k < n GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""
