"""Quality rules as a bitmask ledger: every rule is evaluated once, policies come afterwards.

``ledger`` measures each document and stores one bit for each rule that it fails. A policy is a versioned
set of rules; applying one, or asking what each of its rules changes, only reads the bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Rule name and its failure condition over the measurements, in integers. A rule's bit is its place here.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("shouting", "5 * n_upper > 2 * word_chars"),
    ("exclaiming", "5 * n_exclaim > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("stuttering", "10 * n_stutter > 3 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "2024-1": tuple(BITS),
}
CURRENT = "2024-1"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(BITS[name] for name in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more, the first one included.

    Windows are compared by 64-bit hashes. Sorting (hash, place) puts equal windows side by side, so the
    work is n log n for a text of any length.
    """
    n = F.size(words)
    hashes = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
        return F.aggregate(
            found,
            zero,
            lambda acc, p: F.struct(
                (acc["total"] + (p + WINDOW) - F.greatest(p, acc["end"])).alias("total"), (p + WINDOW).alias("end")
            ),
            lambda acc: acc["total"],
        )

    def places(ordered: Column) -> Column:
        last = F.size(ordered)
        twin = lambda s, i: (
            ((i > 0) & (F.get(ordered, i - 1)["h"] == s["h"])) | ((i < last - 1) & (F.get(ordered, i + 1)["h"] == s["h"]))
        )
        return F.sort_array(F.array_compact(F.transform(ordered, lambda s, i: F.when(twin(s, i), s["i"]))))

    # A one-element array around a value binds it to a lambda's variable: it is computed once, however often used.
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return once(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            once(F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))), lambda s: covered(places(s)))
        ),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements of each row: one row out for each row in, keyed by ``id_col``. Null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_t"),
        F.array_remove(F.split(text, SPACE), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_l"),
    )
    # Few texts hold symbols, capitals or exclamation marks in number: what isn't one of them goes, in long runs.
    left = lambda keep: F.length(F.regexp_replace("_t", f"[^{keep}]+", "")).cast("long")
    lines = lambda pattern: F.size(F.filter("_l", lambda line: line.rlike(pattern))).cast("long")
    return parts.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        left("#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        left("A-Z").alias("n_upper"),
        left("!").alias("n_exclaim"),
        lines(r"(\.\.\.|…)[\x20\x09-\x0D]*\z").alias("n_ellipsis_lines"),
        F.size(F.filter(F.zip_with("_w", F.slice("_w", 2, F.size("_w") + 1), lambda a, b: a == b), lambda same: same)).cast("long").alias("n_stutter"),
        lines(r"\A[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]").alias("n_bullet_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``: bit i is set if the row fails rule i of ``RULES``.

    One row out for each row in, in a single pass without a shuffle. Null and empty texts fail
    ``too_few_words`` alone; repeated rows get equal entries; an empty table gives an empty ledger; other
    columns of the input are ignored, whatever their names.
    """
    measured = measure(docs, id_col, text_col)
    failed = None
    for name, condition in RULES:
        bit = F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long")
        failed = bit if failed is None else failed.bitwiseOR(bit)
    entries = measured.withColumn("failed", failed)
    # A filter on the entries must read the bits, not work the rules out again for each of its terms: it isn't
    # moved below the generator of its own columns.
    return entries.select(F.explode(F.array(F.struct("*"))).alias("e")).select("e.*")


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Ledger entries with ``policy`` and ``kept``: no rule of the policy has failed."""
    return entries.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: how many entries fail it, how many fail it alone, and how many the policy
    would keep without it. One aggregation over the bits; one row out for each rule."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    names = POLICIES[policy]
    sums = [F.count("*").alias("n"), F.count_if(bits == 0).alias("kept")]
    for name in names:
        sums += [
            F.count_if(bits.bitwiseAND(F.lit(BITS[name])) != 0).alias(f"fail_{name}"),
            F.count_if(bits == BITS[name]).alias(f"alone_{name}"),
        ]
    row = entries.agg(*sums)
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col(f"fail_{name}").alias("failing"),
                        F.col(f"alone_{name}").alias("failing_alone"),
                        (F.col("kept") + F.col(f"alone_{name}")).alias("kept_without"),
                        F.col("n").alias("documents"),
                    )
                    for name in names
                ]
            )
        ).alias("r")
    ).select("r.*")


def keep(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their own columns."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(text_col).alias("text"))
    kept = apply_policy(ledger(inner), policy).where("kept")
    return kept.select("doc_id.*")


def query(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    entries = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "failed",
    )


_CONDITIONS = " + ".join(f"CASE WHEN {condition} THEN {BITS[name]} ELSE 0 END" for name, condition in RULES)
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), p AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM p WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) r(k) GROUP BY doc_id
), m AS (
  SELECT p.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]'))) AS n_bullet_lines
  FROM p LEFT JOIN cov ON cov.doc_id = p.doc_id
), f AS (
  SELECT *, ({_CONDITIONS})::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {mask("base")}) <> 0 AS base_failed, (failed & {mask(CURRENT)}) = 0 AS kept, failed
FROM f
"""
