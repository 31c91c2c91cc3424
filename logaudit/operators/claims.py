"""Written claims against measured evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.functions.text import numbers
from logaudit.schemas import COMPLETION

KINDS = ("observation", "explanation", "next_step")
MOST_CLAIMS = 12


def parse_completion(text: Column) -> Column:
    """The JSON object in a model's text, from the first to the last brace; null if there is none."""
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, COMPLETION))


def claim_rows(completions: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """The first claims of each completion, one a row; blank refs go."""
    rows = completions.select(*keys, F.posexplode("completion.claims").alias("pos", "c")).where(F.col("pos") < MOST_CLAIMS)
    kind = F.lower(F.trim(F.coalesce("c.kind", F.lit("observation"))))
    refs = F.filter(F.transform(F.coalesce("c.refs", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    return rows.select(
        *keys, "pos", F.col("c").isNotNull().alias("is_object"), F.trim(F.coalesce("c.text", F.lit(""))).alias("text"),
        F.when(kind.isin(*KINDS), kind).otherwise("observation").alias("kind"), refs.alias("refs"),
    )


def catalogue(entries: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """Material of each ref in order of ``pos``. A ref's material is bounded by its round."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "material")))
    return entries.groupBy(*keys, "ref").agg(F.array_join(F.transform(listed, lambda x: x["material"]), "\n").alias("material"))


def measured(signals: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """Distinct numbers of a round: its signals' values and those in its findings' titles and details."""
    values = signals.where("value_num is not null").select(*keys, F.col("value_num").alias("number"))
    said = findings.select(*keys, F.explode(numbers(F.concat_ws(" ", "title", "detail"))).alias("number"))
    return values.union(said).distinct()


def resolve(claims: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """Claims with ``unknown`` (the first ref that the round doesn't have) and the material that they cite."""
    refs = claims.select(*keys, "pos", F.posexplode("refs").alias("ref_pos", "ref"))
    met = refs.join(known, [*keys, "ref"], "left").groupBy(*keys, "pos").agg(
        F.min_by(F.when(F.col("material").isNull(), F.col("ref")), F.when(F.col("material").isNull(), F.col("ref_pos"))).alias("unknown"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "material"))), lambda x: x["material"]), "\n").alias("cited"),
    )
    return claims.join(met, [*keys, "pos"], "left")


def _listed(values: Column, most: int) -> Column:
    shown = F.transform(F.slice(F.array_sort(values), 1, most), lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))
    return F.array_join(shown, ", ")


def verify(claims: DataFrame, known: DataFrame, numbers_of_round: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """Each claim with ``accepted, reason, confidence, note``: what cites nothing, or something unknown, or
    states a number that nobody measured, is rejected; explanations are never more than a hypothesis."""
    per_round = numbers_of_round.groupBy(*keys).agg(F.collect_set("number").alias("measured"))
    rows = resolve(claims, known, keys).join(per_round, list(keys), "left")
    empty = F.array().cast("array<double>")
    of_refs = F.flatten(F.transform("refs", lambda r: numbers(r)))
    claimed = F.array_except(numbers(F.col("text")), of_refs)
    unsupported = F.array_except(claimed, numbers(F.coalesce("cited", F.lit(""))))
    rows = rows.withColumn("_u", unsupported).withColumn("_f", F.array_except("_u", F.coalesce("measured", empty)))
    made_up = F.size("_f") > 0
    reason = (
        F.when(~F.col("is_object"), "not an object")
        .when(F.col("text") == "", "empty claim")
        .when(F.size("refs") == 0, "cites no evidence")
        .when(F.col("unknown").isNotNull(), F.concat(F.lit("cites '"), F.col("unknown"), F.lit("', which is not in this round")))
        .when(made_up & (F.col("kind") == "observation"), F.concat(F.lit("states "), _listed(F.col("_f"), 3), F.lit(", which nothing in this round measured")))
    )
    loose = F.size("_u") > 0
    note = F.when(made_up, F.concat(F.lit("contains "), _listed(F.col("_f"), 3), F.lit(", which is not a measurement from this round"))).when(
        loose, F.concat(F.lit("cited imprecisely: "), _listed(F.col("_u"), 4))
    )
    confidence = F.when(loose | (F.col("kind") == "explanation"), "hypothesis").otherwise("derived")
    ok = reason.isNull()
    return rows.select(
        *keys, "pos", "text", "kind", ok.alias("accepted"), reason.alias("reason"), F.when(ok, confidence).alias("confidence"), F.when(ok, note).alias("note"), "refs"
    )


def headline(findings: DataFrame, keys: tuple[str, ...] = ("host", "round_id"), rounds: DataFrame | None = None) -> DataFrame:
    """Severity of a round and a headline of its findings: counts from the most severe down, and the first title. With
    ``rounds`` (their keys), a round without findings has the least severity and says so."""
    first = F.min_by("title", F.struct(-F.col("severity"), "rule", "title"))
    counts = [F.count_if(F.col("severity") == level).alias(f"_n{level}") for level in (3, 2, 1)]
    rows = findings.groupBy(*keys).agg(F.max("severity").alias("severity"), first.alias("_title"), *counts)
    names = {3: "critical", 2: "warning", 1: "info"}
    parts = [F.when(F.col(f"_n{level}") > 0, F.concat(F.col(f"_n{level}").cast("string"), F.lit(f" {name}"))) for level, name in names.items()]
    out = rows.select(*keys, "severity", F.concat(F.concat_ws(", ", *parts), F.lit(": "), F.col("_title")).alias("headline"))
    if rounds is None:
        return out
    every = rounds.select(*keys).distinct().join(out, list(keys), "left")
    return every.select(*keys, F.coalesce("severity", F.lit(1)).alias("severity"), F.coalesce("headline", F.lit("nothing to report")).alias("headline"))


def verify_headlines(completions: DataFrame, known: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = ("round_id",)) -> DataFrame:
    """The model's headline, or the rules' own where it is empty or states a number that its refs don't hold.
    Unknown refs are ignored."""
    rows = completions.select(*keys, F.trim(F.coalesce("completion.headline", F.lit(""))).alias("said"), F.col("completion.headline_refs").alias("refs"))
    met = rows.select(*keys, F.explode("refs").alias("ref")).join(known, [*keys, "ref"]).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("material")), "\n").alias("cited"))
    joined = rows.join(met, list(keys), "left").join(fallback.select(*keys, F.col("headline").alias("own")), list(keys), "left")
    loose = F.size(F.array_except(numbers(F.col("said")), numbers(F.coalesce("cited", F.lit(""))))) > 0
    replaced = (F.col("said") == "") | loose
    return joined.select(*keys, F.when(replaced, F.col("own")).otherwise(F.col("said")).alias("headline"), replaced.alias("replaced"))


def first_distinct(rows: DataFrame, by: list[str], fields: list[str], order: str) -> DataFrame:
    """Evidence without repeats: of equal fields the first stays."""
    rank = F.row_number().over(Window.partitionBy(*by, *fields).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
