"""Whole briefs: what a round found, what was written about it, and what of that was refused, as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLAIM = "array<struct<text:string,kind:string,confidence:string,refs:array<string>,note:string>>"
_REJECTED = "array<struct<text:string,reason:string>>"
FINDING = ("rule", "severity", "confidence", "title", "detail", "labels", "signal_keys", "baseline", "correlations", "evidence")


def _in_order(rows: Column) -> Column:
    """Gathered structs by their ``pos``; a map among their fields keeps them from being sorted as a whole."""
    return F.array_sort(F.array_compact(rows), lambda a, b: (a["pos"] - b["pos"]).cast("int"))


def _without_pos(rows: Column) -> Column:
    return F.transform(rows, lambda x: x.dropFields("pos"))


def briefs(
    headlines: DataFrame, findings: DataFrame, claims: DataFrame | None = None, models: DataFrame | None = None, keys: tuple[str, ...] = ("host", "round_id")
) -> DataFrame:
    """A brief for each round with a headline: ``severity, headline, headline_source, model, llm_error, claims, rejected,
    findings`` beside its keys.

    ``headlines``: severity and headline, the rules' own. ``findings`` have ``pos``. ``claims`` are checked claims with
    their refs. ``models``: model, error, and the model's headline with ``replaced``, whether the rules' own stands for it;
    a round without one there, or with a null headline, has the rules' own. A round without findings or claims has empty
    lists. A round has as many findings as its host has series at most, and few claims: ``claims.MOST_CLAIMS``.
    """
    on = list(keys)
    there = [F.col(c) for c in FINDING if c in findings.columns]
    of_round = findings.groupBy(*keys).agg(_without_pos(_in_order(F.collect_list(F.struct("pos", *there)))).alias("findings"))
    rows = headlines.select(*keys, "severity", F.col("headline").alias("_own")).join(of_round, on, "left")
    if claims is None:
        rows = rows.withColumns({"claims": F.lit(None).cast(_CLAIM), "rejected": F.lit(None).cast(_REJECTED)})
    else:
        kept = F.when(F.col("accepted"), F.struct("pos", "text", "kind", "confidence", "refs", "note"))
        gone = F.when(~F.col("accepted"), F.struct("pos", "text", "reason"))
        each = [_without_pos(_in_order(F.collect_list(x))).alias(name) for name, x in (("claims", kept), ("rejected", gone))]
        rows = rows.join(claims.groupBy(*keys).agg(*each), on, "left")
    if models is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("model", "llm_error", "_said")}).withColumn("replaced", F.lit(True))
    else:
        rows = rows.join(models.select(*keys, "model", F.col("error").alias("llm_error"), F.col("headline").alias("_said"), "replaced"), on, "left")
    own = F.col("_said").isNull() | F.coalesce("replaced", F.lit(True))
    none = F.array()
    return rows.select(
        *keys, "severity", F.when(own, F.col("_own")).otherwise(F.col("_said")).alias("headline"), F.when(own, "rules").otherwise("llm").alias("headline_source"),
        "model", "llm_error", F.coalesce("claims", none.cast(_CLAIM)).alias("claims"), F.coalesce("rejected", none.cast(_REJECTED)).alias("rejected"),
        F.when(F.col("findings").isNull(), F.array().cast(rows.schema["findings"].dataType)).otherwise(F.col("findings")).alias("findings"),
    )
