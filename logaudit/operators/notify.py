"""Which situations are new enough to tell, and what fits into a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logaudit.functions.text import cut

TRUNCATED = "_truncated_"


def situation_digest(findings: DataFrame, keys: tuple[str, ...] = ("host", "round_id")) -> DataFrame:
    """The identity of a round's situation: its rules, severities and labels, whatever the numbers."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    line = F.concat_ws("|", "rule", F.col("severity").cast("string"), labels)
    rows = findings.groupBy(*keys).agg(F.max("severity").alias("severity"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("_lines"))
    return rows.select(*keys, "severity", F.substring(F.sha2("_lines", 256), 1, 16).alias("digest"))


def severity_gate(findings: DataFrame, floor: int, keys: tuple[str, ...] = ("host", "round_id")) -> DataFrame:
    """Rounds and whether any of their findings reaches a floor."""
    return findings.groupBy(*keys).agg(F.max("severity").alias("severity"), (F.max("severity") >= floor).alias("passes"))


def fit(blocks: Column, limit: int | Column) -> Column:
    """Blocks joined by blank lines, as many leading ones as fit; then a mark if that fits too. If the first one
    doesn't fit, as many of its lines; if not even its first line, that line cut."""

    def leading(parts: Column, gap: int) -> Column:
        start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

        def step(acc: Column, part: Column) -> Column:
            cost = F.length(part) + F.when(F.size(acc["kept"]) > 0, gap).otherwise(0)
            full = acc["full"] | (acc["used"] + cost > limit)
            return F.struct(
                F.when(full, acc["used"]).otherwise(acc["used"] + cost).alias("used"), full.alias("full"),
                F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(part))).alias("kept"),
            )

        return F.aggregate(parts, start, step)

    whole = F.array_join(blocks, "\n\n")
    some = leading(blocks, 2)
    first = F.get(blocks, F.lit(0))
    lines = leading(F.split(first, "\n"), 1)["kept"]
    mark = F.when(some["used"] + 2 + len(TRUNCATED) <= limit, F.concat(some["kept"], F.array(F.lit(TRUNCATED)))).otherwise(some["kept"])
    return (
        F.when(F.length(whole) <= limit, whole)
        .when(F.size(some["kept"]) > 0, F.array_join(mark, "\n\n"))
        .when(F.size(lines) > 0, F.array_join(lines, "\n"))
        .otherwise(cut(first, limit))
    )


def blocks(findings: DataFrame, keys: tuple[str, ...] = ("host", "round_id"), fresh: int = 2) -> DataFrame:
    """A round's findings as blocks of lines in order of ``pos``: severity and title, the baseline if there is one, and at
    most two correlations that the round hasn't printed yet."""
    baseline = F.col("baseline") if "baseline" in findings.columns else F.lit(None).cast("string").alias("baseline")
    rows = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "severity", "title", baseline, "correlations"))).alias("_f"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("seen"), none.alias("out"))

    def step(acc: Column, f: Column) -> Column:
        new = F.slice(F.array_except(F.coalesce(f["correlations"], none), acc["seen"]), 1, fresh)
        name = F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("CRITICAL")), f["severity"])
        past = F.when(f["baseline"].isNotNull(), F.array(F.concat(F.lit("> baseline "), f["baseline"]))).otherwise(none)
        lines = F.concat(F.array(F.concat(name, F.lit(" "), f["title"])), past, F.transform(new, lambda c: F.concat(F.lit("> alongside "), c)))
        return F.struct(F.concat(acc["seen"], new).alias("seen"), F.concat(acc["out"], F.array(F.array_join(lines, "\n"))).alias("out"))

    return rows.select(*keys, F.size("_f").alias("n"), F.aggregate("_f", start, step)["out"].alias("blocks"))


def triage(claims: DataFrame, keys: tuple[str, ...] = ("host", "round_id")) -> DataFrame:
    """Checked claims (``pos, text, accepted, confidence``) of each round as one block, hypotheses marked as such, and how
    many were dropped. A round has few claims: ``claims.MOST_CLAIMS``."""
    mark = F.when(F.col("confidence") == "hypothesis", F.lit("- Hypothesis: ")).otherwise(F.lit("- "))
    line = F.when(F.col("accepted"), F.struct("pos", F.concat(mark, "text").alias("line")))
    lines = F.transform(F.array_sort(F.array_compact(F.collect_list(line))), lambda x: x["line"])
    rows = claims.groupBy(*keys).agg(lines.alias("_l"), F.count_if(~F.col("accepted")).alias("dropped"))
    head = "Triage, as the model reads the findings above"
    return rows.select(*keys, F.when(F.size("_l") > 0, F.array_join(F.concat(F.array(F.lit(head)), "_l"), "\n")).alias("triage"), "dropped")


def payloads(
    findings: DataFrame, headlines: DataFrame, most: int = 4096, keys: tuple[str, ...] = ("host", "round_id"),
    claims: DataFrame | None = None, models: DataFrame | None = None, reserve: tuple[int, int] | None = None,
) -> DataFrame:
    """The message of each round with a headline, as JSON: a title of at most 256 characters, a body of at most ``most``
    (never over 4096) with findings first, then the triage, then a trailer that says what is missing, and a footer.

    What doesn't fit is cut from the end, so measurements outlast the model's words. With ``reserve``, the triage and the
    trailer may each take so many characters before the findings get the rest, and are cut to these themselves.
    ``claims`` are checked claims, ``models`` has the keys, ``model`` and ``replaced``, whether the headline is the rules'
    own (a null model: none could be asked). A round without findings has a body without them.
    """
    none = F.array().cast("array<string>")
    rows = headlines.join(blocks(findings, keys), list(keys), "left")
    told = triage(claims, keys) if claims is not None else headlines.select(*keys, F.lit(None).cast("string").alias("triage"), F.lit(0).cast("bigint").alias("dropped")).distinct()
    said = models if models is not None else headlines.select(*keys, F.lit("").alias("model"), F.lit(False).alias("replaced")).distinct()
    rows = rows.join(told, list(keys), "left").join(said.select(*keys, "model", "replaced"), list(keys), "left")
    count = F.coalesce("dropped", F.lit(0))
    lost = F.when(count == 1, "1 claim dropped for lack of evidence").when(count > 1, F.concat(count.cast("string"), F.lit(" claims dropped for lack of evidence")))
    alone = F.when(F.col("model").isNull(), F.lit("Written from the rules: no model could be asked"))
    trailer = F.nullif(F.concat_ws("\n", lost, alone), F.lit(""))
    each = F.coalesce("blocks", none)
    one = lambda text: F.when(text.isNotNull(), F.array(text)).otherwise(none)
    limit = min(most, 4096)
    if reserve is None:
        body = fit(F.concat(each, one(F.col("triage")), one(trailer)), limit)
    else:
        short = [F.when(text.isNotNull(), fit(F.array(text), size)) for text, size in ((F.col("triage"), reserve[0]), (trailer, reserve[1]))]
        rows = rows.withColumn("_rest", F.array_compact(F.array(*short))).withColumn("_left", F.lit(limit) - F.aggregate("_rest", F.lit(0), lambda a, x: a + F.length(x) + 2))
        body = F.array_join(F.concat(one(F.nullif(fit(each, F.col("_left")), F.lit(""))), F.col("_rest")), "\n\n")
    n = F.coalesce("n", F.lit(0))
    footer = F.concat(n.cast("string"), F.when(n == 1, " finding").otherwise(" findings"), F.when(F.coalesce("model", F.lit("")) != "", F.concat(F.lit(", "), "model")).otherwise(""), F.when(F.col("replaced") | F.col("model").isNull(), ", headline from rules").otherwise(""))
    return rows.select(*keys, F.to_json(F.struct(cut(F.col("headline"), 256).alias("title"), F.coalesce(body, F.lit("")).alias("body"), footer.alias("footer"))).alias("payload"))
