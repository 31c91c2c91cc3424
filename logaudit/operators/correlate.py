"""Changes around a finding: collected from signals, attached by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logaudit.operators.history import changed


def collect_changes(signals: DataFrame, window_minutes: int = 1440) -> DataFrame:
    """``host, round_id, kind, description, scope`` from signals with ``prev``: edited files, engine restarts,
    container starts and restarts. A start in the future is none."""
    label = lambda k: F.col("labels")[k]
    jail = F.nullif(F.regexp_extract(F.coalesce(label("file"), F.lit("")), r"filter\.d/([^/]+)\.conf$", 1), F.lit(""))
    none = F.create_map().cast("map<string,string>")
    at = F.try_to_timestamp(F.col("value_text"))
    fresh = at.between(F.col("as_of") - F.expr(f"INTERVAL {window_minutes} MINUTES"), F.col("as_of"))
    one = lambda rows, kind, text, scope: rows.select("host", "round_id", F.lit(kind).alias("kind"), text.alias("description"), scope.alias("scope"))
    edits = signals.where("name = 'config_digest'").where(changed(F.col("prev.value_text"), F.col("value_text")))
    engine = signals.where("name = 'engine_restarts' and value_num > 0")
    starts = signals.where("name = 'started_at'").where((at <= F.col("as_of")) & (fresh | changed(F.col("prev.value_text"), F.col("value_text"))))
    again = signals.where("name = 'restart_count' and value_num > prev.value_num")
    container = F.create_map(F.lit("container"), F.coalesce(label("container"), F.lit("?")))
    return (
        one(edits, "config_edit", F.concat(F.coalesce(label("file"), F.lit("?")), F.lit(" was edited")), F.when(jail.isNotNull(), F.create_map(F.lit("jail"), jail)).otherwise(none))
        .union(one(engine, "service_restart", F.lit("the ban engine restarted"), none))
        .union(one(starts, "container_start", F.concat(F.coalesce(label("container"), F.lit("?")), F.lit(" started")), container))
        .union(one(again, "container_restart", F.concat(F.coalesce(label("container"), F.lit("?")), F.lit(" was restarted")), container))
    )


def correlate(findings: DataFrame, changes: DataFrame, containers: DataFrame) -> DataFrame:
    """Findings with ``correlations``: changes of their host and round whose scope agrees with their labels in
    every entry; an empty scope agrees with all. ``containers`` (jail, container; a few rows of configuration)
    supplies a label that is missing. The join is on host and round; scopes decide among those few."""
    known = F.map_concat(
        F.map_filter("labels", lambda k, _: k != "container"),
        F.map_filter(F.create_map(F.lit("container"), F.coalesce(F.col("labels")["container"], F.col("_container"))), lambda _, v: v.isNotNull()),
    )
    rows = findings.withColumn("_jail", F.col("labels")["jail"]).join(
        F.broadcast(containers.select(F.col("jail").alias("_jail"), F.col("container").alias("_container"))), "_jail", "left"
    )
    rows = rows.withColumn("_labels", known).drop("_jail", "_container")
    own = changes.groupBy("host", "round_id").agg(F.array_sort(F.collect_set(F.struct("kind", "description", F.map_entries("scope").alias("scope")))).alias("_c"))
    fits = lambda c: F.forall(c["scope"], lambda e: F.col("_labels")[e["key"]].eqNullSafe(e["value"]))
    joined = rows.join(own, ["host", "round_id"], "left")
    listed = F.transform(F.filter(F.coalesce("_c", F.array().cast("array<struct<kind:string,description:string,scope:array<struct<key:string,value:string>>>>")), fits), lambda c: c["description"])
    return joined.withColumn("correlations", listed).drop("_c", "_labels")
