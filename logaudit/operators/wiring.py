"""States of the set-up: which filter a jail really uses, and whether authentication leaves lines to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log paths that nobody reads from a container's log.
BLIND_PATHS = ("", "syslog")


def _states(rows: DataFrame, keys: list[str], states: list[tuple[str, Column, Column]]) -> DataFrame:
    """A row for each state whose condition holds: the keys, its name and its value as text."""
    each = F.array(*[F.when(holds, F.struct(F.lit(name).alias("name"), value.cast("string").alias("value_text"))) for name, holds, value in states])
    return rows.select(*keys, F.explode(F.array_compact(each)).alias("state")).select(*keys, "state.*")


def filter_states(definitions: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """``host, jail, name, value_text``: the filter that each jail declares (its own name if the stanza names none),
    whether it is the expected one, where one is expected, and whether its file is there; of a jail without a stanza
    only that it has none.

    ``definitions``: host, jail, present, filter. ``expected``: jail, expected (null: any). ``files``: host and filter,
    the filters that have a file there. A repeated row of one of them counts once.
    """
    have = files.select("host", F.col("filter").alias("declared"), F.lit(True).alias("there")).distinct()
    wanted = expected.groupBy("jail").agg(F.max("expected").alias("expected"))
    named = definitions.select("host", "jail", "present", F.coalesce(F.nullif(F.trim("filter"), F.lit("")), "jail").alias("declared")).distinct()
    rows = named.join(wanted, "jail", "left").join(have, ["host", "declared"], "left")
    present = F.coalesce("present", F.lit(False))
    return _states(
        rows,
        ["host", "jail"],
        [
            ("stanza_present", ~present, F.lit(False)),
            ("filter_declared", present, F.col("declared")),
            ("filter_as_expected", present & F.col("expected").isNotNull(), F.col("declared") == F.col("expected")),
            ("filter_file_present", present, F.col("there").isNotNull()),
        ],
    )


def logging_states(settings: DataFrame, lines: DataFrame) -> DataFrame:
    """``host, container, name, value_text``: whether authentication is logged where it can be read, and, where it is
    but left no line in the window, that its lines are absent.

    ``settings``: host, container and a map of settings. ``lines``: host, container and the number of authentication
    lines; a container without a row has none.
    """
    value = lambda name: F.lower(F.trim(F.coalesce(F.col("settings")[name], F.lit(""))))
    healthy = ~value("log_path").isin(*BLIND_PATHS) & (value("auth_verbose") == "yes")
    seen = lines.groupBy("host", "container").agg(F.sum("lines").alias("lines"))
    rows = settings.select("host", "container", healthy.alias("healthy")).join(seen, ["host", "container"], "left")
    none = F.coalesce("lines", F.lit(0)) == 0
    return _states(rows, ["host", "container"], [("logging_healthy", F.lit(True), F.col("healthy")), ("auth_lines_absent", F.col("healthy") & none, F.lit(True))])
