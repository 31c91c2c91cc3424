"""Parsers of host snapshots and alert payloads: a text column in, typed columns out."""

from __future__ import annotations

import configparser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logaudit.functions import text as X
from logaudit.schemas import ALERT_PAYLOAD, CONTAINER_STATE

#: File systems without space of their own.
PSEUDO = ("tmpfs", "devtmpfs", "udev", "overlay", "shm", "none")


def disk_rows(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows of POSIX ``df -P`` output: the header and lines of fewer than six fields go, as do rows whose numbers
    can't be read and pseudo file systems. A mount point may hold blanks."""
    f = F.split(F.trim("line"), r"\s+")
    rows = df.select("*", F.posexplode(F.split(col, "\n")).alias("pos", "line")).where("pos > 0").withColumn("f", f).where("size(f) >= 6")
    number = lambda i, kind: F.get("f", F.lit(i)).try_cast(kind)
    return (
        rows.select(
            *[c for c in df.columns if c != col],
            F.get("f", F.lit(0)).alias("filesystem"), number(1, "bigint").alias("total"), number(2, "bigint").alias("used"),
            number(3, "bigint").alias("available"), F.rtrim(F.get("f", F.lit(4)), F.lit("%")).try_cast("int").alias("capacity"),
            F.array_join(F.slice("f", 6, F.size("f")), " ").alias("mount"),
        )
        .where("available is not null and capacity is not null")
        .where(~F.col("filesystem").isin(*PSEUDO))
    )


def certificate(df: DataFrame, col: str = "text") -> DataFrame:
    """``not_after, subject, days_left, kind`` of certificate dumps; a date in neither of two formats is an error.
    ``as_of`` is a column of the input."""
    text = F.regexp_replace(X.group(F.col(col), r"notAfter=([^\n]*)", 1), " +", " ")
    at = F.coalesce(F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssX")))
    days = F.round((F.unix_micros(at) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 86400e6, 2)
    return df.select(
        *[c for c in df.columns if c != col], at.alias("not_after"), X.group(F.col(col), r"subject=\s*([^\n]*)", 1).alias("subject"),
        days.alias("days_left"), F.when(at.isNull(), "error").otherwise("metric").alias("kind"),
    )


def container_state(df: DataFrame, col: str = "text", restarts: str = "restarts") -> DataFrame:
    """Container state JSON to columns. Null text: not running; text that can't be read: an error."""
    s = F.from_json(F.col(col), CONTAINER_STATE)
    bad = F.col(col).isNotNull() & F.try_parse_json(col).isNull()
    return df.select(
        *[c for c in df.columns if c not in (col, restarts)],
        F.when(bad, "error").otherwise("state").alias("kind"),
        F.when(~bad, F.coalesce(s["Running"], F.lit(False))).alias("running"),
        s["StartedAt"].alias("started_at"), s["OOMKilled"].alias("oom_killed"), s["Health"]["Status"].alias("health"),
        F.when(F.col(restarts).rlike(r"^\d+$"), F.col(restarts).cast("bigint")).alias("restart_count"),
    )


def jail_status(df: DataFrame, col: str = "text") -> DataFrame:
    """Counters, log paths and banned addresses of a jail's status text, each null or empty if absent."""
    t = F.col(col)
    counts = {"currently_failed": "Currently failed", "total_failed": "Total failed", "currently_banned": "Currently banned", "total_banned": "Total banned"}
    items = lambda head: F.filter(F.split(F.regexp_extract(t, head + r":[ \t]*([^\n]*)", 1), r"\s+"), lambda x: x != "")
    return df.select(
        *[c for c in df.columns if c != col],
        *[X.group(t, rf"{words}:\s*(\d+)", 1).cast("bigint").alias(name) for name, words in counts.items()],
        items("File list").alias("log_paths"), items("Banned IP list").alias("banned_ips"),
    )


def jail_list(text: Column) -> Column:
    """The names in a jail list."""
    return F.filter(F.split(F.regexp_extract(text, r"Jail list:\s*([^\n]*)", 1), r"[,\s]+"), lambda x: x != "")


def _stanzas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ("enabled", "filter", "logpath", "maxretry", "findtime")
    for frame in frames:
        out = []
        for host, jail, text in zip(frame["host"], frame["jail"], frame["text"], strict=True):
            ini = configparser.RawConfigParser(strict=False)
            try:
                ini.read_string(text or "")
                present = ini.has_section(jail)
            except configparser.Error:
                present = False
            out.append((host, jail, present, *[ini.get(jail, c, fallback=None) if present else None for c in columns]))
        yield pd.DataFrame(out, columns=["host", "jail", "present", *columns])


def jail_definitions(df: DataFrame) -> DataFrame:
    """A jail's stanza in an INI text (``host, jail, text``), with values of DEFAULT where it has none; small
    files, one row each."""
    schema = "host string, jail string, present boolean, enabled string, filter string, logpath string, maxretry string, findtime string"
    return df.select("host", "jail", "text").mapInPandas(_stanzas, schema)


def settings(text: Column) -> Column:
    """``key = value`` lines as a map: values trimmed, the last of a key wins."""
    pairs = F.filter(F.split(text, "\n"), lambda line: line.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries) + 1), lambda x: x["key"] == e["key"])) == 0)
    return F.map_from_entries(last)


def queue_depth(text: Column) -> Column:
    """0 for an empty queue, else the count of the summary line, else the blocks between blank lines."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t"))
    count = X.group(t, X.QUEUE_COUNT, 1).cast("bigint")
    return F.when((t == "") | t.contains("Mail queue is empty"), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(count, F.size(F.split(t, "\n\n")).cast("bigint"))
    )


def tool_matches(text: Column) -> Column:
    """Matched lines in the summary of the offline filter tool."""
    return X.group(text, X.TOOL_MATCHED, 1).try_cast("bigint")


def alert_spool(files: DataFrame, since: Column, most_bytes: int | None) -> DataFrame:
    """Spooled payloads (``path, modificationTime, length, content``) from a moment on: parsed, or an error with
    its reason. A payload of a wrong shape is refused whole; one of any size is read if ``most_bytes`` is none."""
    body = F.decode("content", "utf-8")
    return _payloads(files.where(F.col("modificationTime") >= since).withColumn("body", body).drop("content"), most_bytes)


#: What Variant takes for broken, from_json does too.
_STRICT = {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _payloads(rows: DataFrame, most_bytes: int | None) -> DataFrame:
    v = F.try_parse_json("body")
    alerts = F.schema_of_variant(F.try_variant_get(v, "$.alerts", "variant"))
    shape = F.schema_of_variant(v).startswith("OBJECT") & F.coalesce(alerts.startswith("ARRAY"), F.lit(True))
    # An object over 128 MiB or with a name twice is JSON, but no variant.
    whole = F.from_json("body", "alerts string, _bad string", _STRICT)
    listed = F.from_json("body", "alerts array<string>, _bad string", _STRICT)["alerts"].isNotNull()
    no_variant = (
        F.when(whole.isNull() | whole["_bad"].isNotNull(), "not JSON")
        .when(~listed & F.array_contains(F.json_object_keys("body"), "alerts"), "wrong shape")
    )
    reason = F.when(v.isNull(), no_variant).when(~F.coalesce(shape, F.lit(False)), "wrong shape")
    if most_bytes is not None:
        reason = F.when(F.col("length") > most_bytes, "too large").otherwise(reason)
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("payload", F.when(F.col("reason").isNull(), F.from_json("body", ALERT_PAYLOAD)))


def ingest_gate(bodies: DataFrame, most_bytes: int | None) -> DataFrame:
    """Bodies with ``accepted`` and the reason of a refusal; a good body is kept as it is. No size is too large if
    ``most_bytes`` is none."""
    rows = _payloads(bodies.withColumn("length", F.octet_length("body")), most_bytes)
    return rows.select(*bodies.columns, F.col("reason").isNull().alias("accepted"), "reason")


#: Labels that identify an alert and stay few.
KEY_LABELS = ("alertname", "severity", "instance", "job")


def alert_rows(payloads: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each alert of a payload: status, bounded labels, summary."""
    rows = payloads.select(*keep, F.explode("payload.alerts").alias("a"))
    few = F.map_filter("a.labels", lambda k, _: k.isin(*KEY_LABELS))
    named = F.when(F.map_contains_key(few, "alertname"), few).otherwise(F.map_concat(few, F.create_map(F.lit("alertname"), F.lit("unnamed"))))
    note = lambda k: F.nullif(F.col("a.annotations")[k], F.lit(""))
    pairs = F.array_join(F.transform(F.sort_array(F.map_entries("a.labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return rows.select(
        *keep,
        F.lower("a.status").alias("status"),
        F.when(few.isNull(), F.create_map(F.lit("alertname"), F.lit("unnamed"))).otherwise(named).alias("labels"),
        F.left(F.coalesce(note("summary"), note("description"), note("message"), pairs, F.lit("")), F.lit(400)).alias("summary"),
    )
