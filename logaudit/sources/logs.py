"""Readers of container, mail and ban-engine logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.functions import text as X
from logaudit.sources import tables


#: Splits whose places are broadcast; with more, lines are joined with them by a shuffle.
BROADCAST_SPLITS = 200_000


def member(file: Column, whole_folder: bool) -> tuple[Column, Column]:
    """The log that a file belongs to, and its age in it. Rotated files (``x.log.2.gz``, ``x.log.1``, ``x.log-20240131``)
    are members of one log, the greater number or earlier date the older, and the plain name is the newest. With
    ``whole_folder`` all files of a folder are members, in order of their names."""
    if whole_folder:
        return F.regexp_replace(file, "/[^/]*$", ""), F.lit(0).cast("long")
    plain = F.regexp_replace(file, r"\.gz$", "")
    number, date = (F.nullif(F.regexp_extract(plain, p, 1), F.lit("")).cast("long") for p in (r"\.(\d{1,6})$", r"[-.](\d{8})$"))
    return F.regexp_replace(plain, r"\.\d{1,6}$|[-.]\d{8}$", ""), F.coalesce(number, F.lit(1_000_000_000) - date, F.lit(0).cast("long"))


def read_lines(spark: SparkSession, path: str | list[str], whole_folder: bool = False) -> DataFrame:
    """Lines of text files, plain or gzip: the columns that the path holds (``host=.../container=...``), ``file, line_no,
    log, log_line, raw``. ``line_no`` counts from 1 within the file, ``log_line`` over all members of the log, oldest
    first (see ``member``). Lines end with a newline alone; empty lines count.

    A file is read in as many splits as Spark likes. A first pass counts the lines of each split; the counts before a
    split, in its file and in its log, are carried over, and a line's place in its split comes from the order in which
    its task reads. No line is shuffled, and no file is read by one task but a compressed one. If the splits of the two
    passes differ, the job fails with "splits have changed", instead of giving other numbers.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    own = [c for c in rows.columns if c != "value"]
    lines = rows.select(*own, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    log, age = member(F.col("file"), whole_folder)
    splits = tables.cut(counts.select("*", log.alias("log"), age.alias("age")), "splits")
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy(*order[:1]).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.select("file", "split", "n", "first", "log", before("file", "split").alias("in_file"), before("log", F.desc("age"), "file", "split").alias("in_log"))
    if splits.count() <= BROADCAST_SPLITS:
        placed = F.broadcast(placed)
    place = F.col("at") - F.col("first")
    place = F.when((place >= 0) & (place < F.col("n")), place + 1).otherwise(F.raise_error(F.lit("splits have changed between two passes: read again")).cast("long"))
    met = lines.join(placed, ["file", "split"], "left").withColumn("place", place)
    return met.select(*own, "file", (F.col("in_file") + F.col("place")).alias("line_no"), "log", (F.col("in_log") + F.col("place")).alias("log_line"), "raw")


def decode_wire(lines: DataFrame) -> DataFrame:
    """Adds ``message, ts_text, ts, wire_format, decoded`` to raw json-file lines. Blank lines go, but keep their
    number; a line that isn't a JSON object with a text under ``log`` has ``decoded`` false and no message."""
    v = F.try_parse_json("raw")
    log = F.try_variant_get(v, "$.log", "variant")
    good = F.col("raw").startswith("{") & F.coalesce(F.schema_of_variant(log) == "STRING", F.lit(False))
    time = F.try_variant_get(v, "$.time", "string")
    return lines.where(F.trim("raw") != "").select(
        "*",
        F.when(good, F.rtrim(F.try_variant_get(v, "$.log", "string"), F.lit("\n"))).alias("message"),
        F.when(good, time).alias("ts_text"),
        F.when(good, X.moment(time)).alias("ts"),
        F.lit(True).alias("wire_format"),
        good.alias("decoded"),
    )


def decode_stamped(lines: DataFrame) -> DataFrame:
    """The same columns from plain lines that start with a timestamp; ``wire_format`` is false and the message
    is all that there is of the raw line."""
    good = F.col("raw").rlike(X.STAMPED)
    stamp, message = X.group(F.col("raw"), X.STAMPED, 1), F.regexp_extract("raw", X.STAMPED, 2)
    return lines.where(F.trim("raw") != "").select(
        *[c for c in lines.columns if c != "raw"],
        F.when(good, message).otherwise(F.col("raw")).alias("raw"),
        F.when(good, message).alias("message"),
        F.when(good, stamp).alias("ts_text"),
        F.when(good, X.moment(stamp)).alias("ts"),
        F.lit(False).alias("wire_format"),
        good.alias("decoded"),
    )


def read_quality(decoded: DataFrame) -> DataFrame:
    """Lines, undecodable lines, whether raw bytes were there, and the kind of row that this makes."""
    found = decoded.groupBy("host", "container").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("decoded")).alias("undecodable"), F.bool_and("wire_format").alias("wire_format")
    )
    return found.withColumn("kind", F.when(F.col("undecodable") > 0, "error").otherwise("state"))


def since_text(as_of, minutes: int):
    """The cutoff of a lookback as text that compares like the log's own stamps."""
    return F.concat(F.date_format(as_of - F.expr(f"INTERVAL {minutes} MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000000Z"))


def lookback(decoded: DataFrame, cutoff) -> DataFrame:
    """Lines stamped at the cutoff or later, compared as text; a line without a stamp stays."""
    return decoded.where(F.coalesce(F.col("ts_text") >= cutoff, F.lit(True)))


def day_slice(lines: DataFrame, day: str) -> DataFrame:
    """Raw lines of one UTC day: json lines by their time field, plain lines by how they start."""
    return lines.where(F.col("raw").contains(f'"time":"{day}') | F.col("raw").startswith(day))


def smtp_auth_failures(decoded: DataFrame) -> DataFrame:
    """SASL failures of any listener and mechanism, on decoded messages."""
    m = F.col("message")
    return decoded.where(m.rlike(X.SMTP_AUTH)).select(
        *decoded.columns,
        F.regexp_extract(m, X.SMTP_AUTH, 1).alias("service"),
        F.regexp_extract(m, X.SMTP_AUTH, 2).alias("peer"),
        F.regexp_extract(m, X.SMTP_AUTH, 3).alias("mechanism"),
        X.group(m, X.SMTP_USER, 1).alias("username"),
        F.lit(None).cast("int").alias("attempts"),
    )


def relay_denied(decoded: DataFrame) -> DataFrame:
    """Relay rejections with any status code."""
    m = F.col("message")
    return decoded.where(m.rlike(X.RELAY)).select(
        *decoded.columns, *[F.regexp_extract(m, X.RELAY, i).alias(n) for i, n in ((1, "service"), (2, "peer"), (3, "code"))]
    )


def messages_sent(decoded: DataFrame) -> DataFrame:
    """Lines that report a delivery."""
    return decoded.where(F.col("message").rlike(X.SENT))


def login_failures(decoded: DataFrame) -> DataFrame:
    """Failed mailbox logins; lines without attempts don't match."""
    m = F.col("message")
    return decoded.where(m.rlike(X.BOX_FAILED)).select(
        *decoded.columns,
        F.lower(F.regexp_extract(m, X.BOX_FAILED, 1)).alias("service"),
        F.regexp_extract(m, X.BOX_FAILED, 3).alias("peer"),
        F.lit(None).cast("string").alias("mechanism"),
        X.group(m, X.BOX_USER, 1).alias("username"),
        F.regexp_extract(m, X.BOX_FAILED, 2).cast("int").alias("attempts"),
    )


def failures(decoded: DataFrame) -> DataFrame:
    """SASL failures and failed mailbox logins in one pass over the lines. A line is of one kind: the two shapes begin
    with services that differ."""
    m = F.col("message")
    smtp, box = m.rlike(X.SMTP_AUTH), m.rlike(X.BOX_FAILED)
    either = lambda a, b: F.when(F.col("_smtp"), a).otherwise(b)
    return decoded.withColumn("_smtp", F.when(smtp, True).when(box, False)).where("_smtp is not null").select(
        *decoded.columns,
        either(F.regexp_extract(m, X.SMTP_AUTH, 1), F.lower(F.regexp_extract(m, X.BOX_FAILED, 1))).alias("service"),
        either(F.regexp_extract(m, X.SMTP_AUTH, 2), F.regexp_extract(m, X.BOX_FAILED, 3)).alias("peer"),
        F.when(F.col("_smtp"), F.regexp_extract(m, X.SMTP_AUTH, 3)).alias("mechanism"),
        either(X.group(m, X.SMTP_USER, 1), X.group(m, X.BOX_USER, 1)).alias("username"),
        F.when(~F.col("_smtp"), F.regexp_extract(m, X.BOX_FAILED, 2).cast("int")).alias("attempts"),
    )


def logins_ok(decoded: DataFrame) -> DataFrame:
    """Successful mailbox logins."""
    m = F.col("message")
    return decoded.where(m.rlike(X.BOX_LOGIN)).select(
        *decoded.columns, F.lower(F.regexp_extract(m, X.BOX_LOGIN, 1)).alias("service"),
        X.group(m, X.BOX_LOGIN, 2).alias("username"), F.regexp_extract(m, X.BOX_LOGIN, 3).alias("peer"),
    )


def engine_events(lines: DataFrame) -> DataFrame:
    """``jail, action, logger, stamp, event_time, peer`` of ban-engine lines. The time behind the dash is when
    the event was; without one it is the logger's stamp, and one that can't be read drops the line."""
    raw = F.col("raw")
    rest = F.regexp_extract(raw, X.ENGINE, 5)
    stamp = F.regexp_extract(raw, X.ENGINE, 1)
    tail = F.regexp_extract(rest, X.ENGINE_TAIL, 1)
    fmt = F.lit("yyyy-MM-dd HH:mm:ss")
    found = lines.where(raw.rlike(X.ENGINE)).select(
        *lines.columns,
        F.regexp_extract(raw, X.ENGINE, 3).alias("jail"),
        F.regexp_extract(raw, X.ENGINE, 4).alias("action"),
        F.regexp_extract(raw, X.ENGINE, 2).alias("logger"),
        F.try_to_timestamp(stamp, fmt).alias("stamp"),
        F.try_to_timestamp(F.when(tail != "", tail).otherwise(stamp), fmt).alias("event_time"),
        X.group(rest, r"^\s*([0-9A-Fa-f.:]+)", 1).alias("peer"),
    )
    return found.where("event_time is not null")


def authoritative(events: DataFrame) -> DataFrame:
    """Events of the logger whose word counts for their action."""
    pairs = F.create_map(*[F.lit(x) for kv in X.LOGGER_OF.items() for x in kv])
    return events.where(pairs[F.col("action")] == F.col("logger"))


def engine_restarts(lines: DataFrame, cutoff=None) -> DataFrame:
    """Start lines of the ban engine whose stamp can be read, from a cutoff on."""
    at = F.try_to_timestamp(F.substring("raw", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    found = lines.where(F.col("raw").contains(X.ENGINE_START)).withColumn("started", at).where("started is not null")
    return found if cutoff is None else found.where(F.col("started") >= cutoff)
