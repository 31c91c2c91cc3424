"""Job inputs from the driver's tables: log lines, engine lines, signals, payloads and completions.

Shapes that both engines can build are SQL text of the common dialect; texts that the library has to parse
are built in Spark alone, and the SQL to match counts on the columns that they were built from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logaudit.functions.text import series_key

#: Events with host, container, jail, listener and peer; ``good`` is false where the log line is broken.
EV = """ev AS (
 SELECT event_id, ts, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS STRING) AS round_id, user_id, event_type, value,
  'host' || CAST(user_id % 3 AS STRING) AS host, event_id + 1 AS line_no,
  CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN 'mail' ELSE 'box' END AS container,
  CASE WHEN event_type IN ('error', 'signup', 'purchase') THEN 'mail-jail' ELSE 'box-jail' END AS jail,
  CASE WHEN event_type NOT IN ('error', 'signup', 'purchase') THEN CASE WHEN user_id % 2 = 0 THEN 'pop3' ELSE 'imap' END
       WHEN CAST(floor(user_id / 3) AS BIGINT) % 3 = 0 THEN 'smtpd' WHEN CAST(floor(user_id / 3) AS BIGINT) % 3 = 1 THEN 'submission/smtpd'
       ELSE 'smtps/smtpd' END AS service,
  '203.0.113.' || CAST(user_id % 250 AS STRING) AS peer,
  CASE WHEN user_id % 2 = 0 THEN '454 4.7.1' ELSE '554 5.7.1' END AS code,
  event_id % 97 <> 0 AND event_id % 101 <> 0 AS good
 FROM events)"""

#: Signals of a host and day: name, kind, labels, value (a number of metrics, else a text), and on which days there is one.
SIGNAL_ROWS = (
    ("failures_total", "metric", "jail=mail-jail", "CASE WHEN s % 5 = 0 THEN ne * 7 ELSE ne END", ""),
    ("messages_sent", "metric", "container=mail", "CASE WHEN s % 7 = 0 THEN np * 9 ELSE np END", "s % 11 <> 0"),
    ("queue_depth", "metric", "", "nc % 4 + CASE WHEN s % 9 = 0 THEN 50 ELSE 0 END", "s % 6 <> 0"),
    ("uncounted", "metric", "jail=mail-jail", "CASE WHEN s % 3 = 0 THEN ne ELSE 0 END", ""),
    ("engine_drift", "metric", "jail=mail-jail", "ns - nv", ""),
    ("disk_used_percent", "metric", "", "80 + n % 20", ""),
    ("disk_available_bytes", "metric", "", "1000 + s % 3000", ""),
    ("cert_days_left", "metric", "", "s % 60 - 3", ""),
    ("total_failed", "metric", "jail=mail-jail", "s % 1000", ""),
    ("restart_count", "metric", "container=mail", "s % 3", ""),
    ("engine_restarts", "metric", "", "CASE WHEN s % 8 = 0 THEN 1 ELSE 0 END", ""),
    ("filter_as_expected", "state", "jail=mail-jail", "CASE WHEN s % 4 = 0 THEN 'false' ELSE 'true' END", ""),
    ("logging_healthy", "state", "container=box", "CASE WHEN s % 10 = 0 THEN 'false' ELSE 'true' END", ""),
    ("config_digest", "state", "file=filter.d/mail-jail.conf", "CAST(CAST(floor(n / 40) AS BIGINT) AS STRING)", ""),
    ("observed", "metric", "jail=mail-jail", "ne", ""),
    ("matched", "metric", "jail=mail-jail", "CASE WHEN s % 3 = 0 THEN 0 ELSE ne END", ""),
    ("found", "metric", "jail=mail-jail", "ns", "s % 4 <> 0"),
    ("uncounted_by_service", "metric", "jail=mail-jail,service=smtpd", "CASE WHEN s % 3 = 0 THEN ne - floor(ne / 2) ELSE 0 END", ""),
    ("uncounted_by_service", "metric", "jail=mail-jail,service=smtps/smtpd", "CASE WHEN s % 6 = 0 THEN floor(ne / 2) ELSE 0 END", ""),
    ("disk_inodes_percent", "metric", "", "85 + s % 15", ""),
    ("filter_declared", "state", "jail=mail-jail", "CASE WHEN s % 4 = 0 THEN 'other' ELSE 'mail-jail' END", ""),
    ("filter_file_present", "state", "jail=mail-jail", "CASE WHEN s % 14 = 0 THEN 'false' ELSE 'true' END", ""),
    ("started_at", "state", "container=mail", "CASE WHEN s % 5 = 0 THEN round_id || ' 06:00:00' ELSE '2023-01-01 00:00:00' END", ""),
    ("certificate", "error", "", "NULL", "s % 13 = 0"),
)


def _signal(name: str, kind: str, label: str, value: str, when: str) -> str:
    number, text = (value, "NULL") if kind == "metric" else ("NULL", value)
    return f"'{name}' AS name, '{kind}' AS kind, '{label}' AS label, CAST({number} AS DOUBLE) AS value_num, CAST({text} AS STRING) AS value_text"


_UNION = " UNION ALL ".join(f"SELECT host, day, round_id, {_signal(*r)} FROM dd" + (f" WHERE {r[4]}" if r[4] else "") for r in SIGNAL_ROWS)
#: The same in one pass over the days, as Spark alone can write it.
_INLINE = "SELECT host, day, round_id, name, kind, label, value_num, value_text FROM dd LATERAL VIEW inline(array(" + ", ".join(
    f"struct({r[4] or 'true'} AS there, {_signal(*r)})" for r in SIGNAL_ROWS
) + ")) x WHERE there"

#: Signals of every host and day, and days on which some of them are silent.
SIG = (
    EV
    + """, dd AS (
 SELECT host, day, round_id, count(*) AS n, sum(event_id) AS s,
  count(*) FILTER (WHERE event_type = 'error') AS ne, count(*) FILTER (WHERE event_type = 'signup') AS ns,
  count(*) FILTER (WHERE event_type = 'purchase') AS np, count(*) FILTER (WHERE event_type = 'view') AS nv,
  count(*) FILTER (WHERE event_type = 'click') AS nc
 FROM ev GROUP BY host, day, round_id),
 sig AS (SELECT host, day, round_id, name, kind, label, value_num, value_text FROM (""" + _UNION + """) q)"""
)


def run_sql(spark: SparkSession, sf: str, ctes: str, select: str, tables: tuple[str, ...] = ("events",)) -> DataFrame:
    """A query of the common dialect over tables of a folder. They are views of names that no caller uses."""
    text = f"WITH {ctes.replace(_UNION, _INLINE)} {select}"
    for t in tables:
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(f"logaudit_input_{t}")
        text = re.sub(rf"\bFROM {t}\b", f"FROM logaudit_input_{t}", text)
    return spark.sql(text)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their derived columns."""
    return run_sql(spark, sf, EV, "SELECT * FROM ev")


def wire_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Container log lines, one of them for each event. Angle brackets are escaped as log drivers do."""
    user = F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    smtp = lambda *x: F.concat(F.lit("mx postfix/"), "service", F.lit("[12]: "), *x)
    box = lambda *x: F.concat(F.lit("dovecot: "), "service", F.lit("-login: Info: "), *x)
    name = F.concat(F.lit("user=\\u003c"), user, F.lit("\\u003e"))
    message = (
        F.when(F.col("event_type") == "error", smtp(F.lit("warning: unknown["), "peer", F.lit("]: SASL LOGIN authentication failed: x, sasl_username="), user))
        .when(F.col("event_type") == "signup", smtp(F.lit("NOQUEUE: reject: RCPT from unknown["), "peer", F.lit("]: "), "code", F.lit(" x: Relay access denied; y")))
        .when(F.col("event_type") == "purchase", smtp(F.lit("A1: to=x, status=sent (ok)")))
        .when(F.col("event_type") == "view", box(F.lit("Disconnected (auth failed, "), (F.col("user_id") % 5 + 1).cast("string"), F.lit(" attempts in 2 secs): "), name, F.lit(", rip="), "peer", F.lit(", x")))
        .otherwise(box(F.lit("Login: "), name, F.lit(", method=PLAIN, rip="), "peer", F.lit(", x")))
    )
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    log = F.when(F.col("event_id") % 101 == 0, F.lit("5")).otherwise(F.concat(F.lit('"'), message, F.lit('\\n"')))
    json = F.concat(F.lit('{"log":'), log, F.lit(',"stream":"stdout","time":"'), stamp, F.lit('"}'))
    raw = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("not json "), F.col("event_id").cast("string"))).otherwise(json)
    return events(spark, sf).select(
        "host", "container", "jail", "round_id", F.concat("container", F.lit(".log")).alias("file"), F.col("line_no").cast("bigint").alias("line_no"), raw.alias("raw")
    )


def engine_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ban-engine log lines, with decoys of another logger and start lines."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    say = lambda logger, text, *x: F.concat(at, F.lit(f",123 fail2ban.{logger} [7]: INFO [mail-jail] {text} "), "peer", *x)
    raw = (
        F.when(F.col("event_type") == "error", say("filter", "Found", F.lit(" - "), at))
        .when(F.col("event_type") == "signup", say("actions", "Ban"))
        .when(F.col("event_type") == "purchase", say("actions", "Unban"))
        .when(F.col("event_type") == "view", say("observer", "Found", F.lit(", bad - "), at))
        .otherwise(F.concat(at, F.lit(",001 fail2ban.server [7]: INFO Starting Fail2ban v1")))
    )
    return events(spark, sf).select("host", "round_id", F.col("line_no").cast("bigint").alias("line_no"), raw.alias("raw"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of all rounds, with labels, keys and times, and a line of evidence where services are told apart."""
    empty = F.create_map().cast("map<string,string>")
    labels = F.when(F.col("label") == "", empty).otherwise(F.str_to_map("label", F.lit(","), F.lit("=")))
    line = F.struct(F.lit("log").alias("kind"), F.lit("mail.log").alias("ref"), F.concat(F.lit("first of "), labels["service"]).alias("excerpt"), F.col("value_num").cast("bigint").alias("line_no"))
    rows = run_sql(spark, sf, SIG, "SELECT * FROM sig").withColumn("evidence", F.when(F.col("name") == "uncounted_by_service", F.array(line))).withColumn("labels", labels)
    day = F.col("day").cast("timestamp")
    return rows.select(
        "host", "round_id", (day + F.expr("INTERVAL 86399 SECONDS")).alias("as_of"), day.alias("observed_at"), "name", "kind", "labels",
        series_key(F.col("name"), F.col("labels")).alias("key"), "value_num", "value_text", "evidence",
    )


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts' rounds with their end."""
    return signals(spark, sf).select("host", "round_id", "as_of").distinct()


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """An alert payload for each host and day: ``host, round_id, body``; every ninth body is broken, every
    seventh of a wrong shape."""
    e = events(spark, sf)
    alert = F.struct(
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("firing").alias("status"),
        F.create_map(F.lit("alertname"), F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string")), F.lit("severity"), F.when(F.col("user_id") % 2 == 0, "critical").otherwise("spicy"), F.lit("pod"), F.col("peer"), F.lit("instance"), F.col("container")).alias("labels"),
        F.create_map(F.lit("summary"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.concat(F.lit("s"), F.col("event_id").cast("string"))), F.lit("description"), F.concat(F.lit("d"), F.col("event_id").cast("string"))).alias("annotations"),
    )
    own = e.where("event_type = 'error'").groupBy("host", "round_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("event_id", F.to_json(alert).alias("a")))).alias("x"), F.sum("event_id").alias("s")
    )
    more = F.when(F.col("s") % 5 == 0, ',"truncatedAlerts":3}').otherwise("}")
    body = F.concat(F.lit('{"version":"4","alerts":['), F.array_join(F.transform("x", lambda v: v["a"]), ","), F.lit("]"), more)
    return own.select("host", "round_id", "s", F.when(F.col("s") % 9 == 0, "{broken").when(F.col("s") % 7 == 0, '{"alerts": "none"}').otherwise(body).alias("body"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with addresses, mail and links: documents and page addresses."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("page"), F.col("page_id"), F.concat(F.lit("see "), "url", F.lit(" in /srv/x/"), F.col("page_id").cast("string"), F.lit(" or /var/log/y from 10.0.0.7")))
    return docs.union(pages)


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """A model's text for each host and day, with claims that hold and claims that don't."""
    rows = run_sql(spark, sf, SIG, "SELECT host, round_id, ne, np, s FROM dd")
    claim = lambda text, kind, ref: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.array(F.lit(ref)).alias("refs"))
    number = lambda c: F.col(c).cast("string")
    claims = F.array(
        claim(F.concat(number("ne"), F.lit(" failures were seen")), "observation", "failures"),
        claim(F.concat(number("np"), F.lit(" failures were seen")), "observation", "failures"),
        claim(F.lit("987654 failures were seen"), "observation", "failures"),
        claim(F.lit("port 587654 may be open"), "next_step", "failures"),
        claim(F.lit("someone tries names"), "explanation", "sent"),
        claim(F.lit("nothing else"), "observation", "elsewhere"),
        claim(F.lit(""), "observation", "sent"),
        *[claim(F.lit("look at the filter"), "next_step", "failures")] * 7,  # more than are examined
    )
    said = F.to_json(F.struct(F.when(F.col("s") % 2 == 0, F.concat(number("ne"), F.lit(" failures"))).otherwise(F.lit("777777 failures")).alias("headline"), F.array(F.lit("failures"), F.lit("nowhere")).alias("headline_refs"), claims.alias("claims")))
    return rows.select("host", "round_id", F.when(F.col("s") % 17 == 0, F.lit("no idea")).otherwise(F.concat(F.lit("```json\n"), said, F.lit("\n```"))).alias("text"))
