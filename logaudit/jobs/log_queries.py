"""Queries over log lines: sources, extraction, counts and cross-checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logaudit.functions import text as X
from logaudit.jobs import inputs as I
from logaudit.jobs.inputs import EV
from logaudit.operators import crosscheck as C
from logaudit.sources import logs as L
from logaudit.sources import tables

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that it must match."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


def _decoded(spark, sf):
    return L.decode_wire(I.wire_lines(spark, sf))


@query(f"WITH {EV} SELECT host, container, line_no, good AS decoded FROM ev")
def read_wire_log(spark, sf):
    return _decoded(spark, sf).select("host", "container", "line_no", "decoded")


@query(f"WITH {EV} SELECT host, container, row_number() OVER (PARTITION BY host, container ORDER BY event_id) AS log_line, CASE WHEN good THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' END AS ts_text FROM ev")
def numbered_lines(spark, sf):
    # Files of several members for each container, as a log shipper leaves them, read back and numbered.
    path = tables.new_path(spark, "logs")
    order = ("host", "container", "line_no")
    I.wire_lines(spark, sf).repartitionByRange(8, *order).sortWithinPartitions(*order).select("host", "container", F.col("raw").alias("value")).write.partitionBy("host", "container").text(path)
    return L.decode_wire(L.read_lines(spark, path, whole_folder=True)).select("host", "container", "log_line", "ts_text")


@query(f"WITH {EV} SELECT host, line_no, CASE WHEN event_id % 89 <> 0 THEN event_type END AS message, event_id % 89 <> 0 AS decoded FROM ev")
def read_stamped_log(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "))
    raw = F.when(F.col("event_id") % 89 == 0, "no stamp").otherwise(F.concat(stamp, "event_type"))
    return L.decode_stamped(I.events(spark, sf).select("host", "line_no", raw.alias("raw"))).select("host", "line_no", "message", "decoded")


@query(f"WITH {EV} SELECT host, container, count(*) AS lines, count(*) FILTER (WHERE NOT good) AS undecodable, CASE WHEN count(*) FILTER (WHERE NOT good) > 0 THEN 'error' ELSE 'state' END AS kind FROM ev GROUP BY ALL")
def read_quality(spark, sf):
    return L.read_quality(_decoded(spark, sf)).drop("wire_format")


_ENGINE = f"{EV}, en AS (SELECT host, round_id, line_no, peer, ts, date_trunc('second', ts) AS sec, CASE event_type WHEN 'error' THEN 'Found' WHEN 'view' THEN 'Found' WHEN 'signup' THEN 'Ban' ELSE 'Unban' END AS action, CASE event_type WHEN 'error' THEN 'fail2ban.filter' WHEN 'view' THEN 'fail2ban.observer' ELSE 'fail2ban.actions' END AS logger FROM ev WHERE event_type <> 'click')"


@query(f"WITH {_ENGINE} SELECT host, line_no, 'mail-jail' AS jail, action, logger, peer, strftime(sec, '%Y-%m-%d %H:%M:%S') AS event_time FROM en")
def ban_engine_events(spark, sf):
    return L.engine_events(I.engine_lines(spark, sf)).select("host", "line_no", "jail", "action", "logger", "peer", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@query(f"WITH {_ENGINE} SELECT host, line_no, action FROM en WHERE logger <> 'fail2ban.observer'")
def authoritative_events(spark, sf):
    return L.authoritative(L.engine_events(I.engine_lines(spark, sf))).select("host", "line_no", "action")


@query(f"WITH {EV} SELECT host, count(*) AS restarts FROM ev WHERE event_type = 'click' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY host")
def engine_restarts(spark, sf):
    return L.engine_restarts(I.engine_lines(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("host").agg(F.count("*").alias("restarts"))


@query(f"WITH {EV} SELECT host, line_no FROM ev WHERE (event_id % 97 <> 0) AND round_id = '2024-01-05'")
def day_slice(spark, sf):
    return L.day_slice(I.wire_lines(spark, sf), "2024-01-05").select("host", "line_no")


@query(f"WITH {EV} SELECT host, line_no FROM ev WHERE NOT good OR ts >= TIMESTAMP '2024-01-20 12:00:00'")
def lookback_lines(spark, sf):
    cutoff = L.since_text(F.lit("2024-01-21 12:00:00").cast("timestamp"), 1440)
    return L.lookback(_decoded(spark, sf), cutoff).select("host", "line_no")


_USER = "CASE WHEN user_id % 4 <> 0 THEN 'u' || CAST(user_id AS STRING) END AS username"


@query(f"WITH {EV} SELECT host, line_no, service, peer, 'LOGIN' AS mechanism, {_USER} FROM ev WHERE good AND event_type = 'error'")
def smtp_auth_failures(spark, sf):
    return L.smtp_auth_failures(_decoded(spark, sf)).select("host", "line_no", "service", "peer", "mechanism", "username")


@query(f"WITH {EV} SELECT host, line_no, service, peer, code FROM ev WHERE good AND event_type = 'signup'")
def relay_denied(spark, sf):
    return L.relay_denied(_decoded(spark, sf)).select("host", "line_no", "service", "peer", "code")


@query(f"WITH {EV} SELECT host, round_id, count(*) AS sent FROM ev WHERE good AND event_type = 'purchase' GROUP BY ALL")
def messages_sent(spark, sf):
    return L.messages_sent(_decoded(spark, sf)).groupBy("host", "round_id").agg(F.count("*").alias("sent"))


@query(f"WITH {EV} SELECT host, line_no, service, peer, {_USER}, CAST(user_id % 5 + 1 AS INTEGER) AS attempts FROM ev WHERE good AND event_type = 'view'")
def login_failures(spark, sf):
    return L.login_failures(_decoded(spark, sf)).select("host", "line_no", "service", "peer", "username", "attempts")


@query(f"WITH {EV} SELECT host, line_no, service, peer, {_USER} FROM ev WHERE good AND event_type = 'click'")
def logins_ok(spark, sf):
    return L.logins_ok(_decoded(spark, sf)).select("host", "line_no", "service", "peer", "username")


def _failures(spark, sf):
    return L.failures(_decoded(spark, sf))


_F = f"{EV}, f AS (SELECT * FROM ev WHERE good AND event_type IN ('error', 'view'))"


@query(f"WITH {_F} SELECT host, container, service, count(*) AS failures FROM f GROUP BY ALL")
def failures_by_service(spark, sf):
    return _failures(spark, sf).groupBy("host", "container", "service").agg(F.count("*").alias("failures"))


@query(f"WITH {_F}, grid AS (SELECT DISTINCT e.host, c.container, e.round_id FROM ev e, (SELECT DISTINCT container FROM ev) c) SELECT g.host, g.container, g.round_id, count(f.line_no) AS failures FROM grid g LEFT JOIN f ON f.host = g.host AND f.container = g.container AND f.round_id = g.round_id GROUP BY ALL")
def window_totals(spark, sf):
    by = ["host", "container", "round_id"]
    lines = _decoded(spark, sf)
    watched = F.explode(F.array(F.lit("mail"), F.lit("box"))).alias("container")
    grid = lines.select("host", "round_id").distinct().select("host", watched, "round_id")
    return C.totals(grid, _failures(spark, sf), by, "failures")


@query(f"WITH {_F}, c AS (SELECT host, container, peer, count(*) AS n, min(line_no) AS first_line FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host, container ORDER BY n DESC, first_line) AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def top_sources(spark, sf):
    return C.top(_failures(spark, sf), ["host", "container"], "peer")


@query(f"WITH {_F} SELECT host, container, count(DISTINCT peer) AS sources FROM f GROUP BY ALL")
def distinct_sources(spark, sf):
    return _failures(spark, sf).groupBy("host", "container").agg(F.count_distinct("peer").alias("sources"))


@query(f"WITH {_F} SELECT host, container, service, peer, count(*) AS n, CAST(grouping_id(host, container, service, peer) AS BIGINT) AS level FROM f GROUP BY GROUPING SETS ((host, container), (host, container, service), (host, container, peer))")
def failure_grouping_sets(spark, sf):
    sets = [["host", "container"], ["host", "container", "service"], ["host", "container", "peer"]]
    rows = _failures(spark, sf).groupingSets([[F.col(c) for c in s] for s in sets], "host", "container", "service", "peer")
    return rows.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"WITH {_F} SELECT host, container, round_id, round(count(*) / 24.0, 2) AS per_hour FROM f GROUP BY ALL")
def hourly_rates(spark, sf):
    return _failures(spark, sf).groupBy("host", "container", "round_id").agg(F.round(F.count("*") / F.lit(1440 / 60), 2).alias("per_hour"))


@query(f"WITH {EV}, c AS (SELECT host, code, count(*) AS n, min(line_no) AS l FROM ev WHERE good AND event_type = 'signup' GROUP BY ALL) SELECT host, string_agg(code || '×' || n, ', ' ORDER BY n DESC, l) AS codes FROM c GROUP BY host")
def relay_codes(spark, sf):
    c = L.relay_denied(_decoded(spark, sf)).groupBy("host", "code").agg(F.count("*").alias("n"), F.min("line_no").alias("l"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "l", F.concat("code", F.lit("×"), F.col("n").cast("string")).alias("t"))))
    return c.groupBy("host").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("codes"))


@query(f"WITH {_ENGINE} SELECT host, round_id, count(*) FILTER (WHERE action = 'Found') AS found, count(*) FILTER (WHERE action = 'Ban') AS banned FROM en WHERE logger <> 'fail2ban.observer' GROUP BY ALL")
def engine_counts(spark, sf):
    e = L.authoritative(L.engine_events(I.engine_lines(spark, sf)))
    return e.groupBy("host", "round_id").agg(F.count_if(F.col("action") == "Found").alias("found"), F.count_if(F.col("action") == "Ban").alias("banned"))


#: Two filters: the mail one knows a single listener and a single rejection code; a third has a problem of each kind.
FILTERS = [
    ("mail-jail", "postfix/smtpd\\[\\d+\\]: warning: [^[]*\\[<HOST>\\]: SASL \\w+ authentication failed\nRCPT from [^[]*\\[<HOST>\\]: 454 4\\.7\\.1 .*Relay access denied"),
    ("box-jail", "(?:pop3|imap)-login: .*auth failed, \\d+ attempts.*rip=<HOST>,"),
    ("odd-jail", "100%% of <HOST>\n<F_USER> from <HOST>\n(unclosed <HOST>"),
]


def _rules(spark, sf):
    # The filters belong to the jails that the lines name.
    jails = I.wire_lines(spark, sf).select("jail").distinct()
    table = spark.createDataFrame(FILTERS, "jail string, failregex string")
    return C.compile_filters(table.join(jails, "jail", "left_semi").unionByName(table.where("jail = 'odd-jail'")))


@query("SELECT jail, CAST(rule_no AS INTEGER) AS rule_no, ok FROM (VALUES ('mail-jail', 1, true), ('mail-jail', 2, true), ('box-jail', 1, true), ('odd-jail', 1, true), ('odd-jail', 2, false), ('odd-jail', 3, false)) t(jail, rule_no, ok) WHERE (SELECT count(*) FROM events) > 0")
def compile_filters(spark, sf):
    return _rules(spark, sf).select("jail", "rule_no", F.col("pattern").isNotNull().alias("ok"))


_M = f"{EV}, m AS (SELECT *, good AND CASE event_type WHEN 'error' THEN service = 'smtpd' WHEN 'signup' THEN code = '454 4.7.1' WHEN 'view' THEN true ELSE false END AS is_matched FROM ev)"


def _matched(spark, sf):
    filters = spark.createDataFrame(FILTERS, "jail string, failregex string")
    return C.match_filters(I.wire_lines(spark, sf), C.compile_filters(filters))


@query(f"WITH {_M} SELECT host, jail, round_id, count(*) AS matched FROM m WHERE is_matched GROUP BY ALL")
def filter_matched_lines(spark, sf):
    return _matched(spark, sf).where("is_matched").groupBy("host", "jail", "round_id").agg(F.count("*").alias("matched"))


def _observed(spark, sf):
    return L.failures(L.decode_wire(_matched(spark, sf)))


_O = f"{_M}, o AS (SELECT * FROM m WHERE good AND event_type IN ('error', 'view'))"


@query(f"WITH {_O} SELECT host, line_no, service FROM o WHERE NOT is_matched")
def uncounted_lines(spark, sf):
    return _observed(spark, sf).where("not is_matched").select("host", "line_no", "service")


@query(f"WITH {_O} SELECT host, jail, round_id, count(*) AS observed, count(*) FILTER (WHERE is_matched) AS would_match, count(*) FILTER (WHERE NOT is_matched) AS uncounted, round(count(*) FILTER (WHERE is_matched) / count(*), 4) AS coverage_ratio FROM o GROUP BY ALL")
def coverage(spark, sf):
    return C.coverage(_observed(spark, sf), ["host", "jail", "round_id"])


@query(f"WITH {_O} SELECT host, jail, service, count(*) AS observed, count(*) FILTER (WHERE is_matched) AS would_match, count(*) FILTER (WHERE NOT is_matched) AS uncounted, round(count(*) FILTER (WHERE is_matched) / count(*), 4) AS coverage_ratio FROM o GROUP BY ALL")
def coverage_by_service(spark, sf):
    return C.coverage(_observed(spark, sf), ["host", "jail", "service"])


@query(f"WITH {_O}, s AS (SELECT host, jail, service, min(line_no) AS line_no FROM o WHERE NOT is_matched GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY host, jail ORDER BY line_no, service) AS pos FROM s) SELECT * FROM r WHERE pos <= 3")
def evidence_samples(spark, sf):
    return C.evidence(_observed(spark, sf).where("not is_matched"), ["host", "jail"]).select("host", "jail", "service", "line_no", "pos")


def _counts(spark, sf):
    by = ["host", "jail", "round_id"]
    # Failures and matched lines are counted in one pass: a line may be either, both or none.
    lines = L.decode_wire(_matched(spark, sf))
    failed = F.coalesce(F.col("message").rlike(X.SMTP_AUTH) | F.col("message").rlike(X.BOX_FAILED), F.lit(False))
    both = lines.groupBy(*by).agg(F.count_if(failed).alias("observed"), F.count_if("is_matched").alias("matched"))
    observed, matched = (both.select(*by, c).where(F.col(c) > 0) for c in ("observed", "matched"))
    found = L.authoritative(L.engine_events(I.engine_lines(spark, sf))).where("action = 'Found'").groupBy(*by).agg(F.count("*").alias("found"), F.lit(True).alias("readable"))
    tool = matched.where("round_id = '2024-01-03'").select(*by, F.col("matched").alias("tool_matched"))
    return C.reconcile(observed, matched, found, tool, by)


_R = f"{_O}, a AS (SELECT host, jail, round_id, count(*) AS observed FROM o GROUP BY ALL), b AS (SELECT host, jail, round_id, count(*) AS matched FROM m WHERE is_matched GROUP BY ALL), c AS (SELECT host, 'mail-jail' AS jail, round_id, count(*) AS found FROM ev WHERE event_type = 'error' GROUP BY ALL), k AS (SELECT host, jail, round_id FROM a UNION SELECT host, jail, round_id FROM b UNION SELECT host, jail, round_id FROM c), rec AS (SELECT k.*, coalesce(observed, 0) AS observed, coalesce(matched, 0) AS matched, coalesce(found, 0) AS found, CASE WHEN k.round_id = '2024-01-03' THEN matched END AS tool_matched, coalesce(matched, 0) - coalesce(found, 0) AS drift FROM k LEFT JOIN a USING (host, jail, round_id) LEFT JOIN b USING (host, jail, round_id) LEFT JOIN c USING (host, jail, round_id))"


@query(f"WITH {_R} SELECT * FROM rec")
def reconcile_counts(spark, sf):
    return _counts(spark, sf)


@query(f"WITH {_R} SELECT host, jail, round_id, drift FROM rec WHERE abs(drift) >= 5")
def engine_drift(spark, sf):
    return _counts(spark, sf).where(F.abs("drift") >= 5).select("host", "jail", "round_id", "drift")


_BLIND = f"""{_O}, es AS (SELECT host, round_id, jail, service, count(*) AS n, count(*) FILTER (WHERE NOT is_matched) AS missed, min(line_no) FILTER (WHERE NOT is_matched) AS line FROM o GROUP BY ALL),
 ej AS (SELECT host, round_id, jail, sum(n) AS n, sum(missed) AS missed, string_agg(service, ', ' ORDER BY service) FILTER (WHERE missed > 0) AS services, string_agg(service || ': ' || missed, ', ' ORDER BY service) FILTER (WHERE missed > 0) AS counts, string_agg(CAST(line AS STRING), ' ' ORDER BY service) FILTER (WHERE missed > 0) AS lines FROM es GROUP BY ALL)
 SELECT host, round_id, 'fail2ban.uncounted_failures' AS rule, 3 AS severity, CAST(missed AS BIGINT) || ' failures would not be counted on ' || services AS title, 'uncounted{{jail=' || jail || '}}' AS key,
  jail || ': ' || CAST(missed AS BIGINT) || ' of ' || CAST(n AS BIGINT) || ' failures match no filter; coverage ' || CAST(floor(round((n - missed) / n, 4) * 100) AS BIGINT) || ' percent; by service: ' || counts || '; matched lines ' || CAST(n - missed AS BIGINT) || ', filter tool ?, engine ?' AS detail, lines
 FROM ej WHERE missed > 0"""


@query(f"WITH {_BLIND}")
def uncounted_failures(spark, sf):
    from logaudit.operators import rules

    signals = tables.cut(C.coverage_signals(_observed(spark, sf)), "coverage")
    found = rules.uncounted_failures(signals, quoted=rules.siblings(signals))
    lines = F.array_join(F.transform("evidence", lambda e: e["line_no"].cast("string")), " ")
    return found.select("host", "round_id", "rule", "severity", "title", "key", "detail", lines.alias("lines"))


@query(f"WITH {EV} SELECT host, container, CASE WHEN container = 'box' THEN 'error' ELSE 'state' END AS kind FROM ev GROUP BY ALL")
def crosscheck_gate(spark, sf):
    rows = _decoded(spark, sf).withColumn("wire_format", F.col("container") == "mail")
    return C.gate(L.read_quality(rows)).select("host", "container", "kind")


_RC = f"""WITH {_ENGINE}, own AS (SELECT * FROM en WHERE logger <> 'fail2ban.observer' AND sec >= TIMESTAMP '2024-01-02' AND sec < TIMESTAMP '2024-01-20'),
 last AS (SELECT host, peer, arg_max(action, struct_pack(a := sec, l := line_no)) AS last FROM own WHERE action IN ('Ban', 'Unban') GROUP BY ALL),
 b AS (SELECT host, peer FROM last WHERE last <> 'Unban')
 SELECT t.host, 'mail-jail' AS jail, count(*) FILTER (WHERE action = 'Found') AS total_failed, count(*) FILTER (WHERE action = 'Ban') AS total_banned,
  (SELECT count(*) FROM b WHERE b.host = t.host) AS currently_banned,
  count(*) FILTER (WHERE action = 'Found' AND sec >= TIMESTAMP '2024-01-19' AND (t.host, t.peer) NOT IN (SELECT (host, peer) FROM b)) AS currently_failed
 FROM own t GROUP BY t.host"""


@query(_RC.replace("(t.host, t.peer) NOT IN (SELECT (host, peer) FROM b)", "t.host || '/' || t.peer NOT IN (SELECT host || '/' || peer FROM b)"))
def replay_counters(spark, sf):
    e = L.authoritative(L.engine_events(I.engine_lines(spark, sf)))
    return C.replay_counters(e, F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))


@query(f"WITH {EV} SELECT host, strftime(time_bucket(INTERVAL 5 MINUTES, ts) - k * INTERVAL 5 MINUTES, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM ev, range(0, 12) r(k) GROUP BY ALL")
def sliding_counts(spark, sf):
    e = I.events(spark, sf).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("host", F.window("t", "60 minutes", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select("host", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(f"WITH {EV} SELECT host, round_id, event_type, count(*) AS n FROM ev GROUP BY ALL")
def tumbling_counts(spark, sf):
    e = I.events(spark, sf).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("host", F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("host", F.date_format("w.start", "yyyy-MM-dd").alias("round_id"), "event_type", "n")
