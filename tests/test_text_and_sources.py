import hashlib
import hmac

from pyspark.sql import functions as F

from logaudit.functions import text as X
from logaudit.operators import crosscheck as C
from logaudit.sources import logs as L
from logaudit.sources import snapshots as N


def lines(spark, *raw):
    return spark.createDataFrame([("h", "mail", "f", i, r) for i, r in enumerate(raw, 1)], "host string, container string, file string, line_no long, raw string")


def wire(text):
    return '{"log":"' + text + '\\n","stream":"stdout","time":"2026-07-31T06:00:00.000000001Z"}'


def test_wire_lines_keep_raw_and_count_what_cannot_be_read(spark):
    rows = L.decode_wire(lines(spark, wire("a \\u003cb\\u003e"), "", "oops", '{"log":5,"time":"x"}', '{"time":"x"}')).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 3, 4, 5]
    assert [r.decoded for r in rows] == [True, False, False, False]
    assert rows[0].message == "a <b>" and "\\u003c" in rows[0].raw and rows[0].ts is not None
    quality = L.read_quality(L.decode_wire(lines(spark, wire("a"), "oops"))).first()
    assert (quality.lines, quality.undecodable, quality.kind) == (2, 1, "error")


def test_smtp_and_mailbox_grammar(spark):
    d = L.decode_wire(lines(
        spark,
        wire("mx postfix/submission/smtpd[1]: warning: a.b[203.0.113.9]:25: SASL LOGIN authentication failed: x, sasl_username=joe, y"),
        wire("mx postfix/smtpd[1]: NOQUEUE: reject: RCPT from x[203.0.113.8]: 554 5.7.1 <q>: Relay access denied; z"),
        wire("pop3-login: Info: Disconnected (auth failed, 3 attempts in 12 secs): user=\\u003c\\u003e, method=PLAIN, rip=203.0.113.7, x"),
        wire("imap-login: Info: Disconnected: x (no auth attempts in 2 secs): user=\\u003c\\u003e, rip=203.0.113.7"),
        wire("imap-login: Info: Login: user=\\u003cjoe\\u003e, method=PLAIN, rip=203.0.113.6, x"),
    ))
    a = L.smtp_auth_failures(d).first()
    assert (a.service, a.peer, a.mechanism, a.username) == ("submission/smtpd", "203.0.113.9", "LOGIN", "joe")
    assert [tuple(r)[-3:] for r in L.relay_denied(d).collect()] == [("smtpd", "203.0.113.8", "554 5.7.1")]
    b = L.login_failures(d).collect()
    assert [(r.service, r.attempts, r.peer, r.username) for r in b] == [("pop3", 3, "203.0.113.7", None)]
    assert [r.username for r in L.logins_ok(d).collect()] == ["joe"]


def test_engine_lines_choose_event_time_and_logger(spark):
    d = lines(
        spark,
        "2026-07-31 06:00:56,616 fail2ban.filter [1]: INFO [j] Found 203.0.113.4 - 2026-07-31 05:59:00",
        "2026-07-31 06:00:56,616 fail2ban.observer [1]: INFO [j] Found 203.0.113.4, bad - 2026-07-31 05:59:00, 3 # -> 5.0, Ban",
        "2026-07-31 06:00:57,616 fail2ban.actions [1]: NOTICE [j] Ban 203.0.113.4",
        "2026-07-31 06:00:58,616 fail2ban.filter [1]: INFO [j] Found 203.0.113.4 - 2026-99-31 05:59:00",
    )
    rows = L.authoritative(L.engine_events(d)).orderBy("line_no").collect()
    assert [(r.action, str(r.event_time)) for r in rows] == [("Found", "2026-07-31 05:59:00"), ("Ban", "2026-07-31 06:00:57")]


def test_filters_are_matched_on_raw_lines_and_problems_named(spark):
    rules = C.compile_filters(spark.createDataFrame([("j", "x from <HOST>$\n<F_USER> x\n(open")], "jail string, failregex string"))
    assert [(r.rule_no, r.pattern is not None) for r in rules.orderBy("rule_no").collect()] == [(1, True), (2, False), (3, False)]
    d = lines(spark, "x from 203.0.113.1", "y", None).withColumn("jail", F.lit("j"))
    assert [r.is_matched for r in C.match_filters(d, rules).orderBy("line_no").collect()] == [True, False, False]


def test_snapshots(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    df = spark.createDataFrame([("Filesystem 1 2 3 4 5\n/dev/a 10 5 5 50% /my data\ntmpfs 1 1 1 1% /x\n/dev/b 1 1 - - /y",)], "text string")
    assert [tuple(r)[1:] for r in N.disk_rows(df).collect()] == [(10, 5, 5, 50, "/my data")]
    assert one(N.queue_depth(F.lit("Mail queue is empty"))) == 0 and one(N.queue_depth(F.lit("A\n\nB"))) == 2
    assert one(N.queue_depth(F.lit("h\n-- 3 Kbytes in 7 Requests."))) == 7
    assert one(N.settings(F.lit("a = 1\nb=2=3\na = 4"))) == {"a": "4", "b": "2=3"}
    assert one(N.tool_matches(F.lit("Lines: 1657 lines, 0 ignored, 6 matched, 1651 missed"))) == 6
    bodies = spark.createDataFrame([('{"alerts":[{"status":"firing"}]}',), ('{"alerts":"x"}',), ("{",), (None,)], "body string")
    assert [r.accepted for r in N.ingest_gate(bodies, 100).collect()] == [True, False, False, False]
    state = spark.createDataFrame([('{"Running":true,"Health":{"Status":"healthy"}}', "2"), (None, "x"), ("{", "1")], "text string, restarts string")
    assert [(r.kind, r.running, r.restart_count) for r in N.container_state(state).collect()] == [("state", True, 2), ("state", False, None), ("error", None, 1)]


def test_payloads_that_are_no_variants_are_read(spark):
    bodies = ['{"a":1,"a":2,"alerts":[]}', '{"a":1,"a":2}', '{"a":1,"a":2,"alerts":"[x"}', '{"a":1,"a":2,"alerts":null}', "{'a':1,'a':2}", '{"a":1,"a":2', None]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1)
    assert [r.reason for r in N.ingest_gate(rows, None).collect()] == [None, None, "wrong shape", "wrong shape", *["not JSON"] * 3]
    assert [r.reason for r in N.ingest_gate(rows, 12).collect()] == ["too large", "too large", "too large", "too large", "too large", "not JSON", "not JSON"]


def test_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.numbers(F.lit("-5 is 1,234 or 2.50 and ３"))) == [5.0, 1.0, 234.0, 2.5, 3.0]
    want = hmac.new(b"s", b"ip\x00203.0.113.1", hashlib.sha256).hexdigest()[:6]
    assert one(X.pseudonym(b"s", "ip", F.lit("203.0.113.1"))) == want
    assert one(X.cut(F.lit("abcdef  ghij"), 10)) == "abcdef..." and one(X.cut(F.lit("abc"), 10)) == "abc"
    assert one(X.series_key(F.lit("n"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "n{a=1,b=2}"
    assert [one(X.address_class(F.lit(a))) for a in ("127.0.0.1", "10.1.1.1", "203.0.113.5", "8.8.8.8", "1.2.3.999")] == ["loopback", "private", "documentation", "global", None]
