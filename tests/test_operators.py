import datetime as dt

import pytest
from pyspark.sql import functions as F

from logaudit.operators import claims as V
from logaudit.operators import history as H
from logaudit.operators import leaks, notify, redact, suppression
from logaudit.operators import rules as R

T0 = dt.datetime(2026, 8, 1)


def signals(spark, *rows):
    """(round, hours, name, value, text, labels)"""
    data = [("h", f"r{r}", T0 + dt.timedelta(hours=h), n, "state" if t is not None else "metric", v, t, lab, n + str(sorted(lab.items()))) for r, h, n, v, t, lab in rows]
    return spark.createDataFrame(data, "host string, round_id string, observed_at timestamp, name string, kind string, value_num double, value_text string, labels map<string,string>, key string").withColumn("as_of", F.col("observed_at"))


def test_previous_is_strictly_earlier(spark):
    s = signals(spark, (1, 0, "a", 1.0, None, {}), (2, 1, "a", 5.0, None, {}), (3, 1, "a", 6.0, None, {}))
    rows = H.with_previous(s).orderBy("round_id").collect()
    assert [r.prev.value_num if r.prev else None for r in rows] == [None, 1.0, 1.0]


@pytest.mark.parametrize("was, now, found", [(1, 5, 0), (400, 430, 0), (6, 170, 1), (0, 30, 1)])
def test_spike_needs_factor_and_difference(spark, was, now, found):
    s = H.with_previous(signals(spark, (1, 0, "failures_total", float(was), None, {}), (2, 1, "failures_total", float(now), None, {})))
    assert R.rate_spike(s).count() == found


def test_rules(spark):
    s = signals(
        spark, (1, 0, "messages_sent", 1.0, None, {}), (2, 1, "messages_sent", 500.0, None, {}), (1, 0, "total_failed", 931.0, None, {}),
        (2, 1, "total_failed", 12.0, None, {}), (1, 0, "running", None, "true", {}), (2, 1, "running", None, "false", {}),
        (2, 1, "engine_drift", 1.0, None, {}), (1, 0, "gone", 1.0, None, {}), (1, 0, "x", 1.0, None, {"source": "a"}),
        (1, 0, "disk_available_bytes", 100.0, None, {}), (2, 1, "disk_available_bytes", 50.0, None, {}),
    )
    s = s.withColumn("key", F.when(F.size("labels") > 0, F.concat("name", F.lit("{source=a}"))).otherwise(F.col("name")))
    rounds = s.select("host", "round_id", "as_of").distinct()
    found = {(r.round_id, r.rule, r.severity, r.key) for r in R.all_findings(s, rounds).collect()}
    assert found == {
        ("r2", "change.rate_spike", 3, "messages_sent"), ("r2", "change.counter_reset", 1, "total_failed"), ("r2", "change.state_changed", 1, "running"),
        ("r2", "disk.filling", 3, "disk_available_bytes"), ("r2", "change.went_silent", 2, "gone"),
    }


def test_silent_series_can_all_be_named(spark):
    keys = [f"k{i:02}" for i in range(25)]
    silent = spark.createDataFrame([("h", "r", k) for k in reversed(keys)], "host string, round_id string, key string")
    (every,), (first,) = R.went_silent(silent, None).collect(), R.went_silent(silent).collect()
    assert every.title == first.title == "25 series went silent"
    assert every.signal_keys == keys and every.key == " ".join(keys) and every.detail == "they are " + ", ".join(keys)
    assert first.signal_keys == keys[:20] and first.key == " ".join(keys[:20]) and first.detail == "the first are " + ", ".join(keys[:20])


def test_suppression_follows_what_was_sent(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    b = spark.createDataFrame([("s", "d", 3, at(m)) for m in (0, 400, 719, 720, 1000, 1440)] + [("s", "e", 1, at(0)), ("s", "f", None, at(0))], "sink string, digest string, severity int, as_of timestamp")
    rows = suppression.should_send(b).orderBy("digest", "as_of").collect()
    assert [r.send for r in rows] == [True, False, False, True, False, True, False, False]


def test_fit(spark):
    def fit(blocks, limit):
        return spark.createDataFrame([(blocks,)], "b array<string>").select(notify.fit(F.col("b"), limit).alias("x")).first().x

    assert fit(["aa", "bb"], 6) == "aa\n\nbb"
    assert fit(["aa", "b" * 50], 40) == "aa\n\n_truncated_"
    assert fit(["aa", "b" * 50], 5) == "aa"
    assert fit(["one\n" + "x" * 30, "b"], 10) == "one"
    assert fit(["y" * 30], 10) == "yyyyyyy..."


SALTED = redact.Policy(b"salt")
RAW = "from 203.0.113.9 and 10.0.0.8, joe@corp.example.de at host-1-2-3-4.isp.net, fe80::1 see https://graph.corp.io:9090/x?y in /srv/mail/joe or /var/log/mail.log"


def test_redaction_leaves_nothing_and_is_stable(spark):
    df = spark.createDataFrame([(RAW,), (None,), ("nothing here",)], "t string")
    once = df.select(redact.redact_text(F.col("t"), SALTED).alias("t"))
    rows = [r.t for r in once.collect()]
    assert rows[1] is None and rows[2] == "nothing here" and "/var/log/mail.log" in rows[0] and "ip:private-" in rows[0]
    assert [r.t for r in once.select(redact.redact_text(F.col("t"), SALTED).alias("t")).collect()] == rows
    assert all(not r.x for r in once.where("t is not null").select(leaks.find_leaks(F.col("t")).alias("x")).collect())
    assert len(df.limit(1).select(leaks.find_leaks(F.col("t")).alias("x")).first().x) >= 5


def test_gate_stops_a_leak(spark):
    good = spark.createDataFrame([("fine",)], "t string")
    assert leaks.gate(good, "x").count() == 1
    with pytest.raises(Exception, match="leak in x"):
        leaks.gate(spark.createDataFrame([("203.0.113.9",)], "t string"), "x").collect()


def test_placeholders_are_unique_beyond_the_small_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("seen"), F.concat(F.lit("8.8."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("address"))
    early = redact.placeholder_mapping(df.where("seen < 10"))
    rows = redact.placeholder_mapping(df, early).collect()
    assert len(rows) == 1000 == len({r.replacement for r in rows})
    assert {r.original: r.replacement for r in rows}["8.8.0.0"] == "192.0.2.1"


def test_claims(spark):
    text = '```json\n{"headline":"9 failures","headline_refs":["a"],"claims":[{"text":"9 failures","kind":"observation","refs":["a"]},{"text":"8 failures","refs":["a"]},{"text":"77 failures","refs":["a"]},{"text":"port 77","kind":"next_step","refs":["a"]},{"text":"why","kind":"explanation","refs":["a"]},{"text":"x","refs":["zz"]},{"text":"x","refs":[" "]},{"text":" ","refs":["a"]}]}\n```'
    c = spark.createDataFrame([("r", text)], "round_id string, text string").withColumn("completion", V.parse_completion(F.col("text")))
    known = spark.createDataFrame([("r", "a", "9 seen")], "round_id string, ref string, material string")
    numbers = spark.createDataFrame([("r", 8.0), ("r", 9.0)], "round_id string, number double")
    rows = V.verify(V.claim_rows(c), known, numbers).orderBy("pos").collect()
    assert [r.accepted for r in rows] == [True, True, False, True, True, False, False, False]
    assert [r.confidence for r in rows[:5]] == ["derived", "hypothesis", None, "hypothesis", "hypothesis"]
    assert "77" in rows[2].reason and "zz" in rows[5].reason


def test_redaction_reaches_all_fields(spark):
    kind = "name string, labels map<string,string>, evidence array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>"
    ip = "8.8.4.4"
    base = ("n", {"a": ip}, [("log", f"r {ip}", f"x {ip}", 1)])
    s = redact.redact_signals(spark.createDataFrame([(*base, f"v {ip}", f"n {ip}"), ("n", {}, None, None, None)], f"{kind}, value_text string, note string"), SALTED).collect()
    f = redact.redact_findings(spark.createDataFrame([(*base, f"t {ip}", f"d {ip}", f"b {ip}", [f"c {ip}"])], f"{kind}, title string, detail string, baseline string, correlations array<string>"), SALTED).collect()
    assert ip not in str(s + f) and str(s[0]).count("ip:") == 6 and str(f).count("ip:") == 7
    assert s[1].evidence is None and s[1].note is None


def test_redaction_rules(spark):
    cid = "0123456789ABCDEF" * 4
    cases = {
        "mail.shop.icu a.b.coop x.work y.center": ("host:", 4), "jail.local fail2ban.log 10-logging.conf foo.bar.baz.zz www.example.com": None,
        "::ffff:8.8.8.8 [2607:f8b0::1]": ("ip:", 2), "fe80::1%eth0 or fd00::7": ("ip:private-", 2), "at ::1, 127.0.0.1": ("ip:loopback", 2),
        "12:30:45 and a::b::c 1:2:3": None, f"id {cid} and {cid.lower()}": ("cid:", 2), r"\u003cjoe@corp.de\u003e \u003Cjoe@corp.de\u003E": ("mbox:", 2),
        "http://host.corp.io:9090/x https://docs.example.org/y": ("host:", 1), "1-2-3-4.isp.net 9-9-9-9": None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", redact.redact_text(F.col("t"), SALTED).alias("r")).collect()
    for r in rows:
        want = cases[r.t]
        assert want is None or r.r.count(want[0]) == want[1], (r.t, r.r)
    got = {r.t: r.r for r in rows}
    assert all(got[t] == t for t in list(cases)[1:2]) and "12:30:45 and a::b::c 1:2:3" in got.values()
    assert len({m for m in got[f"id {cid} and {cid.lower()}"].split() if m.startswith("cid:")}) == 1
    assert got["http://host.corp.io:9090/x https://docs.example.org/y"].endswith(" https://docs.example.org/y") and ":9090/<path>" in got["http://host.corp.io:9090/x https://docs.example.org/y"]
    with pytest.raises((TypeError, ValueError)):
        redact.Policy(b"")
    own = redact.Policy(b"s", ("corp.de",), ("root",), ("mx1.corp.de",))
    one = spark.createDataFrame([("joe@corp.de root@x.org MX1 mx1.corp.de corp.de",)], "t string").select(redact.redact_text(F.col("t"), own).alias("r")).first().r
    assert one == "mbox:own mbox:own host:self host:self domain:own"


def test_addresses_have_the_classes_of_the_standard_library(spark):
    import ipaddress

    shown = ["::1", "::", "fe80::1", "2607:f8b0::1", "2001:db8::9", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fc00::", "2002::1", "100::5", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "2001:1ff::1", "64:ff9b:1::1", "2a00:1450:4001:81b::200e"]
    bad = ["1:2:3", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", "::1.2.3", "::300.1.1.1", "1:2:3:4:5:6:7:8::", ":1:2:3:4:5:6:7:8"]
    rows = spark.createDataFrame([(a,) for a in shown + bad], "a string").select("a", redact.ipv6_class(F.col("a")).alias("c")).collect()
    got = {r.a: r.c for r in rows}
    assert not [a for a in bad if got[a] is not None]
    for a in shown:
        ip = ipaddress.ip_address(a)
        want = "loopback" if ip.is_loopback else "documentation" if a.startswith("2001:db8") else "global" if ip.is_global else "private"
        assert got[a] == want, (a, got[a], want)


def test_labels_that_become_one_keep_the_greater_value(spark):
    kind = "name string, labels map<string,string>, evidence array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>"
    rows = spark.createDataFrame([("n", {"8.8.4.4": "a", "ok": "x", "/srv/x": "8.8.4.4"}, None)], kind)
    out = redact.redact_signals(rows, SALTED).first()
    assert "8.8.4.4" not in str(out) and "/srv/x" not in str(out) and out.labels["ok"] == "x"


def test_placeholders_never_run_into_real_addresses_and_fill_texts(spark):
    n = spark.range(140_000)
    df = n.select(F.col("id").alias("seen"), F.concat(F.lit("8."), (F.col("id") / 65536).cast("int"), F.lit("."), (F.col("id") / 256).cast("int") % 256, F.lit("."), F.col("id") % 256).alias("address"))
    rows = redact.placeholder_mapping(df).collect()
    assert len({r.replacement for r in rows}) == 140_000
    assert all(r.replacement.startswith(("192.0.2.", "198.51.100.", "203.0.113.", "198.18.", "198.19.", "2001:db8::")) for r in rows)
    early = spark.createDataFrame([("9.9.9.9", "192.0.2.5")], "original string, replacement string")
    more = spark.createDataFrame([(1, "8.8.8.8"), (2, "2607:f8b0::1")], "seen long, address string")
    mapping = redact.placeholder_mapping(more, early)
    assert {r.original: r.replacement for r in mapping.collect()} == {"9.9.9.9": "192.0.2.5", "8.8.8.8": "192.0.2.6", "2607:f8b0::1": "192.0.2.7"}
    texts = spark.createDataFrame([("from 8.8.8.8 and 9.9.9.9 to 2607:f8b0::1, 10.0.0.1",), ("none",), (None,)], "text string")
    assert {r.text for r in redact.with_placeholders(texts, mapping).collect()} == {"from 192.0.2.6 and 192.0.2.5 to 192.0.2.7, 10.0.0.1", "none", None}


def test_rules_quote_their_siblings(spark):
    line = ("log", "mail", "x", 7)
    rows = [
        ("uncounted", {"jail": "j"}, 5.0, [line]), ("observed", {"jail": "j"}, 8.0, None), ("coverage_ratio", {"jail": "j"}, 0.375, None), ("found", {"jail": "other"}, 99.0, None),
        ("uncounted_by_service", {"jail": "j", "service": "b/c"}, 3.0, [line, ("log", "mail", "y", 9)]), ("uncounted_by_service", {"jail": "j", "service": "a"}, 2.0, None),
        ("uncounted_by_service", {"jail": "j", "service": "none"}, 0.0, None), ("uncounted_by_service", {"jail": "jj", "service": "z"}, 4.0, None), ("uncounted", {"jail": "alone"}, 1.0, None),
    ]
    data = [("h", "r", n, lab, v, e, n + "{" + ",".join(f"{k}={x}" for k, x in sorted(lab.items())) + "}") for n, lab, v, e in rows]
    s = spark.createDataFrame(data, "host string, round_id string, name string, labels map<string,string>, value_num double, evidence array<struct<kind:string,ref:string,excerpt:string,line_no:bigint>>, key string")
    found = {r.labels["jail"]: r for r in R.uncounted_failures(s, quoted=R.siblings(s)).collect()}
    r = found["j"]
    assert r.title == "5 failures would not be counted on a, b/c"
    assert r.detail == "j: 5 of 8 failures match no filter; coverage 37 percent; by service: a: 2, b/c: 3; matched lines ?, filter tool ?, engine ?"
    assert [e.line_no for e in r.evidence] == [7, 9] and r.signal_keys == ["uncounted{jail=j}", "uncounted_by_service{jail=j,service=a}", "uncounted_by_service{jail=j,service=b/c}"]
    assert found["alone"].title == "1 failures would not be counted" and found["alone"].evidence == []


@pytest.mark.parametrize("hours, stale", [(72, False), (73, True)])
def test_old_baselines_and_restarts_are_told(spark, hours, stale):
    s = signals(spark, (1, 0, "failures_total", 1.0, None, {}), (2, hours, "failures_total", 50.0, None, {}), (1, 0, "total_failed", 9.0, None, {}), (2, hours, "total_failed", 2.0, None, {}))
    s = s.unionByName(signals(spark, (2, hours, "engine_restarts", 3.0, None, {})).withColumn("key", F.lit("engine_restarts")))
    known, quoted = H.with_previous(s), R.siblings(s)
    spike, reset = R.rate_spike(known, quoted=quoted).first(), R.counter_reset(known, quoted=quoted).first()
    assert spike.detail.endswith("grew by 49, over 50 times") and ("more than 3 windows" in spike.baseline) is stale
    assert reset.detail == "9 to 2: it started anew; the engine started 3 times in the window"
    import json

    told = json.loads(R.as_json(R.rate_spike(known, quoted=quoted)).first().json)
    assert told["severity"] == "warning" and told["labels"] == {} and "evidence" not in told and told["baseline"] == spike.baseline


def test_findings_of_signals_without_siblings_or_rows(spark):
    s = signals(spark, (1, 0, "uncounted", 2.0, None, {"jail": "j"}))
    assert R.uncounted_failures(s).first().title == "2 failures would not be counted"
    assert R.uncounted_failures(s, quoted=R.siblings(s)).first().detail.startswith("j: 2 of ? failures")
    assert R.siblings(s.where("false")).count() == 0


def test_messages_hold_the_limits_of_each_section(spark):
    kind = "host string, round_id string, pos int, severity int, title string, correlations array<string>, baseline string"
    found = spark.createDataFrame([("h", "r", i, 3 - i % 3, f"finding {i} " + "x" * (i * 7 % 60), ["a change", f"change {i}"], "before" if i % 2 else None) for i in range(1, 30)] + [("h", "few", 1, 3, "only", None, None)], kind)
    heads = spark.createDataFrame([("h", "r", "t" * 300), ("h", "few", "one"), ("h", "none", "nothing to report")], "host string, round_id string, headline string")
    claims = spark.createDataFrame([("h", "r", i, f"claim {i} " + "y" * 50, i != 2, "hypothesis" if i == 1 else "derived") for i in range(12)] + [("h", "few", 0, "so", True, "derived")], "host string, round_id string, pos int, text string, accepted boolean, confidence string")
    models = spark.createDataFrame([("h", "few", "m1", False)], "host string, round_id string, model string, replaced boolean")
    import json

    def sent(most, reserve=None):
        return {r.round_id: json.loads(r.payload) for r in notify.payloads(found, heads, most, claims=claims, models=models, reserve=reserve).collect()}

    for most in (5, 60, 300, 2000, 9000):
        for reserve in (None, (120, 40), (20, 10)):
            for m in sent(most, reserve).values():
                assert len(m["title"]) <= 256 and (reserve is not None and most < 200 or len(m["body"]) <= min(most, 4096))
    plain = sent(600)["r"]["body"]
    assert plain.startswith("INFO finding 1" if found.first().severity == 1 else "WARNING finding 1") and plain.endswith(notify.TRUNCATED) and plain.count("a change") == 1
    kept = sent(600, (150, 120))["r"]["body"]
    head, triage, trailer = kept.split(notify.TRUNCATED)[0], kept.split("\n\n")[-2], kept.split("\n\n")[-1]
    assert "finding 1" in head and triage.startswith("Triage") and len(triage) <= 150 and trailer == "1 claim dropped for lack of evidence\nWritten from the rules: no model could be asked"
    few, none = sent(4096)["few"], sent(4096)["none"]
    assert few["body"] == "CRITICAL only\n\nTriage, as the model reads the findings above\n- so" and few["footer"] == "1 finding, m1"
    assert none["body"] == "Written from the rules: no model could be asked" and none["footer"] == "0 findings, headline from rules"
