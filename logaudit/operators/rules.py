"""Detection rules: signals of all rounds in, findings out.

Each rule reads signals that carry ``prev``, their last strictly earlier observation, and gives findings of one shape:
``host, round_id, rule, severity, confidence, title, key, labels, detail, evidence, signal_keys, baseline``. Thresholds are
arguments. ``all_findings`` runs them all in one table. A rule may quote other signals of its round: ``siblings`` gathers
those once for each round, and only findings, not signals, are joined with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.operators import history
from logaudit.schemas import EVIDENCE


@dataclass(frozen=True)
class Thresholds:
    """Everything that a rule can be told."""

    drift: float = 5
    disk: tuple[float, float] = (90, 95)
    fill_hours: tuple[float, float] = (72, 12)
    fill_least_hours: float = 0.25
    cert_days: tuple[float, float] = (21, 7)
    spike_delta: float = 10
    spike_factor: float = 4
    spiking: tuple[str, ...] = ("failures_total", "messages_sent", "queue_depth", "relay_denied", "login_failures", "found", "banned", "uncounted", "errors", "logins")
    urgent: tuple[str, ...] = ("messages_sent", "queue_depth")
    counters: tuple[str, ...] = ("total_failed", "total_banned", "restart_count")
    watched_states: tuple[str, ...] = ("running", "health", "oom_killed", "config_digest", "filter_as_expected", "logging_healthy", "log_path", "started_at")
    silence_hours: int = 24
    silent_shown: int = 20
    window_minutes: int = 1440
    stale_windows: float = 3


@dataclass(frozen=True)
class Spec:
    """When a signal makes a finding, and what it says. All but ``when`` may read siblings."""

    when: Column
    rule: Column | str
    severity: Column | int
    confidence: str
    title: Column
    detail: Column | None = None
    baseline: Column | None = None
    more: Column | None = None  # siblings that the finding rests on too, as entries of their map
    keys: Column | None = None  # the series that it is about, if not the row's own

    def struct(self) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        own = F.coalesce("evidence", F.array().cast(EVIDENCE))
        evidence, keys = own, F.array("key") if self.keys is None else self.keys
        if self.more is not None:
            evidence = F.concat(own, F.flatten(F.transform(self.more, lambda e: F.coalesce(e["value"]["evidence"], F.array().cast(EVIDENCE)))))
            keys = F.concat(keys, F.transform(self.more, lambda e: e["key"]))
        return F.struct(
            as_column(self.rule).alias("rule"), as_column(self.severity).cast("int").alias("severity"), F.lit(self.confidence).alias("confidence"),
            self.title.alias("title"), as_column(self.detail).cast("string").alias("detail"), F.array_distinct(evidence).alias("evidence"),
            keys.alias("signal_keys"), as_column(self.baseline).cast("string").alias("baseline"),
        )


#: Signals that rules quote beside their own.
SIBLINGS = ("observed", "matched", "coverage_ratio", "tool_matched", "found", "uncounted_by_service", "engine_restarts", "filter_declared")
_SIBLING = f"struct<number:double,text:string,evidence:{EVIDENCE}>"


def siblings(signals: DataFrame, names: tuple[str, ...] = SIBLINGS) -> DataFrame:
    """``host, round_id, sib``: the quoted signals of each round by their keys, in one aggregation. A map has an entry for
    each jail and service of its host at most; of a key that comes twice the greater value counts."""
    rows = _complete(signals).where(F.col("name").isin(*names))
    one = F.max(F.struct(F.col("value_num").alias("number"), F.col("value_text").alias("text"), "evidence")).alias("value")
    each = rows.groupBy("host", "round_id", "key").agg(one)
    return each.groupBy("host", "round_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("sib"))


def sibling(name: str, label: str | None = None) -> Column:
    """The entry of a sibling: of the signal's own value of a label, or without labels."""
    key = F.lit(name) if label is None else F.concat(F.lit(f"{name}{{{label}="), F.coalesce(F.col("labels")[label], F.lit("?")), F.lit("}"))
    return F.try_element_at("sib", key)


def shown(number: Column) -> Column:
    """A number as a text: whole ones without decimals; a question mark for what isn't known."""
    return F.when(number.isNull(), "?").when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(F.format_string("%.2f", number))


def _time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def _complete(signals: DataFrame) -> DataFrame:
    """Signals with nulls for what a source doesn't give."""
    optional = {"evidence": EVIDENCE, "unit": "string", "value_num": "double", "value_text": "string", "kind": "string", "observed_at": "timestamp", "name": "string"}
    out = signals.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in signals.columns})
    none = F.lit(None).cast("struct<value_num:double,value_text:string,observed_at:timestamp>")
    return out if "prev" in out.columns else out.withColumn("prev", none)


def _found(signals: DataFrame, specs: list[Spec], quoted: DataFrame | None = None) -> DataFrame:
    """Findings of several rules in one pass over the signals; what they quote is joined to findings alone."""
    hits = F.array_compact(F.array(*[F.when(s.when, F.lit(i)) for i, s in enumerate(specs)]))
    rows = _complete(signals).withColumn("hit", F.explode(hits))
    if quoted is not None:
        rows = rows.join(quoted, ["host", "round_id"], "left")
    else:
        rows = rows.withColumn("sib", F.lit(None).cast(f"map<string,{_SIBLING}>"))
    finding = F.coalesce(*[F.when(F.col("hit") == i, s.struct()) for i, s in enumerate(specs)])
    out = rows.select("host", "round_id", finding.alias("f"), "key", "labels")
    names = ("rule", "severity", "confidence", "title")
    return out.select("host", "round_id", *[F.col(f"f.{n}").alias(n) for n in names], "key", "labels", "f.detail", "f.evidence", "f.signal_keys", "f.baseline")


def rule(spec):
    """A function from thresholds to a ``Spec`` becomes one from signals to findings; ``spec`` keeps the first. With
    ``quoted``, the siblings of each round, findings quote them; without, they say that they aren't known."""

    @wraps(spec)
    def run(signals: DataFrame, t: Thresholds = Thresholds(), quoted: DataFrame | None = None) -> DataFrame:
        return _found(signals, [spec(t)], quoted)

    run.spec = spec
    return run


def _is(*names: str) -> Column:
    return F.col("name").isin(*names)


def _false() -> Column:
    return (F.col("kind") == "state") & (F.col("value_text") == "false")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit("?"))


@rule
def uncounted_failures(t):
    """Failures that no filter would count: any at all is critical. Services with such failures are named, and the
    other counts of the same log are quoted."""
    of = _text("uncounted_by_service{jail=", _known(F.col("labels")["jail"]), ",")
    entries = F.filter(F.map_entries(F.coalesce("sib", F.create_map().cast(f"map<string,{_SIBLING}>"))), lambda e: e["key"].startswith(of) & (e["value"]["number"] > 0))
    name = lambda e: F.regexp_extract(e["key"], r"service=([^,}]*)", 1)
    listed = lambda what: F.array_join(F.transform(entries, what), ", ")
    some = F.size(entries) > 0
    number = lambda n: shown(sibling(n, "jail")["number"])
    title = _text(shown(F.col("value_num")), " failures would not be counted", F.when(some, _text(" on ", listed(name))).otherwise(""))
    detail = _text(
        _known(F.col("labels")["jail"]), ": ", shown(F.col("value_num")), " of ", number("observed"), " failures match no filter; coverage ",
        shown(F.floor(sibling("coverage_ratio", "jail")["number"] * 100)), " percent; by service: ",
        F.when(some, listed(lambda e: F.concat(name(e), F.lit(": "), shown(e["value"]["number"])))).otherwise("?"),
        "; matched lines ", number("matched"), ", filter tool ", number("tool_matched"), ", engine ", number("found"),
    )
    return Spec(_is("uncounted") & (F.col("value_num") > 0), "fail2ban.uncounted_failures", 3, "derived", title, detail, more=entries)


@rule
def filter_wiring(t):
    """A jail whose filter isn't the expected one, or whose filter file is missing."""
    kind = F.when(_is("filter_file_present"), "fail2ban.filter_file_missing").otherwise("fail2ban.filter_not_as_expected")
    title = _text("filter wiring of ", _known(F.col("labels")["jail"]))
    detail = _text(F.col("name"), " is false; the jail declares ", _known(sibling("filter_declared", "jail")["text"]))
    return Spec(_is("filter_as_expected", "filter_file_present") & _false(), kind, 3, "observed", title, detail)


@rule
def logging_blind(t):
    """Authentication that leaves no line to read."""
    title = F.lit("authentication is not logged where it can be read")
    return Spec(_is("logging_healthy") & _false(), "dovecot.auth_logging_blind", 3, "observed", title, _text(F.col("key"), " is false"))


@rule
def engine_drift(t):
    """Matched lines and the engine's own count lie apart."""
    title = F.when(F.col("value_num") > 0, "engine counted fewer than match").otherwise("engine counted more than match")
    number = lambda n: shown(sibling(n, "jail")["number"])
    detail = _text("apart by ", shown(F.abs("value_num")), ": matched lines ", number("matched"), ", engine ", number("found"))
    return Spec(_is("engine_drift") & (F.abs("value_num") >= t.drift), "fail2ban.filter_engine_drift", 2, "derived", title, detail)


@rule
def disk_pressure(t):
    """Space or inodes used up to a percentage."""
    warn, critical = t.disk
    kind = F.when(_is("disk_used_percent"), "disk.space_low").otherwise("disk.inodes_low")
    severity = F.when(F.col("value_num") >= critical, 3).otherwise(2)
    title = _text(shown(F.col("value_num")), " percent used")
    return Spec(_is("disk_used_percent", "disk_inodes_percent") & (F.col("value_num") >= warn), kind, severity, "observed", title, _text(F.col("key"), " is high"))


@rule
def disk_filling(t):
    """Space that runs out within days at the rate since the last observation, if that lies far enough back."""
    hours = (F.unix_micros("observed_at") - F.unix_micros("prev.observed_at")) / 3600e6
    rate = (F.col("prev.value_num") - F.col("value_num")) / hours
    left = F.when(rate > 0, F.col("value_num") / rate)
    due = (hours >= t.fill_least_hours) & (left <= t.fill_hours[0])
    title = _text("full in ", F.floor(left).cast("string"), " hours")
    detail = _text("free space went from ", shown(F.col("prev.value_num")), " to ", shown(F.col("value_num")))
    return Spec(_is("disk_available_bytes") & due, "disk.filling", F.when(left <= t.fill_hours[1], 3).otherwise(2), "derived", title, detail, _text("sample of ", _time(F.col("prev.observed_at"))))


@rule
def cert_expiry(t):
    """Certificates close to their end or past it."""
    warn, critical = t.cert_days
    title = F.when(F.col("value_num") <= 0, "certificate has expired").otherwise("certificate expires soon")
    return Spec(_is("cert_days_left") & (F.col("value_num") <= warn), "tls.expiring", F.when(F.col("value_num") <= critical, 3).otherwise(2), "observed", title, _text(shown(F.col("value_num")), " days left"))


@rule
def collection_errors(t):
    """What couldn't be read is unknown, not zero."""
    return Spec(F.col("kind") == "error", "collection_error", 2, "observed", _text("could not read ", F.col("name")), F.coalesce("value_text", F.lit("no reason given")))


@rule
def rate_spike(t):
    """A watched number well above the last one: by a difference and by a factor, or from zero. The baseline says when it
    is older than some windows."""
    now, was = F.col("value_num"), F.col("prev.value_num")
    grown = (now - was >= t.spike_delta) & ((was == 0) | (now >= t.spike_factor * was))
    severity = F.when(_is(*t.urgent), 3).otherwise(2)
    title = _text(F.col("name"), " ", shown(was), " to ", shown(now), F.coalesce(F.concat(F.lit(" "), "unit"), F.lit("")))
    detail = _text(F.col("key"), " grew by ", shown(now - was), F.when(was == 0, ", from zero").otherwise(_text(", over ", F.floor(now / was).cast("string"), " times")))
    minutes = F.floor((F.unix_micros("observed_at") - F.unix_micros("prev.observed_at")) / 60e6)
    stale = F.when(minutes > t.stale_windows * t.window_minutes, _text(", ", minutes.cast("string"), f" minutes before: more than {t.stale_windows:g} windows")).otherwise("")
    return Spec(_is(*t.spiking) & grown, "change.rate_spike", severity, "derived", title, detail, _text("round of ", _time(F.col("prev.observed_at")), stale))


@rule
def counter_reset(t):
    """A counter that only grows is lower than before. Starts of the engine in the window are quoted."""
    now, was = F.col("value_num"), F.col("prev.value_num")
    starts = sibling("engine_restarts")["number"]
    detail = _text(shown(was), " to ", shown(now), ": it started anew", F.when(starts > 0, _text("; the engine started ", shown(starts), " times in the window")).otherwise(""))
    return Spec(_is(*t.counters) & (now < was), "change.counter_reset", 1, "derived", _text(F.col("name"), " went back"), detail, _text(shown(was), " at ", _time(F.col("prev.observed_at"))))


@rule
def state_changed(t):
    """A watched state differs from the last one."""
    other = F.col("prev").isNotNull() & ~F.col("prev.value_text").eqNullSafe(F.col("value_text"))
    detail = _text(_known(F.col("prev.value_text")), " to ", _known(F.col("value_text")))
    return Spec((F.col("kind") == "state") & _is(*t.watched_states) & other, "change.state_changed", 1, "observed", _text(F.col("name"), " changed"), detail, _text("at ", _time(F.col("prev.observed_at"))))


def alert_severity(name: Column) -> Column:
    """An alert's severity word to a level; other words are the lowest."""
    word = F.lower(name)
    return F.when(word.isin("critical", "error", "page"), 3).when(word.isin("warning", "warn"), 2).otherwise(1)


def alert_firing(alerts: DataFrame) -> DataFrame:
    """Alerts that fire; resolved ones make no finding. The place is the instance, else the job."""
    rows = alerts.withColumn("key", F.col("labels")["alertname"])
    place = F.coalesce(F.col("labels")["instance"], F.col("labels")["job"], F.lit("?"))
    severity = alert_severity(F.coalesce(F.col("labels")["severity"], F.lit("")))
    detail = F.col("summary") if "summary" in alerts.columns else None
    return _found(rows, [Spec(F.lower("status") == "firing", "alertmanager.alert_firing", severity, "observed", F.concat(F.col("key"), F.lit(" at "), place), detail)])


def went_silent(silent: DataFrame, most: int | None = 20) -> DataFrame:
    """One finding for each round with silent series: how many, and the first of them in order, or all if ``most`` is none."""
    rows = silent.groupBy("host", "round_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("key")).alias("keys"))
    first, they = (F.col("keys"), "they are ") if most is None else (F.slice("keys", 1, most), "the first are ")
    rows = rows.select("host", "round_id", "n", first.alias("first"), F.create_map().cast("map<string,string>").alias("labels"))
    rows = rows.withColumn("key", F.array_join("first", " "))
    title = F.concat(F.col("n").cast("string"), F.lit(" series went silent"))
    return _found(rows, [Spec(F.lit(True), "change.went_silent", 2, "derived", title, F.concat(F.lit(they), F.array_join("first", ", ")), keys=F.col("first"))])


SIGNAL_RULES = (
    uncounted_failures, filter_wiring, logging_blind, engine_drift, disk_pressure, disk_filling, cert_expiry,
    collection_errors, rate_spike, counter_reset, state_changed,
)


def all_findings(signals: DataFrame, rounds: DataFrame, alerts: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Findings of every rule over every round. A round never is its own past, since earlier means earlier."""
    out = _found(history.with_previous(signals), [r.spec(t) for r in SIGNAL_RULES], siblings(signals))
    out = out.unionByName(went_silent(history.silent(signals, rounds, t.silence_hours), t.silent_shown))
    return out if alerts is None else out.unionByName(alert_firing(alerts))


def ordered(findings: DataFrame) -> DataFrame:
    """With ``pos``: most severe first, then rule and title, in each round."""
    order = Window.partitionBy("host", "round_id").orderBy(F.desc("severity"), "rule", "title", "key")
    return findings.withColumn("pos", F.row_number().over(order))


def as_json(findings: DataFrame) -> DataFrame:
    """Findings with ``json``, all that they say in one object: labels and signal keys always, a baseline, correlations and
    evidence where there are any."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    severity = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), F.col("severity")).alias("severity")
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels")
    told = [some("correlations")] if "correlations" in findings.columns else []
    return findings.withColumn("json", F.to_json(F.struct("rule", severity, "confidence", "title", "detail", labels, "signal_keys", "baseline", *told, some("evidence"))))
