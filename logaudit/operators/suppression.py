"""Which briefs are sent: a situation is told when it is new, and again only after a while without a message.

Whether a brief is sent depends on which earlier one was. Each time points at the next one that lies far enough behind
it; the times that are sent are those reached from the first one by these pointers, which are followed by doubling
them. No situation is gathered: a join never has more than one row for a situation and a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.sources import tables

LEDGER = "sink string, digest string, sent_at timestamp, headline string, batch string"


def next_allowed(times: DataFrame, gap: int) -> DataFrame:
    """``k, at, next`` for distinct rows ``k, at`` (microseconds): the earliest time of k at or after ``at + gap``.

    Times are dealt into buckets as long as the gap. The answer lies in the bucket after a time's own, or it is the
    first time of the next bucket that has any; so a window holds one bucket of one k, or one row for each bucket.
    """
    start = lambda t: t - F.pmod(t, F.lit(gap))
    held = times.select("k", start(F.col("at")).alias("bucket"), F.col("at").alias("t"), F.lit(None).cast("long").alias("own"))
    asked = times.select("k", start(F.col("at") + gap).alias("bucket"), (F.col("at") + gap).alias("t"), F.col("at").alias("own"))
    back = Window.partitionBy("k", "bucket").orderBy(F.desc("t"), F.isnotnull("own")).rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("own").isNull(), F.col("t")), ignorenulls=True).over(back)
    met = held.unionByName(asked).withColumn("next", near).where("own is not null")
    later = Window.partitionBy("k").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = held.groupBy("k", "bucket").agg(F.min("t").alias("first"))
    empty = asked.select("k", "bucket").distinct().withColumn("first", F.lit(None).cast("long"))
    each = firsts.unionByName(empty).groupBy("k", "bucket").agg(F.min("first").alias("first"))
    after = each.withColumn("after", F.last("first", ignorenulls=True).over(later)).select("k", "bucket", "after")
    return met.join(after, ["k", "bucket"], "left").select("k", F.col("own").alias("at"), F.coalesce("next", "after").alias("next")).where("next is not null")


def reached(pointers: DataFrame, starts: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``k, at`` and the further columns of ``starts``: the starts, and with nulls in those columns every time that the
    pointers lead to from them. A round doubles the length of the pointers, so there are as many rounds as the number of
    messages in the longest chain has binary digits."""
    more = [c for c in starts.columns if c not in ("k", "at")]
    none = [F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in more]
    jump, marked = tables.cut(pointers, "pointers"), starts.select("k", "at", *more)
    for _ in range(max_rounds):
        marked = tables.cut(marked.unionByName(marked.join(jump, ["k", "at"]).select("k", F.col("next").alias("at"), *none)), "marked")
        beyond = jump.select("k", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = tables.cut(jump.join(beyond, ["k", "next"]).select("k", "at", F.col("far").alias("next")), "pointers")
        if jump.isEmpty():
            return marked
    raise RuntimeError(f"more than 2**{max_rounds} messages in a chain")


def should_send(
    briefs: DataFrame, minutes: int = 720, floor: int = 2, keys: tuple[str, ...] = ("sink", "digest"), ledger: DataFrame | None = None
) -> DataFrame:
    """Each brief (``severity, as_of`` and the keys, with all its columns) with ``send`` and ``reason``.

    A brief without findings (null severity) or below the floor isn't sent, nor is one without a time. The first of a
    situation is; a later one if so many minutes have passed since the last that was sent, which for the first brief
    here is the last message of ``ledger`` (the keys and ``sent_at``) at or before its time. Of briefs of equal time one
    is sent, the first by its columns; so repeated rows make one message. Null keys are a situation of their own. With 0
    minutes all are sent.
    """
    own = [F.col(f"`{c}`") for c in briefs.columns if c not in ("send", "reason")]
    high = F.coalesce((F.col("severity") >= floor) & F.col("as_of").isNotNull(), F.lit(False))
    why = F.when(F.col("severity").isNull(), "nothing to report").when(F.col("severity") < floor, "below the floor").otherwise("no time")
    low = briefs.where(~high).select(*own, F.lit(False).alias("send"), why.alias("reason"))
    k = F.to_json(F.struct(*keys)).alias("k")
    rows = tables.cut(briefs.where(high).select(k, F.unix_micros(F.col("as_of").cast("timestamp")).alias("at"), F.struct(*own).alias("row")), "briefs")
    times = rows.select("k", "at").distinct()
    firsts = times.groupBy("k").agg(F.min("at").alias("first"))
    if ledger is None:
        last = firsts.select("k", F.lit(None).cast("long").alias("last")).where("false")
    else:
        said = ledger.select(k, F.unix_micros(F.col("sent_at").cast("timestamp")).alias("sent"))
        last = said.join(firsts, "k").where("sent <= first").groupBy("k").agg(F.max("sent").alias("last"))
    known = tables.cut(firsts.join(last, "k", "left"), "firsts")
    told = F.lit(True) if minutes <= 0 else F.col("told")
    if minutes <= 0:
        marks = times.select("k", "at", F.lit(True).alias("told"), F.lit(None).cast("string").alias("start")).join(known.where("last is null").select("k", F.col("first").alias("at"), F.lit("new").alias("new")), ["k", "at"], "left")
        marks = marks.select("k", "at", "told", F.col("new").alias("start"))
    else:
        starts = known.select("k", F.coalesce("last", "first").alias("at"), F.when(F.col("last").isNull(), "new").otherwise("ledger").alias("start"))
        nodes = times.union(known.where("last is not null").select("k", F.col("last"))).distinct()
        marks = reached(next_allowed(nodes, minutes * 60_000_000), starts)
        marks = marks.where("start is null or start = 'new'").select("k", "at", F.lit(True).alias("told"), "start")
    place = F.row_number().over(Window.partitionBy("k", "at").orderBy(F.to_json("row")))
    each = rows.withColumn("place", place).join(marks, ["k", "at"], "left")
    send = F.coalesce(told, F.lit(False)) & ((F.col("place") == 1) | F.lit(minutes <= 0))
    reason = F.when(send & (F.col("start") == "new") & (F.col("place") == 1), "new situation").when(send, "reminder").otherwise("sent lately")
    return each.select("row.*", send.alias("send"), reason.alias("reason")).unionByName(low)


# The ledger


def read_ledger(spark: SparkSession, path: str, but_batch: str | None = None) -> DataFrame:
    """Messages that were sent, without those of one batch: a batch that is repeated must not see its own."""
    rows = tables.read(spark, path, LEDGER, ["batch"])
    return rows if but_batch is None else rows.where(F.col("batch") != but_batch)


def record_sent(sent: DataFrame, path: str, batch: str, sent_at: Column | None = None) -> None:
    """Notes briefs as sent, after they were: ``sink, digest, as_of`` and perhaps ``headline``. The batch names a
    partition; noting it again replaces it. One job at a time writes to a ledger."""
    headline = F.col("headline").cast("string") if "headline" in sent.columns else F.lit(None).cast("string")
    rows = sent.select("sink", "digest", (F.col("as_of") if sent_at is None else sent_at).alias("sent_at"), F.left(headline, F.lit(200)).alias("headline"), F.lit(batch).alias("batch"))
    tables.put(rows, path, LEDGER, ["batch"])


def decide(briefs: DataFrame, path: str, batch: str, minutes: int = 720, floor: int = 2) -> DataFrame:
    """The decisions about a batch of briefs against the stored ledger, written, so that noting what was sent can't
    change them. Nothing is noted yet: that is ``record_sent``'s part, for what really went out."""
    return tables.cut(should_send(briefs, minutes, floor, ledger=read_ledger(briefs.sparkSession, path, batch)), "decisions")
