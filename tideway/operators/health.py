"""Lag, progress and health, as columns of a partition status table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import ids
from tideway.operators.order import SPAN_MS
from tideway.operators.topics import bounds

#: A tail sample of this age says nothing any more.
STALE_MS = 60_000
RULES = ("ConnectionDown", "Stalled", "BlockedTooLong", "StoppedTooLong", "BehindTail", "NoConsumerStarted", "AllPartitionsStopped", "NotReadingYet", "Blocked", "Stopped", "Lagging", "OwnershipDegraded", "Silent", "None")


def lag_ms(now_ms: int, processed_ms: Column, caught_up: Column) -> Column:
    """How old the last processed entry is; 0 if there is none or nothing is left to read."""
    return F.when(processed_ms.isNull() | caught_up, 0.0).otherwise(F.greatest(F.lit(0), F.lit(now_ms) - processed_ms).cast("double"))


def estimated_behind(length: Column, first: tuple[Column, Column], last: tuple[Column, Column], done: tuple[Column, Column]) -> Column:
    """Entries behind, by the share of the stream's time that is left: no entry is read for it."""
    f, l, d = (ids.pair(*x) for x in (first, last, done))  # noqa: E741
    span = last[0] - first[0]
    guess = (length.cast("double") * (last[0] - done[0]).cast("double") / span.cast("double")).cast("long")
    return F.when((length <= 0) | (d >= l), F.lit(0)).when((d < f) | (span <= 0), length).otherwise(F.greatest(F.lit(1), F.least(guess, length))).cast("long")


def entries_behind(entries: DataFrame, at: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """(consumer, partition, entries): the entries behind each position (consumer, partition, pm, ps).

    Entries are counted by spans of time, whose running sums are a small table; an entry is compared only with the
    positions that lie in its own span.
    """
    span = lambda c: F.expr(f"`{c}` div {span_ms}")
    spans = entries.groupBy("partition", span("ms").alias("span")).agg(F.count("*").alias("n"))
    own = at.select("consumer", "partition", "pm", "ps", span("pm").alias("span"))
    every = spans.unionByName(own.select("partition", "span", F.lit(0).cast("long").alias("n")).distinct()).groupBy("partition", "span").agg(F.sum("n").alias("n"))
    later = F.sum("n").over(Window.partitionBy("partition").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1))
    later = every.select("partition", "span", F.coalesce(later, F.lit(0)).alias("later"))
    same = entries.select("partition", "ms", "seq", span("ms").alias("span")).join(own, ["partition", "span"])
    same = same.where((F.col("ms") > F.col("pm")) | ((F.col("ms") == F.col("pm")) & (F.col("seq") > F.col("ps")))).groupBy("consumer", "partition").agg(F.count("*").alias("own"))
    rows = own.join(later, ["partition", "span"]).join(same, ["consumer", "partition"], "left")
    return rows.select("consumer", "partition", (F.col("later") + F.coalesce("own", F.lit(0))).alias("entries"))


def lags(entries: DataFrame, positions: DataFrame, now_ms: int) -> DataFrame:
    """(consumer, partition, length, entries_est, entries, lag_ms) of every stored position."""
    edge = bounds(entries)
    at = positions.select("consumer", "partition", F.col("ms").alias("pm"), F.col("seq").alias("ps"))
    rows = at.join(edge, "partition")
    counts = entries_behind(entries, at)
    est = estimated_behind(F.col("length"), (F.col("oldest_ms"), F.col("oldest_seq")), (F.col("newest_ms"), F.col("newest_seq")), (F.col("pm"), F.col("ps")))
    caught = ids.pair(F.col("pm"), F.col("ps")) >= ids.pair(F.col("newest_ms"), F.col("newest_seq"))
    return rows.join(counts, ["consumer", "partition"], "left").select("consumer", "partition", "length", est.alias("entries_est"), F.coalesce("entries", F.lit(0)).alias("entries"), lag_ms(now_ms, F.col("pm"), caught).alias("lag_ms"))


def behind_since(samples: DataFrame, at: str = "at") -> DataFrame:
    """samples (partition, at, position, tail) with ``behind`` and ``since``: when the run of samples behind the tail with this position
    began. A position that moves begins a new run."""
    w = Window.partitionBy("partition").orderBy(at)
    rows = samples.withColumn("behind", F.col("tail") > F.col("position"))
    new = F.when(F.lag("position").over(w).eqNullSafe(F.col("position")) & F.lag("behind").over(w).eqNullSafe(F.col("behind")), 0).otherwise(1)
    rows = rows.withColumn("run", F.sum(new).over(w))
    return rows.withColumn("since", F.when(F.col("behind"), F.min(at).over(Window.partitionBy("partition", "run")))).drop("run")


def stalled_ms(state: Column, idle: Column, busy: Column, unpersisted: Column) -> Column:
    """The longest time without progress; a partition that has stopped has none to make, a blocked one is judged on its own."""
    return F.when(state.isin("stopped", "blocked"), unpersisted).otherwise(F.greatest(idle, busy, unpersisted)).cast("double")


def grade(s: dict[str, Column]) -> tuple[Column, Column]:
    """(status, rule) of a partition, the first that holds. Of the limits, stalled and behind count from equality, the others beyond it."""
    over = lambda ms, limit: ms > s[limit] * 1000
    stalled = s["stood_down_stalled"] | ((s["stalled_limit"] > 0) & (s["stalled_ms"] >= s["stalled_limit"] * 1000))
    blocked, stopped = s["state"] == "blocked", s["state"] == "stopped"
    stopped_long = s["escalates"] & (s["lag_entries"] > 0) & over(s["stopped_ms"], "stopped_limit")
    behind = (s["behind_limit"] > 0) & s["behind"] & (s["behind_ms"] >= s["behind_limit"] * 1000)
    lagging = (s["lag_ms"] > s["lag_limit_ms"]) & (s["lag_entries"] != 0)
    rules = [
        (stalled, "unhealthy", "Stalled"), (blocked & over(s["blocked_ms"], "blocked_limit"), "unhealthy", "BlockedTooLong"), (blocked, "degraded", "Blocked"),
        (stopped & stopped_long, "unhealthy", "StoppedTooLong"), (stopped, "degraded", "Stopped"), (behind, "unhealthy", "BehindTail"), (lagging, "degraded", "Lagging"),
    ]
    status, rule = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, a, b in rules[1:]:
        status, rule = status.when(test, a), rule.when(test, b)
    return status.otherwise("healthy"), rule.otherwise("None")


def silent(status: DataFrame) -> DataFrame:
    """(process, topic, consumer, partitions, silent_ms) of consumers whose running partitions are all caught up on a fresh sample and
    have not moved for the consumer's window; silent_ms is the shortest of them."""
    ok = ~F.col("behind") & F.col("tail_age_ms").between(0, STALE_MS) & (F.col("unchanged_ms") >= F.col("silence_limit") * 1000)
    rows = status.where((F.col("state") == "running") & (F.col("silence_limit") > 0)).groupBy("process", "topic", "consumer")
    got = rows.agg(F.count("*").alias("partitions"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("all_silent"), F.min("unchanged_ms").alias("silent_ms"))
    return got.where("all_silent").drop("all_silent")


def report(status: DataFrame, processes: DataFrame) -> DataFrame:
    """(process, status, rule): the report of each process (process, consumers, started, connection_down, ownership_degraded) over its
    partition statuses, graded (rule) as ``grade`` does."""
    lagging = (F.col("lag_ms") > F.col("lag_limit_ms")) & (F.col("lag_entries") != 0)
    is_ = lambda s: F.count_if(F.col("state") == s)
    has = lambda r: F.bool_or(F.col("rule") == r)
    t = status.groupBy("process").agg(
        F.count("*").alias("partitions"), is_("blocked").alias("blocked"), is_("stopped").alias("stopped"), is_("starting").alias("starting"), is_("running").alias("running"),
        F.bool_or(lagging).alias("lagging"), *(has(r).alias(r) for r in ("Stalled", "BlockedTooLong", "StoppedTooLong", "BehindTail")),
    )
    quiet = silent(status).groupBy("process").agg(F.count("*").alias("quiet"))
    rows = processes.join(t, "process", "left").join(quiet, "process", "left").fillna(0).fillna(False)
    c = F.col
    rules = [
        ((c("consumers") == 0) & (c("partitions") == 0), "healthy", "None"), (c("connection_down"), "unhealthy", "ConnectionDown"),
        *((c(r), "unhealthy", r) for r in ("Stalled", "BlockedTooLong", "StoppedTooLong", "BehindTail")),
        ((c("consumers") > 0) & (c("started") == 0), "unhealthy", "NoConsumerStarted"),
        ((c("partitions") > 0) & (c("running") + c("blocked") + c("starting") == 0), "unhealthy", "AllPartitionsStopped"),
        ((c("running") == 0) & (c("starting") > 0), "degraded", "NotReadingYet"),
        (c("blocked") > 0, "degraded", "Blocked"), (c("stopped") > 0, "degraded", "Stopped"), (c("lagging"), "degraded", "Lagging"),
        (c("ownership_degraded"), "degraded", "OwnershipDegraded"), (c("quiet") > 0, "degraded", "Silent"),
    ]
    out, rule = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, a, b in rules[1:]:
        out, rule = out.when(test, a), rule.when(test, b)
    return rows.select("process", out.otherwise("healthy").alias("status"), rule.otherwise("None").alias("rule"))


def consumed(entries: DataFrame, keep: Column, now_ms: int) -> DataFrame:
    """(partition, type, consumed, filtered, oldest_lag_ms, mean_bytes): what meters count."""
    return entries.groupBy("partition", "type").agg(
        F.count_if(keep).alias("consumed"), F.count_if(~keep).alias("filtered"), (F.lit(now_ms) - F.min("ms")).alias("oldest_lag_ms"), F.round(F.avg(F.octet_length("body")), 6).alias("mean_bytes")
    )


def counters(consumed_: DataFrame, failures: DataFrame, flushes: DataFrame, releases: DataFrame, published: DataFrame) -> DataFrame:
    """(topic, partition, published, consumed, filtered, errors, flush_failures, clamp_released): what a process has counted, from its logs.

    consumed_ (topic, partition, kept), failures (topic, partition), flushes (topic, partition, ok), releases (topic, partition,
    entries) and published (topic, partition) are a row for each event; a partition that any of them names has a row.
    """
    by = ["topic", "partition"]
    parts = [
        published.groupBy(*by).agg(F.count("*").alias("published")), consumed_.groupBy(*by).agg(F.count_if("kept").alias("consumed"), F.count_if(~F.col("kept")).alias("filtered")),
        failures.groupBy(*by).agg(F.count("*").alias("errors")), flushes.groupBy(*by).agg(F.count_if(~F.col("ok")).alias("flush_failures")), releases.groupBy(*by).agg(F.sum("entries").alias("clamp_released")),
    ]
    names = ["published", "consumed", "filtered", "errors", "flush_failures", "clamp_released"]
    rows = None
    for p in parts:
        p = p.select(*by, *((F.col(c) if c in p.columns else F.lit(0)).cast("long").alias(c) for c in names))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))


def batch_sizes(batches: DataFrame) -> DataFrame:
    """(partition, batches, least, median, p95, most) of the sizes of handled batches (partition, read)."""
    q = lambda p: F.percentile("read", F.lit(p))
    return batches.groupBy("partition").agg(F.count("*").alias("batches"), F.min("read").alias("least"), q(0.5).alias("median"), q(0.95).alias("p95"), F.max("read").alias("most"))


def snapshot(partitions: DataFrame, edge: DataFrame, positions: DataFrame, owners: DataFrame, progress: DataFrame, now_ms: int) -> DataFrame:
    """The status row of every consumer and partition: bounds, position, lag, owner, state, progress.

    partitions (topic, consumer, partition); edge as ``bounds`` gives it; positions (consumer, partition, ms, seq); owners
    (partition, owner); progress (consumer, partition, state, last_handled_ms, last_flush_ms, errors).
    """
    rows = partitions.join(edge, "partition", "left").join(positions.select("consumer", "partition", F.col("ms").alias("position_ms"), F.col("seq").alias("position_seq")), ["consumer", "partition"], "left")
    rows = rows.join(owners, "partition", "left").join(progress, ["consumer", "partition"], "left")
    done, last = ids.pair(F.col("position_ms"), F.col("position_seq")), ids.pair(F.col("newest_ms"), F.col("newest_seq"))
    behind = F.col("newest_ms").isNotNull() & (F.col("position_ms").isNull() | (done < last))
    length = F.coalesce("length", F.lit(0)).cast("long")
    est = F.when(F.col("position_ms").isNull(), length).otherwise(F.coalesce(estimated_behind(length, (F.col("oldest_ms"), F.col("oldest_seq")), (F.col("newest_ms"), F.col("newest_seq")), (F.col("position_ms"), F.col("position_seq"))), F.lit(0)))
    since = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.lit(now_ms) - F.col(c))).cast("long")
    return rows.select(
        "topic", "consumer", "partition", F.coalesce("state", F.lit("starting")).alias("state"), "owner", F.col("owner").isNull().alias("unowned"), length.alias("length"), "oldest_ms", "oldest_seq", "newest_ms", "newest_seq",
        "position_ms", "position_seq", behind.alias("behind"), est.alias("lag_entries"), lag_ms(now_ms, F.col("position_ms"), ~behind).alias("lag_ms"), since("last_handled_ms").alias("idle_ms"), since("last_flush_ms").alias("unpersisted_ms"),
        F.coalesce("errors", F.lit(0)).cast("long").alias("errors"),
    )
