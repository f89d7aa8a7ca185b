"""Reading: from a position on, by partition, by type, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import ids
from tideway.operators.order import numbered


def read_after(entries: DataFrame, partition: int, position: tuple[int, int], most: int) -> DataFrame:
    """Up to ``most`` entries of one partition behind a position; both predicates and the columns reach the scan."""
    if most <= 0:
        raise ValueError("a read needs a positive count")
    return entries.where((F.col("partition") == partition) & ids.after("ms", "seq", position)).orderBy("ms", "seq").limit(most)


def behind(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """Entries behind their partition's position (partition, ms, seq); all of a partition without one."""
    at = positions.select("partition", F.col("ms").alias("__ms"), F.col("seq").alias("__seq"))
    rows = entries.join(F.broadcast(at), "partition", "left") if _few(at) else entries.join(at, "partition", "left")
    return rows.where(F.col("__ms").isNull() | (F.col("ms") > F.col("__ms")) | ((F.col("ms") == F.col("__ms")) & (F.col("seq") > F.col("__seq")))).drop("__ms", "__seq")


def _few(rows: DataFrame) -> bool:
    """Whether Spark's own estimate is small enough to broadcast; else the planner decides as it runs."""
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= 10_000_000


def read_many(entries: DataFrame, positions: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` entries of each partition behind its position."""
    return numbered(behind(entries, positions), ["partition"]).where(F.col("ordinal") <= most).drop("ordinal", "total")


def checked(reply: DataFrame, after: DataFrame) -> DataFrame:
    """(partition, arrival, ms, seq, in_order): whether each entry of a reply (partition, arrival, ms, seq) is behind the one before it, the
    first one behind the cursor (partition, ms, seq) that was sent. A reply that is not in order must not be handled.

    A reply is bounded by the count that was asked for, so its partitions are sorted whole.
    """
    before = F.lag(F.struct("ms", "seq")).over(Window.partitionBy("partition").orderBy("arrival"))
    rows = reply.withColumn("__before", before).join(after.select("partition", F.struct("ms", "seq").alias("__sent")), "partition", "left")
    last = F.coalesce("__before", "__sent", ids.pair(0, 0))
    return rows.select("partition", "arrival", "ms", "seq", (F.struct("ms", "seq") > last).alias("in_order"))


def read_state(events: DataFrame, name: str, after: tuple[int, int], most: int) -> DataFrame:
    """Up to ``most`` entries of one state stream behind an id."""
    if most <= 0:
        raise ValueError("a read needs a positive count")
    return events.where((F.col("name") == name) & ids.after("ms", "seq", after)).orderBy("ms", "seq").limit(most)


def lookup(entries: DataFrame, partition: int, id: tuple[int, int]) -> DataFrame:
    return entries.where((F.col("partition") == partition) & (F.col("ms") == id[0]) & (F.col("seq") == id[1]))


def start_positions(partitions: DataFrame, stored: DataFrame, tails: DataFrame, markers: DataFrame, start_from: str, when_missing: str = "beginning", date_ms: int | None = None) -> DataFrame:
    """(partition, ms, seq, source): where a consumer starts. A pending marker goes before all; stored positions fall back on
    ``when_missing``; a date is inclusive, as it starts behind the id before it."""
    if when_missing == "stored":
        raise ValueError("a missing position cannot start from the stored one")
    if start_from == "date" and date_ms is None:
        raise ValueError("a start from a date needs one")
    as_ = lambda t, n: t.select("partition", F.struct("ms", "seq").alias(n))
    rows = partitions.join(as_(markers, "marked"), "partition", "left").join(as_(stored, "kept"), "partition", "left").join(as_(tails, "now"), "partition", "left")

    def of(kind: str) -> Column:
        if kind == "beginning":
            return ids.pair(0, 0)
        if kind == "now":
            return F.coalesce("now", ids.pair(0, 0))
        return ids.before(F.lit(date_ms).cast("long"), F.lit(0).cast("long"))

    start = F.coalesce("kept", of(when_missing)) if start_from == "stored" else of(start_from)
    source = F.when(F.col("marked").isNotNull(), "marker").when(F.lit(start_from == "stored") & F.col("kept").isNotNull(), "stored").otherwise(when_missing if start_from == "stored" else start_from)
    at = F.coalesce("marked", start)
    return rows.select("partition", at["ms"].alias("ms"), at["seq"].alias("seq"), source.alias("source"))


def types(wanted: list[str] | None) -> Column:
    """Whether an entry passes a type filter; blank names count for nothing, and a filter of none lets all pass."""
    own = sorted({t for t in wanted or [] if t and t.strip()})
    return F.col("type").isin(own) if own else F.lit(True)


def filter_counts(entries: DataFrame, wanted: list[str] | None) -> DataFrame:
    keep = types(wanted)
    return entries.groupBy("partition").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("filtered"))


def batched(entries: DataFrame, size: int) -> DataFrame:
    """Entries with the number of their batch (from 0): ``size`` raw entries each, before any filter."""
    return numbered(entries, ["partition"]).withColumn("batch", F.floor((F.col("ordinal") - 1) / size)).drop("total")


def batches(entries: DataFrame, size: int, wanted: list[str] | None = None) -> DataFrame:
    """(partition, batch, read, kept, last_ms, last_seq); last is that of the entries read, so a batch of none kept still advances."""
    got = batched(entries, size).groupBy("partition", "batch").agg(F.count("*").alias("read"), F.count_if(types(wanted)).alias("kept"), F.max(ids.packed(F.col("ms"), F.col("seq"))).alias("last"))
    ms, seq = ids.unpacked(F.col("last"))
    return got.select("partition", "batch", "read", "kept", ms.alias("last_ms"), seq.alias("last_seq"))


def compat(entries: DataFrame) -> DataFrame:
    """Entries in the flat form of older handlers: offset text, enqueued time, null for an empty type."""
    return entries.select("partition", ids.text(F.col("ms"), F.col("seq")).alias("offset"), F.col("ms").alias("enqueued_ms"), F.when(F.col("type") != "", F.col("type")).alias("type"), F.col("key").alias("partition_key"), F.col("body").cast("string").alias("data"))
