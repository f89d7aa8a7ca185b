"""Consumer positions: the last written, flushes, contention, previews of resets and the resets themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.functions import ids, texts
from tideway.operators.order import previous
from tideway.operators.topics import bounds

#: Entries that a count pages over, and the count at which it stops being exact.
PAGE, COUNT_CAP = 1_000, 250_000
POSITION = "topic string, consumer string, partition int, ms long, seq long"


def latest(writes: DataFrame, written: str = "written") -> DataFrame:
    """(topic, consumer, partition, ms, seq): the position written last, whatever its id."""
    got = writes.groupBy("topic", "consumer", "partition").agg(F.max_by(F.struct("ms", "seq"), written).alias("x"))
    return got.select("topic", "consumer", "partition", "x.ms", "x.seq")


class NoStore:
    """A position store that keeps nothing: every start is from what the settings say."""

    def save(self, positions: DataFrame) -> None:
        pass

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], POSITION)


class MemoryStore:
    """A position store for tests: what was written last for each topic, consumer and partition, in the driver's memory."""

    def __init__(self) -> None:
        self.kept: dict[tuple[str, str, int], tuple[int, int]] = {}

    def save(self, positions: DataFrame) -> None:
        for r in positions.select("topic", "consumer", "partition", "ms", "seq").collect():
            self.kept[r[0], r[1], r[2]] = (r[3], r[4])

    def load(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k, *v) for k, v in sorted(self.kept.items())], POSITION)


def flushes(processed: DataFrame, tick_ms: int, clock: str = "ms") -> DataFrame:
    """(partition, tick, ms, seq): what a flusher writes: for each tick the last id of every partition that moved in it."""
    got = processed.groupBy("partition", F.floor(F.col(clock) / tick_ms).alias("tick")).agg(F.max(ids.packed(F.col("ms"), F.col("seq"))).alias("last"))
    ms, seq = ids.unpacked(F.col("last"))
    return got.select("partition", "tick", ms.alias("ms"), seq.alias("seq"))


def contention(writes: DataFrame, presence: DataFrame, order: str = "at") -> DataFrame:
    """(partition, at, writer, before, verdict) for each position write of (partition, at, writer), by the writer found before it.

    ignored: none, one's own, an empty or an administrative writer. stale: a rival that is not present. Else the lower
    instance id keeps writing (keeps) and the higher stands down.
    """
    rows = previous(writes, ["partition"], order, "writer").join(presence.select(F.col("instance_id").alias("before"), F.lit(True).alias("present")), "before", "left")
    ignored = F.col("before").isNull() | (F.col("before") == F.col("writer")) | F.col("before").isin(texts.NO_GUID, texts.ADMIN) | ~F.col("before").rlike(rf"\A{texts.GUID}\z")
    verdict = F.when(ignored, "ignored").when(F.col("present").isNull(), "stale").when(F.col("writer") < F.col("before"), "keeps").otherwise("stands_down")
    return rows.select("partition", order, "writer", "before", verdict.alias("verdict"))


def capped(n: Column, cap: int = COUNT_CAP) -> tuple[Column, Column]:
    """The count that pages of PAGE entries report, and whether it is exact: counting stops with the page that reaches the cap."""
    over = n >= cap
    return F.when(over, F.least(n, F.lit(-(-cap // PAGE) * PAGE))).otherwise(n).cast("long"), ~over


def preview(entries: DataFrame, stored: DataFrame, target: tuple[int, int] | None, when_missing: str = "beginning", cap: int = COUNT_CAP, partitions: DataFrame | None = None) -> DataFrame:
    """What moving a consumer to an id (None: to the end) would do, a row for each partition, from one pass over the entries.

    A partition without a stored position is measured from the start that the consumer would take, 0-0 or the newest entry.
    """
    edge = bounds(entries)
    rows = (partitions.join(edge, "partition", "left") if partitions is not None else edge).join(stored.select("partition", F.struct("ms", "seq").alias("current")), "partition", "left")
    newest = F.when(F.col("newest_ms").isNotNull(), ids.pair(F.col("newest_ms"), F.col("newest_seq")))
    assumed = F.when(F.col("current").isNull(), F.coalesce(newest, ids.pair(0, 0)) if when_missing == "now" else ids.pair(0, 0))
    to = F.coalesce(newest, ids.pair(0, 0)) if target is None else ids.pair(*target)
    rows = rows.withColumns({"target": to, "assumed": assumed}).withColumn("base", F.coalesce("current", "assumed"))
    direction = F.when(F.col("target") < F.col("base"), "rewind").when(F.col("target") > F.col("base"), "skip").otherwise("none")
    rows = rows.withColumns({"direction": direction, "low": F.least("target", "base"), "high": F.greatest("target", "base")})
    # The spans are a row a partition: entries meet theirs and are counted where they are.
    spans = rows.select("partition", F.col("low.ms").alias("lm"), F.col("low.seq").alias("ls"), F.col("high.ms").alias("hm"), F.col("high.seq").alias("hs"))
    inside = ((F.col("ms") > F.col("lm")) | ((F.col("ms") == F.col("lm")) & (F.col("seq") > F.col("ls")))) & ((F.col("ms") < F.col("hm")) | ((F.col("ms") == F.col("hm")) & (F.col("seq") <= F.col("hs"))))
    counts = entries.select("partition", "ms", "seq").join(spans, "partition").where(inside).groupBy("partition").agg(F.count("*").alias("n"))
    n, exact = capped(F.coalesce("n", F.lit(0)), cap)
    wanted = ids.following(F.col("target.ms"), F.col("target.seq"))
    oldest = F.when(F.col("oldest_ms").isNotNull(), ids.pair(F.col("oldest_ms"), F.col("oldest_seq")))
    return rows.join(counts, "partition", "left").select(
        "partition", F.col("current.ms").alias("current_ms"), F.col("current.seq").alias("current_seq"), F.col("target.ms").alias("target_ms"), F.col("target.seq").alias("target_seq"),
        "direction", n.alias("entries"), exact.alias("exact"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce(oldest > wanted, F.lit(False)).alias("trimmed_away"),
        F.col("assumed.ms").alias("assumed_ms"), "oldest_ms", "oldest_seq", "newest_ms", "newest_seq",
    )


def totals(previews: DataFrame) -> DataFrame:
    of = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("entries"))), F.lit(0))
    return previews.agg(of("rewind").alias("to_reprocess"), of("skip").alias("to_skip"), F.coalesce(F.bool_or("trimmed_away"), F.lit(False)).alias("any_trimmed_away"))


def described(previews: DataFrame) -> DataFrame:
    """(partition, line): the preview of each partition in words."""
    current = F.when(F.col("current_ms").isNotNull(), ids.text(F.col("current_ms"), F.col("current_seq"))).otherwise(F.concat(F.lit("(none, assuming "), ids.text(F.col("assumed_ms"), F.lit(0)), F.lit(")")))
    oldest = F.when(F.col("oldest_ms").isNotNull(), ids.text(F.col("oldest_ms"), F.col("oldest_seq"))).otherwise("(empty)")
    return previews.select("partition", F.concat(
        F.lit("p"), F.col("partition").cast("string"), F.lit("  current "), current, F.lit(" -> "), ids.text(F.col("target_ms"), F.col("target_seq")), F.lit("  "), F.col("direction"), F.lit(" "),
        F.when(F.col("exact"), "").otherwise("≥"), F.col("entries").cast("string"), F.lit(" of "), F.col("length").cast("string"), F.lit("  oldest "), oldest,
    ).alias("line"))


def reset(positions: DataFrame, partitions: DataFrame, target: tuple[int, int], consumer: str, topic: str) -> DataFrame:
    """All positions with those of one consumer moved to an id in the given partitions, written by the administrator."""
    moved = partitions.select(F.lit(topic).alias("topic"), F.lit(consumer).alias("consumer"), "partition", F.lit(target[0]).cast("long").alias("ms"), F.lit(target[1]).cast("long").alias("seq"), F.lit(texts.ADMIN).alias("instance_id"))
    kept = positions.join(moved.select("topic", "consumer", "partition"), ["topic", "consumer", "partition"], "left_anti")
    return kept.select(*moved.columns).unionByName(moved)


def markers(partitions: DataFrame, target: tuple[int, int], issued: str) -> DataFrame:
    """(partition, field, value) of the reset markers that a move leaves for running consumers."""
    return partitions.select("partition", texts.marker_field(F.col("partition")).alias("field"), texts.marker_text(F.lit(target[0]), F.lit(target[1]), F.lit(issued)).alias("value"))


def taken(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """Markers that stay: those whose value is not the one that was applied (compare and delete)."""
    return pending.join(applied.select("partition", "field", "value"), ["partition", "field", "value"], "left_anti")
