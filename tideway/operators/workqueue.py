"""Work queues: members of a group share the entries of a topic, hold them as pending, claim and acknowledge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.operators.order import numbered

MIN_IDLE_MS, CLAIM_MOST = 30_000, 100


def deliver(entries: DataFrame, members: int) -> DataFrame:
    """entries with the one member that gets each: in turn, by id."""
    return numbered(entries, ["partition"]).withColumn("member", F.pmod(F.col("ordinal") - 1, F.lit(members)).cast("int")).drop("total")


def pending(delivered: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """What is delivered and not acknowledged (partition, ms, seq)."""
    return delivered.join(acknowledged.select("partition", "ms", "seq"), ["partition", "ms", "seq"], "left_anti")


def claimable(waiting: DataFrame, now_ms: int, min_idle_ms: int = MIN_IDLE_MS, most: int = CLAIM_MOST, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """Up to ``most`` pending entries (delivered_ms) of each partition that have been idle long enough, from the sweep's cursor on."""
    m, s = after
    idle = waiting.where((F.lit(now_ms) - F.col("delivered_ms") >= min_idle_ms) & ((F.col("ms") > m) | ((F.col("ms") == m) & (F.col("seq") >= s))))
    return numbered(idle.drop("ordinal"), ["partition"]).where(F.col("ordinal") <= most).drop("ordinal", "total")


def acknowledged(batches: DataFrame, through: DataFrame) -> DataFrame:
    """batches (partition, batch, last_ms, last_seq) that ``through`` (partition, ms, seq) acknowledges: all up to it, the one it lies in
    only if it is that batch's last; an id behind the last batch acknowledges nothing."""
    at = through.select("partition", F.struct("ms", "seq").alias("__to"))
    top = batches.groupBy("partition").agg(F.max(F.struct("last_ms", "last_seq")).alias("__top"))
    rows = batches.join(at, "partition").join(top, "partition")
    last = F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    return rows.where((last <= F.col("__to")) & (F.col("__to") <= F.struct(F.col("__top.last_ms").alias("ms"), F.col("__top.last_seq").alias("seq")))).drop("__to", "__top")


def created(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """All groups (topic, partition, member_group, ms, seq) with those wanted that are missing, and whether each was made now: a group
    that is there keeps its position."""
    by = ["topic", "partition", "member_group"]
    new = wanted.join(groups, by, "left_anti").select(*by, "ms", "seq", F.lit(True).alias("made"))
    return groups.select(*by, "ms", "seq", F.lit(False).alias("made")).unionByName(new)


def reset(groups: DataFrame, waiting: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups set to new ids (moved: topic, partition, member_group, ms, seq, purge), and what then waits: entries that were delivered
    from a purged group are dropped from its pending list, so that they are not claimed again."""
    by = ["topic", "partition", "member_group"]
    to = moved.select(*by, F.col("ms").alias("__ms"), F.col("seq").alias("__seq"))
    after = groups.join(to, by, "left").withColumns({"ms": F.coalesce("__ms", "ms"), "seq": F.coalesce("__seq", "seq")}).drop("__ms", "__seq")
    return after.select(*groups.columns), waiting.join(moved.where("purge").select(*by), by, "left_anti")
