"""Topics: ids for new entries, layout, and trimming clamped to the slowest consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import ids
from tideway.functions.routing import by_key, round_robin
from tideway.operators.order import SPAN_MS, numbered

TRIM_MODES = ("exact", "approx", "none")


def route(rows: DataFrame, partitions: int, ms: str, seq: str, explicit: str | None = None, key: str = "key") -> DataFrame:
    """rows with ``partition``: the explicit one if given (an error outside the range), else by the hash of the key, else, for an
    empty key, the next slot in order of (ms, seq). Slots are counted over the rows that need one only."""
    given = F.col(explicit) if explicit else F.lit(None).cast("int")
    wrong = F.raise_error(F.concat(F.lit("no such partition: "), given.cast("string"))).cast("int")
    own = rows.withColumn("__given", F.when(given.isNull() | given.between(0, partitions - 1), given.cast("int")).otherwise(wrong))
    needs = F.col("__given").isNull() & (F.coalesce(F.col(key), F.lit("")) == "")
    placed = by_key(own.where(~needs), partitions, key, "__hashed").withColumn("partition", F.coalesce("__given", "__hashed")).drop("__given", "__hashed")
    turns = numbered(own.where(needs).drop("__given"), [], ms, seq).withColumn("partition", round_robin(F.col("ordinal"), partitions)).drop("ordinal", "total")
    return placed.unionByName(turns.select(placed.columns))


def assign_ids(rows: DataFrame, arrival: list[str], tails: DataFrame | None = None, ms: str = "ms") -> DataFrame:
    """rows (partition, ms = the broker's clock) with seq: numbered within a millisecond in order of arrival, behind the
    partition's tail (partition, ms, seq) where the clock has not moved past it."""
    if tails is not None:
        last = tails.select("partition", F.col("ms").alias("__ms"), F.col("seq").alias("__seq"))
        rows = rows.join(last, "partition", "left").withColumn(ms, F.greatest(F.col(ms), F.coalesce("__ms", ms)))
    own = F.row_number().over(Window.partitionBy("partition", ms).orderBy(*arrival)).cast("long") - 1
    if tails is None:
        return rows.withColumn("seq", own)
    behind = F.when(F.col(ms) == F.col("__ms"), F.col("__seq") + 1).otherwise(0)
    return rows.withColumn("seq", own + behind).drop("__ms", "__seq")


def publish_batches(rows: DataFrame, partitions: int, batch: str, ms: str, seq: str, key: str = "key") -> DataFrame:
    """rows with ``partition``: one decision for each batch, by the hash of its first message's key (by ms, seq), or for an empty key
    the next slot in order of the batches that need one. A batch is in one partition whole."""
    first = rows.groupBy(batch).agg(F.min_by(F.coalesce(F.col(key), F.lit("")), F.struct(ms, seq)).alias("key"), F.min(F.struct(ms, seq)).alias("__at"))
    first = first.select(batch, "key", F.col(f"__at.{ms}").alias("__ms"), F.col(f"__at.{seq}").alias("__seq"))
    decided = route(first, partitions, "__ms", "__seq").select(batch, "partition")
    return rows.join(decided, batch)


def publish_trimmed(entries: DataFrame, added: DataFrame, most: int) -> DataFrame:
    """entries with those added (partition, ms, seq, ...; ids behind the partition's tail), cut to the newest ``most`` of each partition
    that something was added to; other partitions are left alone."""
    into = added.select("partition").distinct()
    grown = entries.join(into, "partition", "left_semi").unionByName(added)
    return entries.join(into, "partition", "left_anti").unionByName(trim_maxlen(grown, most).select(*entries.columns))


def layout(meta: DataFrame, topic: str, partitions: int = 1, max_len: int = 10_000) -> DataFrame:
    """(topic, partitions, max_len, known) of one topic, the defaults where none is recorded."""
    wanted = meta.sparkSession.createDataFrame([(topic,)], "topic string")
    found = wanted.join(meta.where(F.col("topic") == topic), "topic", "left")
    return found.select("topic", F.coalesce("partitions", F.lit(partitions)).alias("partitions"), F.coalesce("max_len", F.lit(max_len)).alias("max_len"), F.col("partitions").isNotNull().alias("known"))


def bounds(entries: DataFrame) -> DataFrame:
    """(partition, oldest_ms, oldest_seq, newest_ms, newest_seq, length) in one hash aggregate."""
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    got = entries.groupBy("partition").agg(F.min(id_).alias("low"), F.max(id_).alias("high"), F.count("*").alias("length"))
    (a, b), (c, d) = ids.unpacked(F.col("low")), ids.unpacked(F.col("high"))
    return got.select("partition", a.alias("oldest_ms"), b.alias("oldest_seq"), c.alias("newest_ms"), d.alias("newest_seq"), "length")


def tail(entries: DataFrame, partitions: DataFrame, high_water: DataFrame | None = None) -> DataFrame:
    """(partition, ms, seq) of the last id ever given out, 0-0 for a partition without one. high_water (partition, ms, seq) is
    what was known before entries were trimmed."""
    all_ids = entries.select("partition", "ms", "seq")
    if high_water is not None:
        all_ids = all_ids.unionByName(high_water.select("partition", "ms", "seq"))
    last = all_ids.groupBy("partition").agg(F.max(ids.packed(F.col("ms"), F.col("seq"))).alias("high"))
    ms, seq = ids.unpacked(F.col("high"))
    return partitions.join(last, "partition", "left").select("partition", F.coalesce(ms, F.lit(0)).alias("ms"), F.coalesce(seq, F.lit(0)).alias("seq"))


def newest(entries: DataFrame, limits: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """The newest entries of each partition of ``limits`` (partition, most), so many as it says.

    Spans of time are counted; those that lie whole among the newest pass as they are, and only the one span of a partition
    that holds the border is sorted.
    """
    spanned = entries.withColumn("__span", F.expr(f"ms div {span_ms}"))
    counts = spanned.groupBy("partition", "__span").agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(Window.partitionBy("partition").orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1))
    room = counts.withColumn("__later", F.coalesce(later, F.lit(0))).join(limits.select("partition", F.col("most").alias("__most")), "partition").where("__later < __most")
    rows = spanned.join(room, ["partition", "__span"])
    nth = F.row_number().over(Window.partitionBy("partition", "__span").orderBy(F.desc("ms"), F.desc("seq")))
    border = rows.where("__later + __n > __most").withColumn("__nth", nth).where("__later + __nth <= __most")
    return rows.where("__later + __n <= __most").select(*entries.columns).unionByName(border.select(*entries.columns))


def trim_maxlen(entries: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` entries of each partition."""
    return newest(entries, entries.select("partition").distinct().withColumn("most", F.lit(most)))


def trim_minid(entries: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Entries from an id on."""
    m, s = least
    return entries.where((F.col("ms") >= m) & ((F.col("ms") > m) | (F.col("seq") >= s)))


def cutoff_ms(now_ms: int, retention_seconds: int) -> int:
    return max(0, now_ms - 1000 * retention_seconds)


def trim_retention(entries: DataFrame, now_ms: int, retention_seconds: int) -> DataFrame:
    return trim_minid(entries, (cutoff_ms(now_ms, retention_seconds), 0))


def clamp(positions: DataFrame, partitions: DataFrame) -> DataFrame:
    """(partition, clamp_ms, clamp_seq, holder): the smallest position over all consumers; a consumer without one holds at 0-0.
    Of equal positions the first consumer by name holds. Consumers times partitions is metadata, a row for each pair."""
    # Consumers are numbered by name; the first one that a partition lacks is the first gap in its numbers, or behind its last.
    ranks = positions.select("consumer").distinct().withColumn("__rank", F.row_number().over(Window.orderBy("consumer")))
    held = positions.select("consumer", "partition", "ms", "seq").join(ranks, "consumer")
    held = held.withColumn("__nth", F.row_number().over(Window.partitionBy("partition").orderBy("__rank")))
    low = held.groupBy("partition").agg(
        F.min(F.struct("ms", "seq", "consumer")).alias("x"), F.min(F.when(F.col("__rank") > F.col("__nth"), F.col("__nth"))).alias("__gap"), F.count("*").alias("__n")
    )
    rows = partitions.select("partition").distinct().join(low, "partition", "left").withColumn("__lacks", F.coalesce("__gap", F.col("__n") + 1, F.lit(1)))
    rows = rows.join(ranks.select(F.col("consumer").alias("__who"), F.col("__rank").cast("long").alias("__lacks")), "__lacks", "left")
    zero = F.lit(0).cast("long")
    at = F.when(F.col("__who").isNotNull(), F.struct(zero.alias("ms"), zero.alias("seq"), F.col("__who").alias("consumer")))
    x = F.least("x", at)
    return rows.withColumn("x", x).where("x is not null").select("partition", F.col("x.ms").alias("clamp_ms"), F.col("x.seq").alias("clamp_seq"), F.col("x.consumer").alias("holder"))


def release_at(max_len: int, threshold: float) -> int:
    """The length from which a held trim is released."""
    share = 0.0 if threshold != threshold or threshold <= 0 else min(threshold, 1.0)
    return max(1, int(max_len * share)) if share else 0


def release_target(max_len: int, at: int, length: Column) -> Column:
    """The length that a released partition is cut to."""
    return F.greatest(F.lit(1), F.least(length - max(1, max_len - at), F.lit(at))).cast("long")


def trim_report(entries: DataFrame, positions: DataFrame, now_ms: int, retention_seconds: int, max_len: int, threshold: float = 0.8) -> DataFrame:
    """What a trim does to each partition: length, cutoff, clamp, holder, released, the id it keeps from, removed, kept."""
    cut, at = cutoff_ms(now_ms, retention_seconds), release_at(max_len, threshold)
    sizes = entries.groupBy("partition").agg(F.count("*").alias("length"))
    held = sizes.join(clamp(positions, sizes.select("partition")), "partition", "left")
    holds = F.col("clamp_ms").isNotNull() & (F.col("clamp_ms") < cut)
    plan = held.select(
        "partition", "length", F.lit(cut).cast("long").alias("cutoff_ms"), "clamp_ms", "clamp_seq", F.when(holds, F.col("holder")).alias("holder"),
        (holds & (F.col("length") >= at)).alias("released"),
    )
    plan = plan.withColumn("from_ms", F.when(F.col("holder").isNotNull() & ~F.col("released"), F.col("clamp_ms")).otherwise(F.col("cutoff_ms")))
    plan = plan.withColumn("from_seq", F.when(F.col("holder").isNotNull() & ~F.col("released"), F.col("clamp_seq")).otherwise(F.lit(0)))
    plan = plan.withColumn("keep", F.when(F.col("released"), release_target(max_len, at, F.col("length"))))
    stays = (F.col("ms") > F.col("from_ms")) | ((F.col("ms") == F.col("from_ms")) & (F.col("seq") >= F.col("from_seq")))
    # A release trims twice: by id, then to a length. Both leave the newest, so the shorter one is what is left of both.
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    by_id = entries.select("partition", "ms", "seq").join(plan.select("partition", "from_ms", "from_seq"), "partition").where(stays).groupBy("partition").agg(F.count("*").alias("stays"), F.min(id_).alias("first"))
    plan = plan.join(by_id, "partition", "left").withColumn("stays", F.coalesce("stays", F.lit(0)))
    by_length = newest(entries.select("partition", "ms", "seq"), plan.where("keep < stays").select("partition", F.col("keep").alias("most"))).groupBy("partition").agg(F.min(id_).alias("cut"))
    out = plan.join(by_length, "partition", "left").withColumns({"kept": F.least("stays", F.coalesce("keep", "stays")), "head": F.coalesce("cut", "first")})
    ms, seq = ids.unpacked(F.col("head"))
    return out.select("partition", "length", "cutoff_ms", "clamp_ms", "clamp_seq", "holder", "released", ms.alias("head_ms"), seq.alias("head_seq"), "kept", (F.col("length") - F.col("kept")).alias("removed"))


def ensure_topic(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """The layout of every wanted topic (topic, partitions, max_len): what is recorded stays, partitions may grow, never shrink."""
    old = meta.select("topic", F.col("partitions").alias("was"), F.col("max_len").alias("len"))
    shrink = F.raise_error(F.concat(F.lit("partitions cannot shrink: "), F.col("topic"))).cast("int")
    kept = F.when(F.col("was").isNull(), F.col("partitions")).when(F.col("partitions") < F.col("was"), shrink).otherwise(F.col("partitions"))
    return wanted.join(old, "topic", "left").select("topic", kept.alias("partitions"), F.coalesce("len", "max_len").alias("max_len"), F.col("was").isNull().alias("created"), F.coalesce(F.col("partitions") > F.col("was"), F.lit(False)).alias("grown"))
