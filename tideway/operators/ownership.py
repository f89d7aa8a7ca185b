"""Who reads which partition: static ranges, leases, and the map of owners."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import texts
from tideway.operators.order import scanned


def owned(partitions: Column, count: Column, index: Column) -> tuple[Column, Column]:
    """First partition and number of partitions of the index-th of ``count`` instances; none for an index out of range."""
    per, rest = F.floor(partitions / count), partitions % count
    inside = (index >= 0) & (index < count)
    start = index * per + F.least(index, rest)
    return F.when(inside, start).otherwise(0).cast("int"), F.when(inside, per + (index < rest).cast("int")).otherwise(0).cast("int")


def owner_of(partition: Column, partitions: Column, count: Column) -> Column:
    """The instance whose range holds a partition."""
    per, rest = F.floor(partitions / count), partitions % count
    wide = rest * (per + 1)
    return F.when(partition < wide, F.floor(partition / (per + 1))).otherwise(rest + F.floor((partition - wide) / F.greatest(per, F.lit(1)))).cast("int")


def resolve_identity(config: tuple[int, int] | None, environment: dict[str, str], pod: str | None, count: int | None = None) -> tuple[int, int]:
    """(count, index) of an instance: configured, else from the environment, else the pod's ordinal, else the only one."""
    if config is not None:
        return config
    n, i = environment.get("STREAMS_INSTANCE_COUNT"), environment.get("STREAMS_INSTANCE_INDEX")
    if n and i and n.isdigit() and i.isdigit():
        return int(n), int(i)
    tail = (pod or "").rpartition("-")[2]
    if count and pod and "-" in pod and tail.isdigit():
        return count, int(tail)
    return 1, 0


def owner_map(leases: DataFrame, layout: DataFrame, now_ms: int) -> DataFrame:
    """(topic, partition, owner, unowned) for every partition of a layout (topic, partitions), by leases that are live."""
    all_ids = layout.select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    live = leases.where(F.col("expires_ms") > now_ms).select("topic", "partition", "owner")
    return all_ids.join(live, ["topic", "partition"], "left").withColumn("unowned", F.col("owner").isNull())


def degraded(owners: DataFrame) -> DataFrame:
    """(topic, partitions, unowned, degraded)."""
    return owners.groupBy("topic").agg(F.count("*").alias("partitions"), F.count_if("unowned").alias("unowned"), F.bool_or("unowned").alias("degraded"))


@dataclass
class Leases:
    """The leases of one topic and consumer as a table of fields with an expiry, and the cycle that an instance runs on it."""

    partitions: int
    fields: dict[str, tuple[str, int]] = field(default_factory=dict)

    def cycle(self, me: str, now_ms: int, ttl_ms: int, quarantined: frozenset[int] = frozenset()) -> list[int]:
        """The partitions that ``me`` holds afterwards: presence is renewed (withdrawn under quarantine), what is above a fair share is
        released from the highest on, the rest renewed, and free ones are claimed from the lowest on."""
        self.fields = {k: v for k, v in self.fields.items() if v[1] > now_ms}
        presence, until = f"i:{me}", now_ms + ttl_ms
        if quarantined:
            self.fields.pop(presence, None)
        else:
            self.fields[presence] = (me, until)
        members = max(1, sum(k.startswith("i:") for k in self.fields))
        share = -(-self.partitions // members)
        mine = [p for p in range(self.partitions) if self.fields.get(str(p), ("",))[0] == me]
        held = [p for p in mine if p not in quarantined][:share]
        free = [p for p in range(self.partitions) if str(p) not in self.fields and p not in quarantined]
        for p in mine:
            del self.fields[str(p)]
        held = sorted(held + free[: share - len(held)])
        self.fields.update((str(p), (me, until)) for p in held)
        return held

    def release(self, me: str) -> None:
        """Gives up what is still one's own."""
        self.fields = {k: v for k, v in self.fields.items() if v[0] != me}


def lease_cycles(calls: DataFrame) -> DataFrame:
    """(topic, at, me, held): calls (topic, at, me, partitions, ttl_ms) run one after another on the leases of their topic."""
    def step(leases, me, at, partitions, ttl_ms):
        leases = leases or Leases(partitions)
        return leases, ",".join(map(str, leases.cycle(me, at, ttl_ms)))

    return scanned(calls, ["topic"], ["at", "me"], ["me", "at", "partitions", "ttl_ms"], step, "held string", ["topic", "at", "me"])


def discovered(keys: DataFrame, key: str = "key") -> DataFrame:
    """(topic, consumer, positions, ownership) of the consumers that stored keys tell of: those with positions, and those that only own
    partitions. Keys are ``re:p:{topic}:consumer`` and ``re:o:{topic}:consumer``, braces left out in a spread layout."""
    m = lambda n: F.regexp_extract(key, texts.CONSUMER_KEY, n)
    found = keys.select(m(1).alias("kind"), F.regexp_replace(m(2), r"[{}]", "").alias("topic"), m(3).alias("consumer"), m(4).alias("rest")).where("kind <> '' and rest = ''")
    return found.groupBy("topic", "consumer").agg(F.bool_or(F.col("kind") == "p").alias("positions"), F.bool_or(F.col("kind") == "o").alias("ownership"))
