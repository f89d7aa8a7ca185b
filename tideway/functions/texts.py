"""Text formats around topics: keys, positions, reset markers, owners, pod names, trace parents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideway.functions import ids

GUID = r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
NO_GUID = "00000000-0000-0000-0000-000000000000"
#: The default key prefix, and the writer id of administrative moves.
PREFIX, ADMIN = "re:", "6f72616e-6765-4164-6d69-6e5265736574"


def _tag(topic: Column, tagged: bool) -> Column:
    return F.concat(F.lit("{"), topic, F.lit("}")) if tagged else topic


def key(kind: str, topic: Column, *rest: Column, prefix: str = PREFIX, tagged: bool = True) -> Column:
    """The key of a kind: stream(partition), positions(consumer), positions_meta, ownership, topic_meta, state(name), dedupe(id), view(owner, view)."""
    t, colon = _tag(topic, tagged), F.lit(":")
    text = [r.cast("string") for r in rest]
    if kind == "stream":
        return F.concat(F.lit(prefix + "s:"), t, colon, text[0])
    if kind == "positions":
        return F.concat(F.lit(prefix + "p:"), t, colon, text[0])
    if kind == "positions_meta":
        return F.concat(F.lit(prefix + "p:"), t, colon, text[0], F.lit(":meta"))
    if kind == "ownership":
        return F.concat(F.lit(prefix + "o:"), t, colon, text[0])
    if kind == "topic_meta":
        return F.concat(F.lit(prefix + "m:"), t)
    if kind == "state":
        return F.concat(F.lit(prefix), t, F.lit(":state:"), text[0])
    if kind == "dedupe":
        return F.concat(F.lit(prefix + "dedupe:"), t, colon, text[0])
    if kind == "view":
        return F.concat(F.lit(prefix), t, F.lit(":view:"), text[0], colon, text[1])
    raise ValueError(f"no key of kind {kind}")


def resolve_prefix(environment: dict[str, str | None]) -> str:
    """The key prefix of an environment: a setting that is not blank, as it stands, else the default."""
    own = environment.get("STREAMS_KEY_PREFIX")
    return own if own and own.strip() else PREFIX


def plain_topic(topic: Column) -> Column:
    """Whether a topic name may be written together with state: not blank, no braces."""
    return topic.isNotNull() & (F.trim(topic) != "") & ~topic.rlike(r"[{}]")


def position(text: Column) -> Column:
    """struct<ms, seq, instance_id> of ``ms-seq|guid``: the id alone is fine, a bad guid is the empty one; null for a bad id."""
    parts = F.split(text, r"\|", 2)
    id_, guid = ids.parse(F.get(parts, F.lit(0))), F.get(parts, F.lit(1))
    own = F.when(guid.rlike(rf"\A{GUID}\z"), F.lower(guid)).otherwise(NO_GUID)
    return F.when(id_.isNotNull(), F.struct(id_["ms"].alias("ms"), id_["seq"].alias("seq"), own.alias("instance_id")))


def position_text(ms: Column, seq: Column, instance_id: Column) -> Column:
    return F.concat(ids.text(ms, seq), F.lit("|"), instance_id)


def marker_field(partition: Column) -> Column:
    return F.concat(F.lit("__reset:"), partition.cast("string"))


def marker(text: Column) -> Column:
    """struct<ms, seq, issued> of a reset marker ``ms-seq|time``; the time is kept as text, whose seventh digit Spark has not."""
    parts = F.split(text, r"\|", 2)
    id_ = ids.parse(F.get(parts, F.lit(0)))
    issued = F.coalesce(F.get(parts, F.lit(1)), F.lit("0001-01-01T00:00:00.0000000+00:00"))
    ok = id_.isNotNull() & issued.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,7})?(Z|[+-]\d{2}:\d{2})\z")
    return F.when(ok, F.struct(id_["ms"].alias("ms"), id_["seq"].alias("seq"), issued.alias("issued")))


def marker_text(ms: Column, seq: Column, issued: Column) -> Column:
    return F.concat(ids.text(ms, seq), F.lit("|"), issued)


def owner(text: Column) -> Column:
    """struct<instance_id, pod> of ``guid|pod``; null without a guid."""
    parts = F.split(text, r"\|", 2)
    guid = F.get(parts, F.lit(0))
    return F.when(guid.rlike(rf"\A{GUID}\z"), F.struct(F.lower(guid).alias("instance_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("pod")))


def pod_ordinal(pod: Column) -> Column:
    """The number behind the last dash of a pod's name, or null."""
    return F.regexp_extract(pod, r"-([0-9]+)\z", 1).try_cast("int")


def trace_id(trace_parent: Column) -> Column:
    """The trace id of a trace parent ``00-trace-span-flags``, or null."""
    return F.when(trace_parent.rlike(r"\A[0-9a-fA-F]{2}-[0-9a-fA-F]{32}-[0-9a-fA-F]{16}-[0-9a-fA-F]{2}\z"), F.lower(F.substring(trace_parent, 4, 32)))


def span_id(trace_parent: Column) -> Column:
    return F.when(trace_id(trace_parent).isNotNull(), F.lower(F.substring(trace_parent, 37, 16)))


#: Keys of a consumer's positions (p) and ownership (o): kind, topic, consumer, and what follows in keys that are about something else.
CONSUMER_KEY = r"^re:([po]):(\{[^{}]+\}|[^:{}]+):([^:]+)(:.*)?$"
