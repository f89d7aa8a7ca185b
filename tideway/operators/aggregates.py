"""Event-sourced folds: aggregates from their events, and appends that expect a length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import ids
from tideway.operators.order import numbered, scanned


def known_types(events: DataFrame, known: list[str]) -> DataFrame:
    """events, or an error at an event of a type that no handler knows: a history is never read past what it does not understand."""
    wrong = F.raise_error(F.concat(F.lit("no handler for event type: "), F.coalesce("type", F.lit("")))).cast("string")
    return events.withColumn("type", F.when(F.col("type").isin(known), F.col("type")).otherwise(wrong))


def sum_since(events: DataFrame, key: str, value: Column, resets: Column) -> DataFrame:
    """(key, version, value): an aggregate whose value starts again from 0 with each resetting event, which counts itself."""
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    last = events.where(resets).groupBy(key).agg(F.max(id_).alias("__from"))
    rows = events.select(key, id_.alias("__id"), value.alias("__value")).join(last, key, "left")
    counts = F.col("__from").isNull() | (F.col("__id") >= F.col("__from"))
    return rows.groupBy(key).agg(F.count("*").alias("version"), F.sum(F.when(counts, F.col("__value")).otherwise(0.0)).alias("value"))


# The sample domain: items that are created, renamed, checked in, removed and deactivated.
CREATED, RENAMED, CHECKED_IN, REMOVED, DEACTIVATED = "item.created", "item.renamed", "item.checked-in", "item.removed", "item.deactivated"


def items(events: DataFrame) -> DataFrame:
    """(key, name, active, count, version) folded from all events (key, ms, seq, type, name, count) of each item."""
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    is_ = lambda *t: F.col("type").isin(*t)
    moved = F.when(is_(CHECKED_IN), F.col("count")).when(is_(REMOVED), -F.col("count")).otherwise(0)
    got = known_types(events, [CREATED, RENAMED, CHECKED_IN, REMOVED, DEACTIVATED]).groupBy("key").agg(
        F.max_by(F.when(is_(CREATED, RENAMED), F.col("name")), F.when(is_(CREATED, RENAMED), id_)).alias("name"),
        F.max_by(is_(CREATED), F.when(is_(CREATED, DEACTIVATED), id_)).alias("active"),
        F.sum(moved).cast("long").alias("count"), F.count("*").alias("version"),
    )
    return got.select("key", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("active", F.lit(False)).alias("active"), "count", "version")


def item_views(events: DataFrame) -> DataFrame:
    """(key, name, active, count, last_ms, last_seq): the view that events are projected into, delivered once or more often.

    A creation sets the view anew; other events are left out before the first one, and when their id is not behind the view's
    last. So only the events from the last creation on count, each id once.
    """
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    is_ = lambda *t: F.col("type").isin(*t)
    once = events.select("key", "type", "name", "count", id_.alias("id")).dropDuplicates(["key", "id"])
    made = once.where(is_(CREATED)).groupBy("key").agg(F.max("id").alias("made"))
    rows = once.join(made, "key").where("id >= made")
    got = rows.groupBy("key").agg(
        F.max_by(F.when(is_(CREATED, RENAMED), F.col("name")), F.when(is_(CREATED, RENAMED), F.col("id"))).alias("name"),
        (F.count_if(is_(DEACTIVATED)) == 0).alias("active"),
        F.sum(F.when(is_(CHECKED_IN), F.col("count")).when(is_(REMOVED), -F.col("count")).otherwise(0)).cast("long").alias("count"), F.max("id").alias("last"),
    )
    ms, seq = ids.unpacked(F.col("last"))
    return got.select("key", "name", "active", "count", ms.alias("last_ms"), seq.alias("last_seq"))


def optimistic_appends(commands: DataFrame, name: str = "name", order: str = "at") -> DataFrame:
    """(name, at, accepted, version): each command (name, at, expected, events) appends its events only if the stream is as long as
    it expects; a null expectation appends always. version is the length behind it."""

    def step(length, expected, events):
        length = length or 0
        ok = expected is None or expected == length
        length += events if ok else 0
        return length, ok, length

    return scanned(commands, [name], [order], ["expected", "events"], step, "accepted boolean, version long", [name, order])


class Refused(Exception):
    """A decision that must not raise events."""


@dataclass
class Aggregate:
    """A fold in the driver: handlers by event type, a version, and the events raised since it was loaded."""

    handlers: dict[str, Callable[[dict, dict], None]]
    state: dict = field(default_factory=dict)
    version: int = 0
    uncommitted: list[tuple[str, dict]] = field(default_factory=list)

    def load(self, history: list[tuple[str, dict]]) -> Aggregate:
        for type_, body in history:
            self._apply(type_, body)
            self.version += 1
        return self

    def raise_(self, type_: str, **body) -> None:
        self._apply(type_, body)
        self.uncommitted.append((type_, body))

    def committed(self) -> None:
        self.version += len(self.uncommitted)
        self.uncommitted = []

    def _apply(self, type_: str, body: dict) -> None:
        if type_ not in self.handlers:
            raise KeyError(f"no handler for event type {type_}")
        self.handlers[type_](self.state, body)


def decide(load: Callable[[], Aggregate], append: Callable[[int, list], bool], decision: Callable[[Aggregate], str | None], attempts: int = 3) -> tuple[str, int]:
    """Runs a decision: done, refused, or conflict after ``attempts`` appends that found another length. A decision that returns
    "redo" is loaded and run again without using an attempt up."""
    used = 0
    while used < attempts:
        own = load()
        try:
            if decision(own) == "redo":
                continue
        except Refused:
            if own.uncommitted:
                raise ValueError("a refused decision raised events") from None
            return "refused", own.version
        if not own.uncommitted:
            return "done", own.version
        if append(own.version, own.uncommitted):
            own.committed()
            return "done", own.version
        used += 1
    return "conflict", -1


def command_decisions(commands: DataFrame, name: str = "key", order: str = "at") -> DataFrame:
    """(key, at, outcome, count): commands create, check_in, remove, deactivate (with ``count``) against the sample item, in order.

    Refused: an item that is not there or is there already, a count that is not positive or above what is there, a second
    deactivation. A refused command leaves no event.
    """

    def step(state, what, n):
        there, active, count = state or (False, False, 0)
        n = n or 0
        ok = {"create": not there, "check_in": there and n > 0, "remove": there and 0 < n <= count, "deactivate": there and active}.get(what, False)
        if ok:
            there, active = True, True if what == "create" else False if what == "deactivate" else active
            count += n if what == "check_in" else -n if what == "remove" else 0
        return (there, active, count), "done" if ok else "refused", count

    return scanned(commands, [name], [order], ["command", "count"], step, "outcome string, count long", [name, order])


def load_or_create(wanted: DataFrame, states: DataFrame, key: str = "key") -> DataFrame:
    """wanted (key) with its folded state (``states``: key, version, ...); one without events has version 0, null for the rest."""
    return wanted.join(states, key, "left").withColumn("version", F.coalesce("version", F.lit(0).cast("long"))).withColumn("created", F.col("version") == 0)


def bind_id(bound: str | None, id: str) -> str:
    """The id that an aggregate is bound to: the first one given; a blank one, or another one later, is an error."""
    if not id or not id.strip():
        raise ValueError("an aggregate needs an id")
    if bound is not None and bound != id:
        raise ValueError(f"an aggregate of {bound} cannot become that of {id}")
    return id


def history(events: DataFrame, key: str = "key") -> DataFrame:
    """events with ``version``: the whole history of every stream in order, the first event being version 1."""
    return numbered(events, [key]).withColumn("version", F.col("ordinal").cast("long")).drop("ordinal", "total")
