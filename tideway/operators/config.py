"""Settings and administrative requests: what is accepted, and why something is not."""

from __future__ import annotations

import re
from datetime import datetime

NAME_MOST = 128
_NAME = re.compile(r"[A-Za-z0-9_.:-]+")
_ID = re.compile(r"([0-9]+)-([0-9]+)")


def topic_error(topic: dict, development: bool = False) -> str | None:
    """Why a topic's settings are refused, or None."""
    if topic.get("partitions", 1) < 1:
        return "partitions must be at least 1"
    if (retention := topic.get("retention_seconds")) is not None:
        if retention < 1:
            return "retention must be at least a second"
        if "max_len" not in topic:
            return "retention needs an explicit length limit"
        if topic["max_len"] < 1:
            return "retention needs a length limit of at least 1"
    if topic.get("trim", "approx") == "none" and not development:
        return "a topic is not trimmed in development only"
    return None


def consumer_errors(consumers: list[dict]) -> list[str | None]:
    """Why each consumer's settings are refused, or None; a second (topic, consumer) pair is refused."""
    seen: set[tuple[str, str]] = set()
    out = []
    for c in consumers:
        topic, name = c.get("topic") or "", c.get("consumer") or "default"
        checks = [
            (not topic.strip(), "a consumer names a topic"), (c.get("batch_size", 100) < 1, "the batch size must be at least 1"), (c.get("capacity", 4) < 1, "the capacity must be at least 1"),
            (c.get("start_from", "stored") == "date" and c.get("start_date") is None, "a start from a date needs the date"),
            (c.get("persist", "async_batch") == "none" and c.get("start_from", "stored") == "stored", "nothing is stored, so nothing can be started from"),
            (c.get("reset_on_start", False), "a reset on start is not done; reset explicitly"), (c.get("stalled_seconds", 300) < 0, "a limit must not be negative"),
            ((topic, name) in seen, "another consumer has this topic and name"),
        ]
        out.append(next((why for bad, why in checks if bad), None) or instance_error(c.get("instances")))
        seen.add((topic, name))
    return out


def instance_error(i: dict | None) -> str | None:
    if i is None:
        return None
    ttl, renew, count, index = i.get("lease_ttl", 30), i.get("lease_renew", 10), i.get("count"), i.get("index")
    if ttl < 1 or renew < 1 or renew >= ttl:
        return "a lease is renewed before it ends"
    if i.get("mode", "lease") == "lease" and (count is not None or index is not None):
        return "leases take neither count nor index"
    if count is not None and count < 1 or index is not None and index < 0 or count is not None and index is not None and index >= count:
        return "the index must lie within the count"
    return None


def producer_error(p: dict) -> str | None:
    if not (p.get("topic") or "").strip():
        return "a producer names a topic"
    return "a batch and a queue hold at least one" if p.get("max_batch", 500) < 1 or p.get("max_queue", 100_000) < 1 else None


#: What a name in a request must be; each rule with its reason.
_NAME_RULES = (("is empty", lambda v: v.strip() != ""), (f"has over {NAME_MOST} characters", lambda v: len(v) <= NAME_MOST), ("has characters that names do not have", _NAME.fullmatch))


def name_error(value: str | None, what: str) -> str | None:
    """Why a topic's or consumer's name in a request is refused: the first rule that it breaks."""
    return next((f"the {what} {why}" for why, holds in _NAME_RULES if not holds(value or "")), None)


def reset_target(from_: str | None = None, id: str | None = None, to: str | None = None) -> tuple[str, object]:
    """(kind, value) of exactly one target: a date, an id, start or end; ("error", why) otherwise."""
    given = [x for x in (from_, id, to) if x and x.strip()]
    if len(given) != 1:
        return "error", "exactly one target is required" if not given else "targets exclude each other"
    if from_ and from_.strip():
        try:
            return "date", datetime.fromisoformat(from_)
        except ValueError:
            return "error", "from must be an instant"
    if id and id.strip():
        m = _ID.fullmatch(id)
        ok = m and all(int(x) < 2**63 for x in m.groups())
        return ("id", (int(m[1]), int(m[2]))) if ok else ("error", "id must be ms-seq")
    return (to.lower(), None) if to.lower() in ("start", "end") else ("error", "to must be start or end")


def reset_status(target: tuple[str, object], running: bool, force: bool, known: bool = True) -> int:
    """The HTTP status of a reset: 400 for a bad target, 404 for an unknown topic, 409 while the consumer runs unless forced."""
    return 400 if target[0] == "error" else 404 if not known else 409 if running and not force else 200
