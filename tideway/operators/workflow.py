"""Workflow starts: which entries start one, the request of each, and what an answer means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.operators.delivery import backoff_ms

#: Answers that are worth another try.
AGAIN = (408, 425, 429)


def requests(entries: DataFrame, ingress: str, workflow: Column, key: Column, handler: str, input: Column, keep: Column | None = None) -> DataFrame:
    """(partition, ms, seq, url, body) of the start that each kept entry asks for; names are escaped as parts of a path."""
    part = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    rows = entries.where(keep) if keep is not None else entries
    return rows.select("partition", "ms", "seq", F.concat(F.lit(ingress.rstrip("/") + "/"), part(workflow), F.lit("/"), part(key), F.lit("/" + handler + "/send")).alias("url"), input.alias("body"))


def outcome(status: Column, already: Column) -> Column:
    """accepted, already_started (which counts as accepted), again or failed; no status is a timeout."""
    return F.when(status.between(200, 299), "accepted").when(already, "already_started").when(status.isNull() | status.isin(*AGAIN) | (status >= 500), "again").otherwise("failed")


def retry_ms(attempt: Column, first_ms: int = 200, most_ms: int = 5_000) -> Column:
    return backoff_ms(attempt, first_ms, most_ms)


def blocked(outcomes: DataFrame, attempts: int = 5) -> DataFrame:
    """(partition, batch, blocked): a batch is blocked by any start that failed or was still to be tried again after ``attempts``."""
    bad = (F.col("outcome") == "failed") | ((F.col("outcome") == "again") & (F.col("attempt") >= attempts))
    return outcomes.groupBy("partition", "batch").agg(F.bool_or(bad).alias("blocked"))


def submit(url: str, body: bytes, post: Callable[[str, bytes], int | None], sleep: Callable[[float], None], attempts: int = 5, first_ms: int = 200, most_ms: int = 5_000) -> tuple[str, int]:
    """Posts a start until it is accepted or fails for good: (outcome, attempts used). ``post`` gives the status, or None for a timeout."""
    wait = first_ms
    for attempt in range(1, attempts + 1):
        status = post(url, body)
        if status is not None and (200 <= status < 300 or status == 409):
            return ("accepted" if status != 409 else "already_started"), attempt
        if status is not None and status not in AGAIN and status < 500 or attempt == attempts:
            return "failed", attempt
        sleep(wait / 1000)
        wait = min(2 * wait, most_ms)
    return "failed", attempts
