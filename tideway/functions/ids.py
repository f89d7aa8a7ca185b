"""Entry ids: (ms, seq), ordered by ms, then seq, and never as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest part of an id.
MOST = 9_223_372_036_854_775_807
_SCALE = "cast(10000000000000000000 as decimal(20,0))"


def parse(text: Column) -> Column:
    """struct(ms, seq) of ``ms-seq``, null unless both sides are digits only and fit 64 bits; leading zeros are fine."""
    side = lambda i: F.regexp_extract(text, r"\A([0-9]+)-([0-9]+)\z", i)
    ms, seq = (side(i).try_cast("bigint") for i in (1, 2))
    return F.when(ms.isNotNull() & seq.isNotNull(), F.struct(ms.alias("ms"), seq.alias("seq")))


def text(ms: Column, seq: Column) -> Column:
    return F.concat(ms.cast("string"), F.lit("-"), seq.cast("string"))


def pair(ms, seq) -> Column:
    """struct(ms, seq), whose comparison is the order of ids."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return F.struct(as_column(ms).cast("long").alias("ms"), as_column(seq).cast("long").alias("seq"))


def after(ms: str, seq: str, than: tuple[int, int]) -> Column:
    """Whether (ms, seq) is behind an id: the comparison of both parts, and one of ms alone, which reaches the scan."""
    m, s = than
    return (F.col(ms) >= F.lit(m)) & ((F.col(ms) > F.lit(m)) | (F.col(seq) > F.lit(s)))


def upto(ms: str, seq: str, bound: tuple[int, int]) -> Column:
    """Whether (ms, seq) is at or before an id; reaches the scan as ``after`` does."""
    m, s = bound
    return (F.col(ms) <= F.lit(m)) & ((F.col(ms) < F.lit(m)) | (F.col(seq) <= F.lit(s)))


def packed(ms: Column, seq: Column) -> Column:
    """The id as one decimal(38, 0) of the same order: maxima of it are hash-aggregated, those of a struct are not."""
    return (ms.cast("decimal(19,0)") * F.expr(_SCALE) + seq.cast("decimal(19,0)")).cast("decimal(38,0)")


def unpacked(id38: Column) -> tuple[Column, Column]:
    ms = F.floor(id38 / F.expr(_SCALE)).cast("long")
    return ms, (id38 - ms.cast("decimal(19,0)") * F.expr(_SCALE)).cast("long")


def from_time(time: Column) -> Column:
    """The first id of an instant."""
    return pair(F.unix_millis(time.cast("timestamp")), 0)


def time_of(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def before(ms: Column, seq: Column) -> Column:
    """The id before: one seq less, else the last of the millisecond before, else 0-0."""
    return F.when(seq > 0, pair(ms, seq - 1)).when(ms > 0, pair(ms - 1, MOST)).otherwise(pair(0, 0))


def following(ms: Column, seq: Column) -> Column:
    """The id behind: one seq more, carried into ms at the end of the range."""
    return F.when(seq < MOST, pair(ms, seq + F.when(seq < MOST, 1).otherwise(0))).otherwise(pair(ms + F.when(ms < MOST, 1).otherwise(0), 0))
