"""Each message once: claims with and without a lifetime, and forwarding behind a high-water mark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tideway.functions import ids
from tideway.operators.order import scanned, span_width


def first_claims(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ms, seq): the first claim of each key, for claims that never expire."""
    got = rows.groupBy(*keys).agg(F.min(ids.packed(F.col("ms"), F.col("seq"))).alias("first"))
    ms, seq = ids.unpacked(F.col("first"))
    return got.select(*keys, ms.alias("ms"), seq.alias("seq"))


def claims(rows: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """(key, ms, seq, won): a claim wins if none is live; the lifetime runs from the winning claim and is never extended.

    Claims are streamed in order; within a batch the search jumps from one winner to the next.
    """
    if ttl_ms < 1:
        raise ValueError("a claim needs a lifetime")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = object(), 0
        for b in batches:
            if not len(b):
                continue
            keys, ms, won = b.column(0), b.column(1).to_numpy(), np.zeros(len(b), bool)
            starts = run_starts(keys)
            for x, y in zip(starts, [*starts[1:], len(b)], strict=True):
                if (own := keys[x].as_py()) != last:
                    last, until = own, ms[x]
                at = x + int(np.searchsorted(ms[x:y], until))
                while at < y:
                    won[at], until = True, ms[at] + ttl_ms
                    at += int(np.searchsorted(ms[at:y], until))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(won)], names=[*b.schema.names, "won"])

    schema = StructType([*(rows.schema[c] for c in (key, "ms", "seq")), StructField("won", BooleanType())])
    return rows.select(key, "ms", "seq").repartition(key).sortWithinPartitions(key, "ms", "seq").mapInArrow(run, schema)


def run_starts(column: pa.Array) -> list[int]:
    """Where runs of equal values start."""
    if len(column) < 2:
        return [0]
    same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    none = column.is_null().to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(~(same | (none[1:] & none[:-1]))) + 1).tolist()]


def forwarded(messages: DataFrame, source: str = "source", position: str = "position", order: str = "at") -> DataFrame:
    """messages with ``forwarded``: one goes on if its position is above all positions of its source that came before it. Markers
    that never expire add nothing to that: what was forwarded once is below the mark.

    Maxima of spans come first, and their running maxima, a small table; only the rows of a span are sorted together.
    """
    width = span_width(messages, order)
    spanned = messages.withColumn("__span", F.expr(f"`{order}` div {width}"))
    tops = spanned.groupBy(source, "__span").agg(F.max(position).alias("__top"))
    earlier = F.max("__top").over(Window.partitionBy(source).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    marks = tops.select(F.col(source).alias("__source"), F.col("__span").alias("__of"), earlier.alias("__mark"))
    within = F.max(position).over(Window.partitionBy(source, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = spanned.join(marks, F.col(source).eqNullSafe(F.col("__source")) & F.col("__span").eqNullSafe(F.col("__of")))
    before = F.greatest("__mark", within)
    return rows.withColumn("forwarded", before.isNull() | (F.col(position) > before)).select(*messages.columns, "forwarded")


def forwarded_once(messages: DataFrame, ttl_ms: int, source: str = "source") -> DataFrame:
    """(source, at, position, dedupe_id, forwarded) where a message (source, at, position, dedupe_id) also needs no live marker of its
    id: a marker is set with the message that goes on and lives for ttl_ms."""

    def step(state, at, position, id_):
        mark, live, ends = state or (None, set(), deque())
        while ends and ends[0][0] <= at:  # markers end in the order in which they were set
            live.discard(ends.popleft()[1])
        ok = (mark is None or position > mark) and id_ not in live
        if ok:
            mark = position
            live.add(id_)
            ends.append((at + ttl_ms, id_))
        return (mark, live, ends), ok

    columns = [source, "at", "position", "dedupe_id"]
    return scanned(messages, [source], ["at", "position"], columns[1:], step, "forwarded boolean", columns)
