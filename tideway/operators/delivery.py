"""What consumers do with batches: error policies, retries, buffered sending, spans of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import ids, texts
from tideway.operators.order import scanned
from tideway.operators.reader import batched


def best_effort(entries: DataFrame, size: int, fails: Column) -> DataFrame:
    """(partition, batch, read, handled): a batch handler loses the whole batch in which a message fails; the position advances."""
    rows = batched(entries, size).groupBy("partition", "batch").agg(F.count("*").alias("read"), F.count_if(fails).alias("failing"))
    return rows.select("partition", "batch", "read", F.when(F.col("failing") > 0, 0).otherwise(F.col("read")).cast("long").alias("handled"))


def per_message(entries: DataFrame, fails: Column) -> DataFrame:
    """(partition, handled, skipped): a message handler loses the failing messages only."""
    return entries.groupBy("partition").agg(F.count_if(~fails).alias("handled"), F.count_if(fails).alias("skipped"))


def stop_partition(entries: DataFrame, fails: Column) -> DataFrame:
    """(partition, handled, stopped_ms, stopped_seq): what is handled before the first message that fails, where the partition halts."""
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    first = entries.where(fails).groupBy("partition").agg(F.min(id_).alias("stop"))
    ms, seq = ids.unpacked(F.col("stop"))
    rows = entries.select("partition", id_.alias("id")).join(first, "partition", "left")
    return rows.groupBy("partition", "stop").agg(F.count_if(F.col("stop").isNull() | (F.col("id") < F.col("stop"))).alias("handled")).select("partition", "handled", ms.alias("stopped_ms"), seq.alias("stopped_seq"))


def backoff_ms(attempt: Column, first_ms: int = 1000, most_ms: int = 30_000) -> Column:
    """The wait before the attempt-th retry (from 1): doubled from first_ms up to most_ms."""
    return F.least(F.lit(most_ms).cast("double"), F.lit(first_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1)).cast("long")


def idle_ms(current: Column, most_ms: int) -> Column:
    """The next idle delay: 0, 1, 2, 4 ... up to most_ms."""
    return F.least(F.lit(most_ms), F.when(current <= 0, 1).otherwise(current * 2)).cast("long")


def buffer_batches(messages: DataFrame, most: int, wait_ms: int, source: str = "source", time: str = "ms", order: str = "event_id") -> DataFrame:
    """messages with the number of the buffered batch of their source: one closes at ``most`` messages, or when one arrives
    ``wait_ms`` or more behind the batch's first."""

    def step(state, now):
        number, first, count = state or (0, None, 0)
        if count and (count >= most or now - first >= wait_ms):
            number, first, count = number + 1, None, 0
        first = now if not count else first
        return (number, first, count + 1), number

    return scanned(messages, [source], [time, order], [time], step, "batch long", [source, order, time])


def batch_traces(entries: DataFrame, size: int, most_links: int = 16) -> DataFrame:
    """(partition, batch, messages, traces, parent, links): a batch of one trace continues it, one of several links to them.

    A batch whose messages all carry one trace has its first message's span as parent and links to the other spans among the
    first ``most_links`` messages; any other batch has no parent and a link for each of those messages that has a trace.
    """
    rows = batched(entries, size).withColumn("trace", texts.trace_id(F.col("trace_parent"))).withColumn("span", texts.span_id(F.col("trace_parent")))
    rows = rows.withColumn("at", F.pmod(F.col("ordinal") - 1, F.lit(size)))
    got = rows.groupBy("partition", "batch").agg(
        F.count("*").alias("messages"), F.count("trace").alias("traced"), F.countDistinct("trace").alias("traces"),
        F.min_by("span", "ordinal").alias("first_span"), F.count_if(F.col("trace").isNotNull() & (F.col("at") < most_links)).alias("near"),
        F.collect_list(F.when((F.col("at") < most_links) & F.col("trace").isNotNull(), F.col("span"))).alias("spans"),
    )
    shared = (F.col("traces") == 1) & (F.col("traced") == F.col("messages"))
    links = F.when(shared, F.size(F.filter("spans", lambda s: s != F.col("first_span")))).otherwise(F.col("near"))
    return got.select("partition", "batch", "messages", "traces", F.when(shared, F.col("first_span")).alias("parent"), F.when(F.col("messages") == 1, 0).otherwise(links).cast("long").alias("links"))
