"""Streams: entries read as they are written, handlers with error policies, views, claims with a lifetime, forwarding."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideway.operators import projections, reader
from tideway.sources import store


class Block(Exception):
    """A failure that must not be passed over: the batch is tried again until it works."""


def entries(spark: SparkSession, path: str, topic: str, types: list[str] | None = None, files: int | None = None) -> DataFrame:
    """The stream of a stored topic's entries of some types; ``files`` bounds a micro-batch."""
    source = spark.readStream.schema(f"{store.COLUMNS}, batch long")
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return source.parquet(path).where(F.col("topic") == topic).where(reader.types(types))


def handled(handler: Callable[[DataFrame, int], None], on_error: str = "best_effort", first_s: float = 1.0, most_s: float = 30.0, sleep: Callable[[float], None] = time.sleep, failed: list | None = None) -> Callable[[DataFrame, int], None]:
    """A handler for foreachBatch with an error policy: best_effort passes over a batch that fails, stop ends the query, so that
    a restart takes the same batch from the checkpoint. Block is retried with a doubling wait under either."""

    def run(rows: DataFrame, batch: int) -> None:
        wait = first_s
        while True:
            try:
                handler(rows, batch)
                return
            except Block:
                sleep(wait)
                wait = min(2 * wait, most_s)
            except Exception as e:
                if failed is not None:
                    failed.append((batch, str(e)))
                if on_error == "best_effort":
                    return
                raise

    return run


def start(rows: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs a handler over a stream: what is there (once), or on and on. The checkpoint is the consumer's position."""
    writer = rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Batches after which a view's changes are merged with it.
MERGED_EVERY = 16


def view_writer(path: str, merged_every: int = MERGED_EVERY) -> Callable[[DataFrame, int], None]:
    """Keeps a view (key, view, ms, seq) as Parquet: each batch writes what it changes, and every so many batches the changes and the
    last whole view are merged into a new one, after which they are deleted. A batch that is written again, or passed over,
    does no harm: the newest entry of a key counts wherever it stands."""

    def write(rows: DataFrame, batch: int) -> None:
        projections.projected(rows.select("key", "view", "ms", "seq"), F.col("view")).write.mode("overwrite").parquet(f"{path}/changes/{batch}")
        if (batch + 1) % merged_every == 0:
            spark = rows.sparkSession
            view(spark, path).write.mode("overwrite").parquet(f"{path}/whole/{batch}.new")
            fs, at = _fs(spark, path)
            fs.delete(at(f"{path}/whole/{batch}"), True)
            fs.rename(at(f"{path}/whole/{batch}.new"), at(f"{path}/whole/{batch}"))
            for kind in ("changes", "whole"):
                for n in _numbers(spark, f"{path}/{kind}"):
                    if n < batch or kind == "changes" and n == batch:
                        fs.delete(at(f"{path}/{kind}/{n}"), True)

    return write


VIEW = "key string, view string, ms long, seq long"


def view(spark: SparkSession, path: str) -> DataFrame:
    """The view that view_writer keeps: the last whole one with the changes since."""
    whole = max(_numbers(spark, f"{path}/whole"), default=None)
    parts = [f"{path}/whole/{whole}"] if whole is not None else []
    parts += [f"{path}/changes/{n}" for n in _numbers(spark, f"{path}/changes") if whole is None or n >= whole]
    if not parts:
        return spark.createDataFrame([], VIEW)
    return projections.projected(spark.read.parquet(*parts), F.col("view"))


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and what makes paths of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbered folders of a folder."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    return sorted(int(n) for s in fs.listStatus(at(path)) if (n := s.getPath().getName()).isdigit())


CLAIMED = "key string, ms long, seq long, won boolean"


def claims(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Claims (key, ms, seq, won) with a lifetime from the winning claim; the state of a key is one number.

    Rows of a key within a micro-batch are taken in order of id; across batches in the order of the source.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ms", "seq"])
        won = []
        for ms in pdf["ms"]:
            ok = until is None or ms >= until
            until = int(ms) + ttl_ms if ok else until
            won.append(ok)
        state.update((until,))
        yield pd.DataFrame({"key": key[0], "ms": pdf["ms"], "seq": pdf["seq"], "won": won})

    return rows.select("key", "ms", "seq").groupBy("key").applyInPandasWithState(step, CLAIMED, "until long", "append", GroupStateTimeout.NoTimeout)


def forwarder(target: str, topic: str, marks: dict[str, Any] | None = None) -> Callable[[DataFrame, int], None]:
    """Forwards a stream's entries to another topic under the batch's number: a batch that is run again overwrites itself."""

    def write(rows: DataFrame, batch: int) -> None:
        store.append(rows.withColumn("topic", F.lit(topic)), target, batch)
        if marks is not None:
            marks["batch"] = batch

    return write
