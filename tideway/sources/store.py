"""Topics as Parquet, partitioned by topic and partition; appends that happen once however often a batch is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "topic string, partition int, ms long, seq long, type string, key string, body binary, correlation_id string, trace_parent string, headers array<struct<key:string,value:string>>"


def completed(rows: DataFrame) -> DataFrame:
    """rows with all columns of an entry, those that are missing at their default."""
    defaults = {"correlation_id": F.lit(""), "trace_parent": F.lit(None).cast("string"), "headers": F.expr("cast(array() as array<struct<key:string,value:string>>)"), "key": F.lit(""), "body": F.lit("").cast("binary")}
    return rows.select(*[(F.coalesce(c, defaults[c]) if c in rows.columns and c in defaults else F.col(c) if c in rows.columns else defaults[c]).alias(c) for c in (x.split()[0] for x in COLUMNS.split(", "))])


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of entries. The batch has a folder of its own that is overwritten, so writing it again changes nothing."""
    completed(rows).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "partition", "batch").parquet(path)


def read(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """The entries of a store; topic, partition and ms prune what is read."""
    rows = spark.read.schema(f"{COLUMNS}, batch long").parquet(path)
    return rows.where(F.col("topic") == topic) if topic else rows


def outbox(state: DataFrame, entries: DataFrame, state_path: str, topic_path: str, batch: int, conditions: DataFrame | None = None) -> bool:
    """State and entries of a batch written under its number; nothing if a condition (name, expected, length) does not hold.

    State goes first: a batch that is repeated after a failure in between writes both again in place.
    """
    if conditions is not None and not conditions.where("expected <> length").isEmpty():
        return False
    state.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state_path)
    append(entries, topic_path, batch)
    return True
