"""The partition of a message: an explicit one, else by the hash of its key, else round robin."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partition_of(key: str, partitions: int) -> int:
    """XXH3-64 of the key's UTF-8 bytes, modulo the number of partitions."""
    return xxhash.xxh3_64_intdigest(key.encode()) % partitions


@F.pandas_udf(T.DecimalType(20, 0))
def hash_of(keys: pd.Series) -> pd.Series:
    from decimal import Decimal

    return keys.map(lambda k: None if k is None else Decimal(xxhash.xxh3_64_intdigest(k.encode())))


def by_key(rows: DataFrame, partitions: int, key: str = "key", to: str = "partition") -> DataFrame:
    """rows with the partition of each key. The hash is no built-in function, so it is worked out in Arrow batches, once per row
    and without a shuffle; within a batch equal keys are hashed once."""

    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        own = {k: partition_of(k, partitions) for k in keys.unique()}
        return keys.map(own).astype("int32")

    return rows.withColumn(to, place(F.coalesce(F.col(key), F.lit(""))))


def round_robin(counter: Column, partitions: int) -> Column:
    """The slot of the counter-th message without a key (from 1: the counter is raised first)."""
    return F.pmod(counter, F.lit(partitions)).cast("int")
