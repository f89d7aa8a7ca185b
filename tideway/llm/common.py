"""Pieces that several operators share: batches of bounded size, ragged gathers, hashes, the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import weakref
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Characters of text that a worker turns into Python objects at a time.
SLICE_CHARS = 2_000_000


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive texts of about ``chars`` characters; a longer text makes a run of its own."""
    a = total = 0
    for b, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield a, b
            a, total = b, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .., one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes:
    """64-bit hashes of byte words, remembered up to a bound and then from the start again."""

    def __init__(self, bound: int = 250_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.bound:
            self.known.clear()
            new = set(words)
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(self.known.__getitem__, words), U64, len(words))


def texts_of(column) -> list[str]:
    """Python strings of an Arrow column; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_slices(column: pa.Array, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Runs [a, b) of an Arrow column of texts with their Python strings, made for one run at a time."""
    ends = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chars, side="right")))
        yield a, b, texts_of(column[a:b])
        a = b


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = f"file://{tempfile.gettempdir()}/tideway-shared"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, light: bool = False, frees: Iterable[DataFrame] = ()) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: no lineage, survives lost executors, known size.

    A light table, of a few numbers for each row and little work, goes to an eighth as many files as there are partitions.
    Tables in ``frees``, which nothing but this one reads, are deleted once it is written; what a result still reads is
    deleted when the driver ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if light:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    _left.setdefault(spark, set()).add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _at[out] = path
    freed(*frees)
    return out


_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: dict[SparkSession, set[str]] = {}


def freed(*tables: DataFrame) -> None:
    """Deletes tables that kept wrote and nothing reads any more."""
    for t in tables:
        if path := _at.pop(t, None):
            dropped(t.sparkSession, [path])


def dropped(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders that shared_dir named, through Spark's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        _left.get(spark, set()).discard(p)


@atexit.register
def _clean() -> None:
    for spark, paths in _left.items():
        with contextlib.suppress(Exception):  # the session may be gone
            dropped(spark, list(paths))


#: Rows of one key that a task takes as a matter of course, and most keys that are told to have more.
COMMON, HOT_KEYS = 1_000, 50_000


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str, left_rows: int | None = None) -> DataFrame:
    """left joined with right (one row a key, with column ``n``, the rows of left that have it) such that no key is one task.

    A key with more than COMMON rows, or a HOT_KEYS-th of all, is dealt into as many shares as it holds that many rows.
    There are at most HOT_KEYS such keys, whatever the input, so that they may be broadcast.
    """
    total = left.count() if left_rows is None else left_rows
    least = max(COMMON, total // HOT_KEYS)
    hot = right.where(F.col(n) > least).select(F.col(key).alias("__hot"), F.ceil(F.col(n) / least).cast("int").alias("__shares"))
    if hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)
    share = F.pmod(F.xxhash64(*left.columns), F.coalesce("__shares", F.lit(1))).cast("int")
    dealt = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__share", share).select(*left.columns, "__share")
    every = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1))).select(*right.columns, "__share")
    return dealt.join(every, [key, "__share"]).drop("__share")
