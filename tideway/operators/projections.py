"""Events to keyed views: decoding by wire type, dispatch, buffered batches, idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.functions import ids
from tideway.operators.reader import batched


class EventTypes:
    """Wire types and the schemas of their JSON bodies, one to one."""

    def __init__(self, schemas: dict[str, T.StructType]):
        same = [a for a, s in schemas.items() for b, t in schemas.items() if a < b and s is t]
        if any(not k or not k.strip() for k in schemas) or same:
            raise ValueError("a wire type needs a name and a schema of its own")
        self.schemas = dict(schemas)

    def decoded(self, entries: DataFrame, body: str = "body") -> DataFrame:
        """entries with a nullable struct column for each wire type, and ``outcome``: ok, null, malformed or unknown."""
        text = F.col(body).cast("string")
        bad = F.lit("_bad")
        cols, states = {}, None
        for name, schema in self.schemas.items():
            value = F.from_json(text, T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
            broken = value.isNull() | (value["_bad"].isNotNull() & (F.trim(value["_bad"]) != "null"))
            is_null = value["_bad"].isNotNull() & (F.trim(value["_bad"]) == "null")
            own = F.col("type") == name
            cols[name] = F.when(own & ~broken & ~is_null, value.dropFields("_bad"))
            state = F.when(broken, "malformed").when(is_null, "null").otherwise("ok")
            states = F.when(own, state) if states is None else states.when(own, state)
        del bad
        return entries.withColumns(cols | {"outcome": states.otherwise("unknown") if states is not None else F.lit("unknown")})

    def handled(self, entries: DataFrame, body: str = "body") -> DataFrame:
        """What a typed handler gets: malformed and unknown bodies are dropped, JSON null stays."""
        return self.decoded(entries, body).where(F.col("outcome").isin("ok", "null"))


def outcomes(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("partition", "outcome").agg(F.count("*").alias("entries"))


def upserted(changes: DataFrame, key: str, value: str, deleted: str | None = None) -> DataFrame:
    """(key, value) as of the last change of each key; a key whose last change deletes it is gone."""
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    fields = [F.col(value).alias("value"), (F.col(deleted) if deleted else F.lit(False)).alias("deleted")]
    got = changes.groupBy(key).agg(F.max_by(F.struct(*fields), id_).alias("x"))
    return got.where(~F.coalesce("x.deleted", F.lit(False))).select(key, F.col("x.value").alias(value))


def projected(entries: DataFrame, view: Column, keep: Column | None = None) -> DataFrame:
    """(key, view, ms, seq): the view that the last kept entry of each key maps to."""
    rows = entries.where(keep) if keep is not None else entries
    id_ = ids.packed(F.col("ms"), F.col("seq"))
    got = rows.groupBy("key").agg(F.max_by(view, id_).alias("view"), F.max(id_).alias("last"))
    ms, seq = ids.unpacked(F.col("last"))
    return got.select("key", "view", ms.alias("ms"), seq.alias("seq"))


def dispatched(entries: DataFrame, bindings: dict[str, list[str]]) -> DataFrame:
    """(projection, type, events): each event goes to every projection bound to its type, in order of registration; others are skipped."""
    pairs = F.lit(None).cast("array<struct<at:int,projection:string>>")
    for name, projections in bindings.items():
        own = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(p).alias("projection")) for i, p in enumerate(projections)])
        pairs = F.when(F.col("type") == name, own).otherwise(pairs)
    return entries.select("*", F.explode(pairs).alias("x")).select("*", "x.at", "x.projection").drop("x")


def by_batch(entries: DataFrame, size: int, aggregates: list[Column]) -> DataFrame:
    """A batch projection: state buffered by batch and key, written once for each."""
    return batched(entries, size).groupBy("partition", "batch", "key").agg(*aggregates)


def in_batches(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch that leaves out a batch with no rows."""

    def run(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            write(rows, batch)

    return run
