"""Order inside partitions without a task that holds a whole partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Width in milliseconds of the spans that are numbered by one task.
SPAN_MS = 600_000


def numbered(rows: DataFrame, by: list[str], ms: str = "ms", seq: str = "seq", span_ms: int = SPAN_MS) -> DataFrame:
    """rows with ``ordinal`` (from 1, by ms and seq within ``by``) and ``total`` (rows of ``by``).

    Spans of time are counted first; their running sums, a small table, give each span its first number, and only the rows of
    a span are sorted together. A plain row_number() over the partition would sort all of it in one task.
    """
    spanned = rows.withColumn("__span", F.expr(f"`{ms}` div {span_ms}"))
    counts = spanned.groupBy(*by, "__span").agg(F.count("*").alias("__n"))
    all_of = Window.partitionBy(*by)
    sums = counts.select(*by, "__span", F.coalesce(F.sum("__n").over(all_of.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(all_of).alias("total"))
    own = F.row_number().over(Window.partitionBy(*by, "__span").orderBy(ms, seq))
    return spanned.join(sums, [*by, "__span"]).withColumn("ordinal", F.col("__before") + own).drop("__span", "__before")


def scanned(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], step: Callable, added: str, keep: list[str]) -> DataFrame:
    """A fold that looks at the rows of a key one after another: step(state, *values of ``uses``) -> (state, *values of ``added``);
    state is None at first. The result has the columns ``keep``, as they are, and the added ones.

    Rows are sorted and streamed, so a key of any size needs the memory of its state only; use it where the next step
    depends on the last, which no window function can express.
    """
    new = to_arrow_schema(StructType.fromDDL(added))
    schema = StructType([rows.schema[c] for c in keep] + list(StructType.fromDDL(added)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            of = [column(k).to_pylist() for k in keys]
            made = []
            for key, *values in zip(of[0] if len(of) == 1 else zip(*of, strict=True), *(column(c).to_pylist() for c in uses), strict=True):
                if key != at:
                    at, state = key, None
                state, *out = step(state, *values)
                made.append(out)
            columns = zip(*made, strict=True) if made else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(column(c) for c in keep), *(pa.array(c, f.type) for c, f in zip(columns, new, strict=True))], names=[*keep, *new.names])

    wanted = list(dict.fromkeys([*keys, *order, *uses, *keep]))
    return rows.select(*wanted).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def span_width(rows: DataFrame, column: str, most: int = 1_000_000) -> int:
    """Width of spans of a whole-number column such that evenly spread rows have about ``most`` in each."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    return max(1, (high - low + 1) // max(1, -(-n // most))) if n else 1


def previous(rows: DataFrame, by: list[str], order: str, value: str, width: int | None = None) -> DataFrame:
    """rows with ``before``: the value of the row before, by ``order`` within ``by``; null for the first.

    The last values of spans, a small table, are handed on to the next span, so that only the rows of a span are sorted together.
    """
    width = width or span_width(rows, order)
    spanned = rows.withColumn("__span", F.expr(f"`{order}` div {width}"))
    ends = spanned.groupBy(*by, "__span").agg(F.max_by(F.struct(value), order).alias("__end"))
    ends = ends.select(*by, "__span", F.lag("__end").over(Window.partitionBy(*by).orderBy("__span")).alias("__last"))
    own = F.lag(F.struct(value)).over(Window.partitionBy(*by, "__span").orderBy(order))
    return spanned.join(ends, [*by, "__span"]).withColumn("before", F.coalesce(own, "__last")[value]).select(*rows.columns, "before")
