"""Near-duplicate linking that signatures of any kind share: bands, candidate pairs, verification, components.

Pairs are compared in two steps, so that a group of many like texts costs about one pair per text and not all pairs:

1. In each bucket (texts that agree in a band) every text is paired with the bucket's smallest id, its leader. Buckets and
   leaders with many texts are dealt into shares; a leader's multiset goes once to each share.
2. A text that is not connected with the leader of a bucket is compared with all members of that bucket that it is not
   connected with either. Buckets are compared block against block, never in one task; a pair is compared in the first
   band that it shares only, signatures leave out pairs that they make implausible, and the likeliest come first, so that
   what a link has connected need not be compared any more.

What a pair is held to is the caller's exact measure. At the end any two texts of one bucket are connected, or do not hold, or
their signatures make it implausible that they do: the components are those of all pairs of all buckets. They come from
alternating star contractions over tables in the shared folder, or from one task where the links are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import COMMON, HOT_KEYS, freed, kept, mix, spread_join

#: Texts of a bucket, and bytes of their bags, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 1_000, 16_000_000
#: Edges that one task contracts (two numbers each).
FEW = 2_000_000


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band for each row of an integer matrix with at least bands * rows columns."""
    s = sig[:, : bands * rows].astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * np.uint64(0x100000001B3) ^ s[:, :, r])
    return key.view(np.int64)


def buckets(sigs: DataFrame, dtype: str, bands: int, rows: int) -> DataFrame:
    """(key, id) for every band of every (id, sig binary); rows without a signature are in no bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = matrix(b.column(1), dtype)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig, bands, rows).ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), bands))], names=["key", "id"])

    return sigs.where("sig is not null").select("id", "sig").mapInArrow(run, "key long, id long")


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1) if rows else np.empty((0, 1), dtype)


def held(pairs: DataFrame, table: DataFrame, value: str, holds: Callable[[bytes, list[bytes]], np.ndarray]) -> DataFrame:
    """The pairs (a, b) of a written table for which holds(value of b, values of a), by ``table`` (id, value).

    Rows are streamed by b: its value goes once to each share of its partners, not to each partner.
    """
    n, degree = pairs.count(), pairs.groupBy("b").agg(F.count("*").alias("n"))
    least = max(COMMON, n // HOT_KEYS)  # so many b at most have more
    hot = F.broadcast(degree.where(F.col("n") > least).select(F.col("b").alias("hot"), F.ceil(F.col("n") / least).cast("int").alias("shares")))
    dealt = pairs.join(hot, F.col("b") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    asks = dealt.join(table.select(F.col("id").alias("a"), value), "a").select("b", "share", "a", value)
    centres = dealt.select("b", "share").distinct().join(table.select(F.col("id").alias("b"), value), "b").select("b", "share", F.lit(None).cast("long").alias("a"), value)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            b, share = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (share[1:] != share[:-1])])) if len(b) else ()
            for x, y in zip(first, [*first[1:], len(b)], strict=True):
                if not batch.column(2)[x].is_valid:  # a share starts with its centre
                    centre, x = batch.column(3)[x].as_py(), x + 1
                a, values = batch.column(2)[x:y], batch.column(3)[x:y].to_pylist()
                if values:
                    ok = pa.array(holds(centre, values), pa.bool_())
                    yield pa.RecordBatch.from_arrays([a.filter(ok), batch.column(0)[x:y].filter(ok)], names=["a", "b"])

    return asks.unionByName(centres).repartition("b", "share").sortWithinPartitions("b", "share", "a").mapInArrow(run, "a long, b long")


def classes(
    sigs: DataFrame,
    dtype: str,
    bands: int,
    rows: int,
    likeness: Callable[[np.ndarray, np.ndarray], np.ndarray],
    plausible: float,
    bags: Callable[[DataFrame], DataFrame],
    similarity: Callable[[bytes, list[bytes]], np.ndarray],
    least: float,
) -> DataFrame:
    """(id, root): for every id that a link connects, the smallest id that it is connected to.

    ``sigs`` is a written table (id, sig). ``bags`` makes a written table (id, bag binary) for those of the ids (id) that
    are in a bucket with others, and ``similarity`` compares one bag with others; a link has at least ``least``.
    """
    all_keys = buckets(sigs, dtype, bands, rows)
    led = kept(all_keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("members")).where("members > 1"), "leaders", light=True)
    keys = kept(spread_join(all_keys, led, "key", "members", sigs.count() * bands), "buckets", frees=[led])
    table = bags(keys.select("id").distinct())
    stars = kept(keys.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "stars", light=True)
    alike = lambda x, others: likeness(np.frombuffer(b"".join(others), dtype).reshape(len(others), -1), np.frombuffer(x, dtype)[None, :]) >= plausible
    likely = kept(held(stars, sigs, "sig", alike), "pairs", light=True, frees=[stars])
    first = kept(held(likely, table, "bag", lambda x, others: similarity(x, others) >= least), "links", frees=[likely])
    roots = components(first)
    dealt, members = blocks(keys.where("members > 2"), roots, table)
    cells = dealt.join(sigs, "id").join(table, "id")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        bucket, ids, root, asks, loose = key[0].as_py(), *(t.column(c).to_numpy() for c in ("id", "root", "asks", "loose"))
        asks, loose = asks.astype(bool), loose.astype(bool)
        sig, bag = matrix(t.column("sig").combine_chunks(), dtype), t.column("bag").to_pylist()
        k = band_keys(sig, bands, rows)
        band = int((k == bucket).sum(0).argmax())
        group = {r: r for r in root.tolist()}  # roots that links of this block connect

        def top(r: int) -> int:
            while group[r] != r:
                group[r] = r = group[group[r]]
            return r

        found: list[tuple[int, int]] = []
        others = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            # Of two loose texts the one of smaller id asks; a pair belongs to the first band that it shares.
            y = others[(root[others] != root[i]) & (~loose[others] | (ids[others] > ids[i]))]
            y = y[(k[y, :band] != k[i, :band]).all(1)] if band else y
            alike = likeness(sig[y], sig[i][None, :]) if len(y) else np.empty(0)
            y = y[np.lexsort((ids[y], -alike))][: int((alike >= plausible).sum())]
            at, size = 0, 1
            while at < len(y):
                some = [j for j in y[at : at + size] if top(int(root[j])) != top(int(root[i]))]
                for j in np.array(some, np.int64)[similarity(bag[i], [bag[j] for j in some]) >= least] if some else ():
                    p, q = top(int(root[i])), top(int(root[j]))
                    if p != q:
                        group[max(p, q)] = min(p, q)
                        found.append((max(int(ids[i]), int(ids[j])), min(int(ids[i]), int(ids[j]))))
                at, size = at + size, min(64, 2 * size)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    more = kept(cells.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "links", frees=[keys, table, members])
    if more.isEmpty():
        freed(first, more)
        return roots
    out = components(first.unionByName(more))
    freed(first, more, roots)
    return out


def blocks(keys: DataFrame, roots: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, i, j, id, root, asks, loose), and the written table that it reads: the texts that are not connected with their leader (loose) ask all members of the bucket.

    Loose texts are dealt into rows i of blocks and members into columns j, so that a block has about BLOCK texts or
    BLOCK_BYTES of bags of either.
    """
    led = keys.where("id = leader").select("key", "leader", "members").join(roots.select(F.col("id").alias("leader"), F.col("root").alias("leader_root")), "leader", "left").select("key", F.coalesce("leader_root", "leader").alias("leader_root"), "members")
    own = keys.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    n = keys.count()
    rows = spread_join(own, led, "key", "members", n).select("key", "id", "root", (F.col("root") != F.col("leader_root")).alias("loose"))
    sizes = table.select("id", F.octet_length("bag").alias("size"))
    rows = kept(rows.join(sizes, "id"), "members", light=True)
    number = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    counts = rows.groupBy("key").agg(F.count_if("loose").alias("n"), F.sum(F.when(F.col("loose"), F.col("size")).otherwise(0)).alias("b"), F.count("*").alias("m"), F.sum("size").alias("c"))
    counts = counts.where("n > 0").select("key", "m", number("n", "b").alias("is"), number("m", "c").alias("js"))
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = spread_join(rows, counts, "key", "m", n)
    asking = own.where("loose").select("key", "id", "root", "loose", F.lit(True).alias("asks"), mine("is").alias("i"), all_of("js").alias("j"))
    asked = own.select("key", "id", "root", "loose", F.lit(False).alias("asks"), all_of("is").alias("i"), mine("js").alias("j"))
    return asking.unionByName(asked), rows


def contracted(edges: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of edges (v, u) that one task may hold: labels sink along edges, and then along labels."""
    batches = list(edges)
    v, u = (np.concatenate([b.column(i).to_numpy() for b in batches] or [np.empty(0, np.int64)]) for i in range(2))
    ids, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    v, u, label = at[: len(v)], at[len(v) :], np.arange(len(ids))
    while True:
        low, before = np.minimum(label[v], label[u]), label.copy()
        for x in (label[v], label[u], v, u):
            np.minimum.at(label, x, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "root"])


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): for every id in ``pairs`` (a, b) the smallest id that it is connected to; a written table.

    Up to FEW edges are contracted by one task, more by alternating star contractions.
    """
    edges = kept(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "edges", light=True)
    n = edges.count()
    if n <= FEW:
        return kept(edges.coalesce(1).mapInArrow(contracted, "id long, root long"), "roots", light=True, frees=[edges])
    state = None
    while True:
        # Large star: every larger neighbour of a vertex moves to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("u > v"), low, "v", "n", n).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = kept(large, "edges", light=True, frees=[edges])
        # Small star: every smaller neighbour, and the vertex itself, moves to the smallest neighbour.
        low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "v", "n").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        edges = kept(small, "edges", light=True, frees=[large])
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, n = now, now[0]
    roots = edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
    return kept(roots, "roots", light=True, frees=[edges])
