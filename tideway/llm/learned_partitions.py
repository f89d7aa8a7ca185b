"""Approximate nearest neighbours by learned partitions of a neighbour graph.

A sample of the vectors, those of smallest id hash and at most ``sample_rows``, gives an exact neighbour graph. The graph
is cut into balanced parts: parts grow one after another from a vertex, each taking the free vertex with most edges
into it, and are then refined by moving vertices to the part that most of their neighbours are in, within the capacity.
A small network learns from the vertices the parts that their neighbours are in. It assigns every vector of the table
to its most probable part, and sends a query to as many of its most probable parts as the sample needs for
TARGET recall. There the query meets all vectors of the part and keeps its nearest by exact distance.

The number of parts grows with the vectors. One network tells MOST_PARTS apart; with more, each part is cut again by a
network of its own, learned from a sample of that part by as many tasks as there are parts. A query goes from its most
probable parts to the most probable ones in them.

Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query, as ties go to the smaller id; the
others are left out of the parts, so copies do not make a part large. A part that is large all the same is searched in
blocks by as many tasks.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those of another dimension
than most, whose distance is not defined. Rows that repeat an id are rows of their own: each is a candidate for the others
and, where the id is asked for, a query. The empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.common import kept

SAMPLE_ROWS = 10_000
#: Vectors that a part is meant to hold, the most parts that one network tells apart, and vectors of a sample for each at least.
PART_ROWS, MOST_PARTS, SAMPLED = 500, 256, 16
#: Rows of a part that one task searches.
BLOCK_ROWS = 4_000
GRAPH_DEGREE = 10
#: Share of the nearest neighbours that routed queries find among the sample.
TARGET = 0.97
#: A query goes to more parts until they hold at least so many vectors.
LEAST_CANDIDATES = 64


@dataclass
class Router:
    """The network (64 hidden units, by default) and how many parts a query goes to."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray
    scale: float
    probes: int

    @property
    def parts(self) -> int:
        return self.layers[-1][1].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = (x.astype(np.float64) - self.mean) / self.scale
        for w, b in self.layers[:-1]:
            h = np.maximum(h @ w + b, 0)
        w, b = self.layers[-1]
        return h @ w + b

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first; ties to the smaller number."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def nearest(x: np.ndarray, y: np.ndarray, k: int, block: int = 500) -> np.ndarray:
    """Positions in y of the k nearest of each row of x (its own row, if x is y, may be among them)."""
    out, norms = [], (y * y).sum(1)
    for a in range(0, len(x), block):
        d = norms - 2 * x[a : a + block] @ y.T
        near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 8) -> np.ndarray:
    """Part of each vertex of a directed neighbour graph [n, degree], no part above ``slack`` times the mean."""
    n = len(graph)
    capacity = int(np.ceil(n / parts * slack))
    edges = [set(row.tolist()) - {i} for i, row in enumerate(graph)]
    for i, row in enumerate(graph):
        for j in row.tolist():
            if j != i:
                edges[j].add(i)
    label, size = np.full(n, -1), np.zeros(parts, np.int64)
    goal, free, cursor = int(np.ceil(n / parts)), n, 0
    for p in range(parts):
        frontier: dict[int, int] = {}
        while size[p] < goal and free:
            if frontier:
                v = max(frontier, key=lambda u: (frontier[u], -u)) if len(frontier) < 64 else max(list(frontier)[:256], key=frontier.__getitem__)
                del frontier[v]
            else:
                while label[cursor] >= 0:
                    cursor += 1
                v = cursor
            label[v], size[p], free = p, size[p] + 1, free - 1
            for u in edges[v]:
                if label[u] < 0:
                    frontier[u] = frontier.get(u, 0) + 1
    near = [np.fromiter(e, np.int64, len(e)) for e in edges]
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            if len(near[v]):
                votes = np.bincount(label[near[v]], minlength=parts)
                votes[(size >= capacity) & (np.arange(parts) != label[v])] = -1
                best = int(votes.argmax())
                if votes[best] > votes[label[v]]:
                    size[label[v]] -= 1
                    size[best] += 1
                    label[v] = best
                    moved += 1
        if moved < n // 200:
            break
    return label


def train(x: np.ndarray, goal: np.ndarray, hidden: int = 64, epochs: int = 40, seed: int = 7) -> Router:
    """A network with one hidden layer, by Adam on the cross entropy against rows of probabilities."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), float(x.std()) or 1.0
    h0 = (x - mean) / scale
    sizes = [x.shape[1], hidden, goal.shape[1]]
    params = [p for a, b in zip(sizes, sizes[1:], strict=False) for p in (rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b))]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            own = order[a : a + 256]
            z = h0[own]
            h = np.maximum(z @ params[0] + params[1], 0)
            logits = h @ params[2] + params[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - goal[own]) / len(own)
            back = (g @ params[2].T) * (h > 0)
            t += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for i, slope in enumerate((z.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * slope
                v[i] = 0.999 * v[i] + 0.001 * slope * slope
                params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router([(params[0], params[1]), (params[2], params[3])], mean, scale, 1)


def fit(x: np.ndarray, parts: int, k: int = 10, target: float = TARGET, n: int | None = None) -> Router:
    """A router for ``parts`` parts from a sample of ``n`` vectors (None: of itself)."""
    x = x.astype(np.float64)
    parts = max(1, min(parts, len(x) // SAMPLED))
    if parts == 1:
        d = x.shape[1]
        return Router([(np.zeros((d, 1)), np.zeros(1))], np.zeros(d), 1.0, 1)
    graph = nearest(x, x, GRAPH_DEGREE + 1)
    label = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    for c in range(graph.shape[1]):
        np.add.at(goal, (np.arange(len(x)), label[graph[:, c]]), 1 / graph.shape[1])
    router = train(x, goal)
    # As many parts as the sample's own neighbours, placed as the index places them, need for the target. Of the k nearest
    # of n vectors about k * len(x) / n are in the sample.
    k = max(1, -(-k * len(x) // (n or len(x))))
    asked = np.arange(0, len(x), max(1, len(x) // 1000))
    near = nearest(x[asked], x, k + 1)
    order, placed = router.order(x), router.order(x)[:, 0]
    rank = np.argsort(order[asked], axis=1)[np.arange(len(asked))[:, None], placed[near]]
    found = [(rank < m).mean() for m in range(1, parts + 1)]
    router.probes = next((m for m, share in enumerate(found, 1) if share >= target), parts)
    return router


@dataclass
class Tree:
    """A network over the whole and, where one is not enough, a network for each of its parts; leaves are numbered by both."""

    root: Router
    below: dict[int, Router]
    wide: int  # leaves that a part of the root may have

    @property
    def leaves(self) -> int:
        return self.root.parts * self.wide

    def place(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of each vector."""
        if not len(x):
            return np.empty(0, np.int64)
        leaf = self.root.order(x)[:, 0] * self.wide
        for p, router in self.below.items():
            own = np.flatnonzero(leaf == p * self.wide)
            if len(own):
                leaf[own] += router.order(x[own])[:, 0]
        return leaf

    def ways(self, x: np.ndarray, sizes: np.ndarray) -> Iterator[list[int]]:
        """The leaves that each vector goes to; more of them until they hold LEAST_CANDIDATES vectors."""
        order = self.root.order(x) if len(x) else np.empty((0, 1), np.int64)
        inside = {p: (r.order(x), r.probes) for p, r in self.below.items()} if len(x) else {}
        for i, parts in enumerate(order):
            out, spare, held = [], [], 0
            for m, p in enumerate(parts.tolist()):
                if m >= self.root.probes and held >= LEAST_CANDIDATES:
                    break
                subs, probes = (inside[p][0][i].tolist(), inside[p][1]) if p in inside else ([0], 1)
                leaves = [p * self.wide + s for s in subs]
                out += leaves[:probes]
                spare += leaves[probes:]
                held += int(sizes[leaves[:probes]].sum())
            for leaf in spare:
                if held >= LEAST_CANDIDATES:
                    break
                out.append(leaf)
                held += int(sizes[leaf])
            yield out


def parts_for(n: int) -> int:
    """How many parts n vectors are cut into by one network: PART_ROWS each, two at least where a sample can tell them apart."""
    return max(2, min(MOST_PARTS, -(-n // PART_ROWS))) if n >= 2 * SAMPLED else 1


def grow(rows: DataFrame, n: int, k: int, sample_rows: int) -> Tree:
    """A tree for the n written rows (vec_id, vector); what comes to the driver is bounded by the sample and MOST_PARTS."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample_rows, n)).select("vector").toPandas()["vector"]
    x = np.array(sample.tolist(), np.float64).reshape(len(sample), -1)
    levels = 1 if n <= MOST_PARTS * PART_ROWS else 2
    root = fit(x, parts_for(n), k, TARGET ** (1 / levels), n)
    if levels == 1:
        return Tree(root, {}, 1)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = block_of(b.column(1))
            part = root.order(v)[:, 0] if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(part.astype(np.int32)), b.column(2)], names=["vector", "part", "drawn"])

    # Each part's sample: by a hash of the id, so many as make the sample of a part of mean size.
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40)) < int(min(1.0, sample_rows * root.parts / n) * (1 << 40))
    parted = rows.select("vec_id", "vector", drawn.alias("drawn")).mapInArrow(place, "vector array<double>, part int, drawn boolean")
    sizes = {r["part"]: r["count"] for r in parted.groupBy("part").count().collect()}
    parts = {p: parts_for(size) for p, size in sizes.items()}

    def train_part(key: tuple, t: pa.Table) -> pa.Table:
        p = key[0].as_py()
        router = fit(block_of(t.column("vector").combine_chunks()), parts[p], k, TARGET ** (1 / levels), sizes[p])
        return pa.table({"part": pa.array([p], pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary())})

    got = parted.where("drawn").groupBy("part").applyInArrow(train_part, "part int, router binary").collect()
    return Tree(root, {r["part"]: pickle.loads(r["router"]) for r in got}, MOST_PARTS)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("vector", lambda c: c != 0))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (most["d"] if most else 0))


def block_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row for which the column ``is_query`` (over vec_id) is true."""
    spark = vectors.sparkSession
    rows = kept(usable(vectors, id_column, vector_column), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = spark.sparkContext.broadcast(grow(rows, n, k, sample_rows))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.place(block_of(b.column(2))).astype(np.int32))], names=["row", "vec_id", "vector", "part"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    placed = kept(numbered.mapInArrow(place, "row long, vec_id long, vector array<double>, part int"), "placed", frees=[rows])
    nth = F.row_number().over(Window.partitionBy("part", "vector").orderBy("vec_id", "row"))
    base = kept(placed.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "candidates")
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in base.groupBy("part").count().collect():  # a row a part
        sizes[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, part, block = [], [], []
            for i, leaves in enumerate(tree.value.ways(block_of(b.column(2)), sizes)):
                for p in leaves:
                    where += [i] * int(blocks[p])
                    part += [p] * int(blocks[p])
                    block += range(int(blocks[p]))
            take = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array([True] * len(part), pa.bool_())], names=["row", "vec_id", "vector", "part", "block", "asks"])

    schema = "row long, vec_id long, vector array<double>, part int, block int, asks boolean"
    asked = placed.where(is_query).select("row", "vec_id", "vector").mapInArrow(route, schema)
    several = {int(p): int(blocks[p]) for p in np.flatnonzero(blocks > 1)}
    count = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("int") for pair in several.items() for x in pair)), F.col("part")), F.lit(1)) if several else F.lit(1)
    held = base.withColumn("block", F.pmod(F.xxhash64("row"), count).cast("int")).withColumn("asks", F.lit(False))

    def meet(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        row, ids, x = t.column("row").to_numpy(), t.column("vec_id").to_numpy(), block_of(t.column("vector").combine_chunks())
        base, base_ids, base_rows = x[~asks], ids[~asks], row[~asks]
        out: list[list[np.ndarray]] = [[], [], [], []]
        norms, q = (base * base).sum(1), x[asks]
        for first in range(0, len(q) if len(base) else 0, 256):
            some = q[first : first + 256]
            own = (some * some).sum(1)
            rough = norms - 2 * some @ base.T + own[:, None]
            error = 1e-10 * (own + norms.max())
            for v, r, i, d, e in zip(some, row[asks][first : first + 256], ids[asks][first : first + 256], rough, error, strict=True):
                ok = np.flatnonzero(base_rows != r)
                if len(ok) > k and np.isfinite(d).all():  # else every distance is worked out
                    ok = ok[d[ok] <= np.partition(d[ok], k - 1)[k - 1] + 2 * e]
                exact = np.sqrt(((base[ok] - v) ** 2).sum(1))
                best = np.lexsort((base_ids[ok], exact))[:k]
                for o, a in zip(out, (np.full(len(best), r), np.full(len(best), i), base_ids[ok][best], exact[best]), strict=True):
                    o.append(a)
        a, b, c, d = (np.concatenate([*o, np.empty(0, kind)]) for o, kind in zip(out, (np.int64, np.int64, np.int64, np.float64), strict=True))
        return pa.table({"row": a, "query_id": b, "vec_id": c, "score": d})

    met = held.select("row", "vec_id", "vector", "part", "block", "asks").unionByName(asked).groupBy("part", "block").applyInArrow(meet, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
