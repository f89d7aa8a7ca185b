"""Best-fit packing of tokenised documents into sequences of fixed length, by a linear grouping scheme.

The plan needs only how many pieces there are of each length, at most ``capacity`` numbers, whatever the corpus:

1. Large lengths, in descending order, are cut into groups of equally many pieces, and rounded up to the largest
   of their group. For these few sizes the best fractional mix of configurations (which sizes share a sequence) comes
   from a linear programme with column generation; each configuration is used a whole number of times.
2. Actual pieces take the slots of their group, longest first, so a sequence keeps the room that rounding had taken.
3. What is left of the large pieces, and then all small ones, longest first, go to the sequence with the least room that
   still holds them, or open a new one: best fit, done for all sequences of equal content and all pieces of equal
   length at a time.

The plan is a table of slots: for a length, the pieces of ranks a..b go to sequences c..c+b-a at one offset. Its size
depends on the capacity alone. Pieces get their rank within their length from counts by shard, so that no task sees all
pieces of a length, and look their slot up.

Null text is the empty text, a document of the end token only. Repeated rows are packed each; extra columns are left out.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.common import kept, texts_of

CAPACITY = 2_048
#: The id behind each document.
END = 0
#: What is large, as a share of the capacity, and into how many groups it is cut. Few large lengths leave best fit more
#: choice, many leave configurations more; as a plan costs little, they are tried in turn and the best is kept.
SCHEMES = ((1 / 3, 96), (1 / 2, 96), (1 / 8, 192))
#: A plan is taken at once if it has at most so many sequences more than the tokens alone need, as a share.
NEAR = 0.001
#: Share of the room that small pieces could fill which configurations leave to them.
RESERVE = 0.9


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabulary files write for each byte: itself where it is printable, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, whose ids are the ranks of its merges, with its added tokens."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    of, special = byte_characters(), {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(of[c] for c in t): i for t, i in whole["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


_made: dict[str, tiktoken.Encoding] = {}


def cached(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    if path not in _made:
        _made[path] = tokenizer(path, pattern)
    return partial(_made[path].encode_to_numpy, allowed_special="all")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences but for the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached(path, pattern)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids = np.append(encode(text), END).astype("<u4") if text else np.array([END], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for o, v in zip(out, (i, k, start, length, zlib.crc32(ids[start : start + length].data)), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, and its value."""
    room = np.arange(capacity + 1)
    source = room[None, :] - sizes[:, None]
    value, taken = np.zeros(capacity + 1), []
    while True:
        offer = np.where(source >= 0, value[np.maximum(source, 0)] + worth[:, None], -1.0)
        pick = offer.argmax(0)
        better = np.maximum(value, offer[pick, room])
        taken.append(np.where(better > value + 1e-12, pick, -1))
        if (taken[-1] < 0).all():
            break
        value = better
    counts, c = np.zeros(len(sizes), np.int64), capacity
    for chosen in reversed(taken[:-1]):
        if chosen[c] >= 0:
            counts[chosen[c]] += 1
            c -= int(sizes[chosen[c]])
    return float(worth @ counts), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 600, gap: float = 2e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) with whole multiplicities that meet at most the demand, from the fractional optimum."""
    fits = capacity // sizes
    basis, x = np.diag(fits.astype(float)), demand / fits
    for _ in range(steps):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, pattern = best_pattern(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + gap:
            break
        way = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        basis[:, out] = pattern
    return [(np.rint(basis[:, i]).astype(np.int64), int(np.floor(x[i] + 1e-9))) for i in range(len(sizes)) if x[i] >= 1 - 1e-9]


@dataclass
class Block:
    """Sequences first .. first+count-1 of equal content: slots (length, rank of the first sequence's piece, offset)."""

    first: int
    count: int
    used: int = 0
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> tuple[Block, Block]:
        """The first n sequences and the others."""
        return Block(self.first, n, self.used, list(self.slots)), Block(self.first + n, self.count - n, self.used, [(a, r + n, o) for a, r, o in self.slots])

    def add(self, length: int, rank: int) -> None:
        self.slots.append((length, rank, self.used))
        self.used += length


class Planner:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {a: n for a, n in histogram.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.done: list[Block] = []
        self.open: dict[int, deque[Block]] = {}  # by room left

    def take(self, length: int, n: int) -> int:
        """Ranks of n pieces of a length: the first of them."""
        r = self.rank[length]
        self.rank[length] += n
        self.left[length] -= n
        return r

    def new(self, count: int) -> Block:
        b = Block(self.sequences, count)
        self.sequences += count
        return b

    def keep(self, b: Block) -> None:
        room = self.capacity - b.used
        if room:
            self.open.setdefault(room, deque()).append(b)
        else:
            self.done.append(b)

    def group(self, large: float, groups: int) -> None:
        """Steps 1 and 2."""
        lengths = sorted((a for a in self.left if self.capacity * large < a < self.capacity), reverse=True)
        total = sum(self.left[a] for a in lengths)
        if not total:
            return
        per = -(-total // groups)
        members: list[list[list[int]]] = []  # of each group: [length, pieces], longest first
        room = 0
        for a in lengths:
            n = self.left[a]
            while n:
                if not room:
                    members.append([])
                    room = per
                k = min(n, room)
                members[-1].append([a, k])
                n, room = n - k, room - k
        # Groups of one size are one group.
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(sorted(merged, reverse=True))
        supply = [deque(merged[s]) for s in sizes]
        demand = np.array([float(sum(n for _, n in g)) for g in supply])
        # Small pieces fill what room configurations leave; where there are enough of them, configurations leave it.
        small = sum(a * n for a, n in self.left.items() if a <= self.capacity * large)
        share = small / (small + sum(a * self.left[a] for a in lengths))
        room = max(int(sizes[0]), self.capacity - int(self.capacity * share * RESERVE))
        for pattern, times in configurations(sizes, demand, room):
            times = min([times, *(sum(n for _, n in supply[i]) // pattern[i] for i in np.flatnonzero(pattern))])
            blocks = [self.new(times)] if times else []
            for i in np.flatnonzero(pattern):
                for _ in range(pattern[i]):
                    filled = []
                    for b in blocks:
                        while b is not None:
                            head = supply[i][0]
                            n = min(b.count, head[1])
                            part, b = b.split(n) if n < b.count else (b, None)
                            part.add(head[0], self.take(head[0], n))
                            head[1] -= n
                            if not head[1]:
                                supply[i].popleft()
                            filled.append(part)
                    blocks = filled
            for b in blocks:
                self.keep(b)

    def best_fit(self) -> None:
        """Step 3."""
        for a in sorted(self.left, reverse=True):
            n = self.left[a]
            while n:
                room = min((r for r in self.open if r >= a), default=None)
                if room is None:
                    each = min(self.capacity // a, n)
                    b = self.new(n // each)
                else:
                    b = self.open[room].popleft()
                    if not self.open[room]:
                        del self.open[room]
                    each = min(room // a, n)
                    if b.count * each > n:
                        b, rest = b.split(n // each)
                        self.keep(rest)
                for _ in range(each):
                    b.add(a, self.take(a, b.count))
                n -= each * b.count
                self.keep(b)

    def table(self) -> np.ndarray:
        """[slots, 5]: length, first rank, number of ranks, first sequence, offset; by length and rank."""
        blocks = self.done + [b for q in self.open.values() for b in q]
        rows = np.array([(a, r, b.count, b.first, o) for b in blocks for a, r, o in b.slots], np.int64).reshape(-1, 5)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[float, int], ...] = SCHEMES) -> np.ndarray:
    """Slots for all pieces of a histogram of lengths: of the schemes' plans, the first with the fewest sequences."""
    best, least = None, -(-sum(a * n for a, n in histogram.items()) // capacity)
    for large, groups in schemes:
        p = Planner(histogram, capacity)
        if n := p.left.get(capacity):
            whole = p.new(n)
            whole.add(capacity, p.take(capacity, n))
            p.keep(whole)
        p.group(large, groups)
        p.best_fit()
        if best is None or p.sequences < best.sequences:
            best = p
        if best.sequences <= least * (1 + NEAR):
            break
    return best.table()


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    shards = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = kept(pieces(docs, path, pattern, capacity).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")), "pieces")
    counts = kept(cut.groupBy("length", "shard").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("own", own).join(before, ["length", "shard"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            row = t[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
