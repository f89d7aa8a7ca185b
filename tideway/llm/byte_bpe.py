"""Byte-level BPE over padded numpy matrices.

Words of like length form the rows of one matrix. Each round, every row merges its leftmost pair of minimum rank: the
ranks of all pairs come from an open-addressing hash table, the argmin of a row is its merge, and the matrix is then
compacted by one column (each live row loses exactly one element) and by the rows that have no pair left. Words met
before come from a bounded store, so that matrices hold new words only. Words above LONGEST bytes, for which a round
per merge would cost the square of the length, take a heap instead: the same merges in n log n.

Null text is the empty text and has no ids. Repeated rows are encoded each; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tideway.llm.common import ragged, slices, texts_of

NONE = np.int32(2**31 - 1)
LONGEST = 256
WIDTHS = np.array([*range(2, 17), 24, 32, 48, 64, 96, 128, 192, LONGEST])
STORE_WORDS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the joined token, for every split of every token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, r = (np.array(c, dtype=np.uint64) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.uint64),) * 3
        keys = (a << np.uint64(32)) | b
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.iinfo(np.uint64).max
            claim, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[claim], self.values[claim] = keys[won], r[won].astype(np.int32)
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the joined tokens, NONE where there is none; a negative id is padding."""
        keys = (a.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        shape, keys = keys.shape, keys.ravel()
        slot = self.slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        left = np.flatnonzero((there != keys) & (there != np.iinfo(np.uint64).max))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != np.iinfo(np.uint64).max)]
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for one rank file; ``pattern`` splits a text into the words that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, bound: int = STORE_WORDS):
        self.ranks, self.find, self.bound = ranks, regex.compile(pattern).findall, bound
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for t, r in ranks.items():
            lengths[r] = len(t)
        self.byte_len, self.byte_at = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        by_rank = {r: t for t, r in ranks.items()}
        self.bytes = np.frombuffer(b"".join(by_rank.get(i, b"") for i in range(size)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.at, self.len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merged(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fully merged rows of ``m`` (padding: negative), padded by -1, and their lengths."""
        out, row = np.full(m.shape, -1, np.int32), np.arange(len(m))
        ranks = self.pairs(m[:, :-1], m[:, 1:])
        while True:
            n, w = m.shape
            at = np.arange(n)
            p = ranks.argmin(1) if w > 1 else np.zeros(n, np.int64)
            best = ranks[at, p] if w > 1 else np.full(n, NONE)
            live = best != NONE
            if not live.all():
                out[row[~live], :w] = m[~live]
                row, m, ranks, p, best = row[live], m[live], ranks[live], p[live], best[live]
                n = len(m)
                at = np.arange(n)
            if not n:
                return out, (out >= 0).sum(1)
            m[at, p] = best
            stay = np.ones((n, w), bool)
            stay[at, p + 1] = False
            m = m[stay].reshape(n, w - 1)
            stay = np.ones((n, w - 1), bool)
            stay[at, p] = False
            ranks = ranks[stay].reshape(n, w - 2)
            r, l = np.flatnonzero(p < w - 2), np.flatnonzero(p > 0)  # noqa: E741
            ranks[r, p[r]] = self.pairs(m[r, p[r]], m[r, p[r] + 1])
            ranks[l, p[l] - 1] = self.pairs(m[l, p[l] - 1], m[l, p[l]])

    def by_heap(self, word: bytes) -> list[int]:
        """The same merges for one long word, by a heap of (rank, position)."""
        n, ranks = len(word), self.ranks
        end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid = end[i]
            if gone[i] or mid >= n or end[mid] != e:
                continue
            gone[mid], end[i] = 1, e
            if e < n:
                before[e] = i
                if (r := ranks.get(word[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (b := before[i]) >= 0 and (r := ranks.get(word[b:e])) is not None:
                heapq.heappush(heap, (r, b, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new words into the store."""
        raw = [w.encode() for w in words]
        found: list[np.ndarray | list[int] | None] = [None] * len(raw)
        todo: list[int] = []
        for i, w in enumerate(raw):
            if (whole := self.ranks.get(w)) is not None:
                found[i] = [whole]
            elif len(w) > LONGEST:
                found[i] = self.by_heap(w)
            else:
                todo.append(i)
        sizes = np.array([len(raw[i]) for i in todo], np.int64)
        bucket = np.searchsorted(WIDTHS, sizes)
        lengths = np.array([len(f) if f is not None else 0 for f in found], np.int64)
        parts, owner = [np.array(list(chain.from_iterable(f for f in found if f is not None)), np.int32)], [np.array([i for i, f in enumerate(found) if f is not None], np.int64)]
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            m = np.full((len(own), WIDTHS[b]), -1, np.int32)
            m[np.arange(WIDTHS[b]) < sizes[own][:, None]] = self.of_byte[np.frombuffer(b"".join(raw[todo[i]] for i in own), np.uint8)]
            ids, n = self.merged(m)
            which = np.array([todo[i] for i in own])
            lengths[which] = n
            parts.append(ids[ids >= 0])
            owner.append(which)
        which = np.concatenate(owner)
        at = np.empty(len(words), np.int64)
        at[which] = np.cumsum(lengths[which]) - lengths[which] + len(self.ids)
        base = len(self.codes)
        self.codes.update(zip(words, range(base, base + len(words)), strict=True))
        self.ids, self.at, self.len = np.concatenate([self.ids, *parts]), np.concatenate([self.at, at]), np.concatenate([self.len, lengths])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        words = [self.find(t) for t in texts]
        flat = list(chain.from_iterable(words))
        new = set(flat).difference(self.codes)
        if len(self.codes) + len(new) > self.bound:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        code = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        size = self.len[code]
        before = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        return self.ids[ragged(self.at[code], size)], np.diff(before[edge])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ids, one after another, and how many each run has."""
        size = self.byte_len[ids]
        before = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[ragged(self.byte_at[ids], size)], np.diff(before[edge])


def encoder(path: str, pattern: str) -> Callable[[], ByteBPE]:
    """Makes the encoder once per worker, when it is first needed."""
    made: dict[str, ByteBPE] = {}

    def get() -> ByteBPE:
        if path not in made:
            made[path] = ByteBPE(read_ranks(path), pattern)
        return made[path]

    return get


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    get = encoder(ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                ids, n = get().encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes binary) of every array of ids; a null array has no bytes."""
    get = encoder(ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            raw, n = get().decode(np.concatenate([*rows, np.empty(0, np.int64)]), np.array([len(x) for x in rows], np.int64))
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=[id_column, "bytes"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes, decodes the ids again, and returns the digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    get = encoder(ranks_path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts):
                bpe = get()
                ids, n = bpe.encode(texts[a:b])
                raw, m = bpe.decode(ids, n)
                le, i, j = ids.astype("<u4"), np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(m)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(le[x:y].data).hexdigest() for x, y in zip(i, i[1:], strict=False)], pa.string()),
                        pa.array([hashlib.sha256(raw[x:y].data).hexdigest() for x, y in zip(j, j[1:], strict=False)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
