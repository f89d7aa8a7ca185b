"""Interpolated modified Kneser-Ney model of any order from two on, counted in Spark, stored as sorted arrays that workers memory-map.

Words are known by a 64-bit hash. Three passes of tasks write one shard per bucket into the shared folder:

1. Words: tasks count their own words and send each bucket of hashes one packed block; a bucket's task merges the
   blocks into a sorted array of hashes with counts. A word's id is its rank in hash order.
2. Pairs: tasks count (previous id, id), scrambled one to one into a key, and send packed blocks by its first bits, so that
   a frequent word spreads over all buckets; a bucket's task merges them into a sorted array with counts.
   From order three on, tasks count whole n-grams instead, and a bucket holds all followers of a context: it writes them
   and sends the n-grams' endings, one word shorter, to the next lower order; the last ones are the pairs. N-grams below
   the highest order count behind how many words they stand, at the start of a text how often they occur there.
   A key's first bits are its shard, the next ones its place in a table of offsets, and only the rest is stored: 32 bits
   for vocabularies of millions of words.
3. Words again: each pair shard sends, by ranges of ids, what it knows of a word as context (how often, and followed by
   how many words once, twice, more often) and as continuation (behind how many words).

Only sums over all words come to the driver: tokens, vocabulary, counts of counts. Every pass covers all training rows.
Scoring maps the shards and looks up a batch's distinct words and pairs in sorted order.

Text is lower-cased in A-Z and split at ASCII white space; each text has an end token and starts in a context of its
own. An unknown word has the share of the unigrams' discount that one word of V + 1 gets. Null text is the empty text,
which has its end token only. Repeated rows count as often as they occur; extra columns are left out. Without training
rows every token is unknown and each has probability 1.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import mix, shared_dir, text_slices

END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
#: Entries that a task gathers before it sends them.
GATHERED = 4_000_000
KNOWN_WORDS = 400_000
#: Keys that share a place in a table of offsets; followers of a context whose sums are not stored.
PLACED, SUMMED = 16, 4


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a block: byte planes, compressed."""
    raw = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(block: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.decompress(block[8:], n * sum(np.dtype(k).itemsize for k in kinds), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * k.itemsize].reshape(k.itemsize, n).T).reshape(-1).view(k))
        at += n * k.itemsize
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def tally(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of n: small n as repeated numbers, as plain numbers sort fastest."""
    few = n <= 8
    k, c = counted(np.repeat(numbers[few], n[few]))
    if not few.all():
        more, m = summed(numbers[~few], n[~few])
        at = np.searchsorted(k, more)
        same = np.zeros(len(more), bool)
        inside = at < len(k)
        same[inside] = k[at[inside]] == more[inside]
        c[at[same]] += m[same]
        k, c = np.insert(k, at[~same], more[~same]), np.insert(c, at[~same], m[~same])
    return k, c


def put(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes each array as file ``path.name``, whole or not at all; a repeated task writes the same bytes."""
    for name, a in arrays.items():
        at = f"{path}.{name}"
        if urlsplit(at).scheme in ("", "file"):
            at = unquote(urlsplit(at).path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            own = f"{at}.{os.getpid()}.{os.urandom(4).hex()}"
            with open(own, "wb") as f:
                f.write(a.data if a.size else b"")
            os.replace(own, at)
        else:
            fs, at = pafs.FileSystem.from_uri(at)
            with fs.open_output_stream(at) as f:
                f.write(a.tobytes())


def mapped(path: str, kind: str, columns: int = 1) -> np.ndarray:
    """An array written by put, mapped into memory (from a store without files: read)."""
    if urlsplit(path).scheme in ("", "file"):
        at = unquote(urlsplit(path).path)
        a = np.asarray(np.memmap(at, kind, "r")) if os.path.getsize(at) else np.empty(0, kind)
    else:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            a = np.frombuffer(f.read(), kind)
    return a.reshape(-1, columns) if columns > 1 else a


@dataclass(frozen=True)
class Model:
    """What the driver knows of a written model."""

    folder: str
    bits: int  # 2 ** bits shards
    offsets: tuple[int, ...]  # id of the first word of each shard, and the vocabulary's size
    tokens: int
    discounts: tuple[tuple[float, float, float], ...]  # of words, of pairs, of longer n-grams
    continuations: int
    word_mass: float  # discount that all words leave, as a share

    @property
    def vocabulary(self) -> int:
        return self.offsets[-1]

    @property
    def id_shift(self) -> int:
        return max(0, (self.vocabulary + 1).bit_length() - self.bits)

    @property
    def id_bits(self) -> int:
        """Bits of an id, those that stand for a start and before it included."""
        return (self.vocabulary + 2).bit_length()


class Shards:
    """The mapped shards of a model, opened as they are needed; one instance in each worker."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}
        self.forget()

    def forget(self) -> None:
        """Remembered words: their slots, and by slot their ids and, where asked for, what is known about them."""
        self.known: dict[bytes, int] = {}
        self.ids_of, self.facts_of = np.empty(0, np.int64), np.empty((0, 6), np.int64)

    def shard(self, name: str, s: int, kind: str, columns: int = 1) -> np.ndarray:
        key = (name, s)
        if key not in self.open:
            self.open[key] = mapped(f"{self.model.folder}/{name.split('.')[0]}-{s:05d}.{name.split('.')[1]}", kind, columns)
        return self.open[key]

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids (-1: unknown) of sorted hashes."""
        m, ids = self.model, np.full(len(hashes), -1, np.int64)
        shard = (hashes >> np.uint64(64 - m.bits)).astype(np.int64)
        for s, a, b in runs(shard):
            keys = self.shard("word.hash", s, "<u8")
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                ids[a:b] = np.where(keys[at] == hashes[a:b], m.offsets[s] + at, -1)
        return ids

    def slots(self, words: list[bytes], facts: bool = False) -> np.ndarray:
        """Slots of words; remembered up to a bound, and then from the start again."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.forget()
            missing = np.arange(len(words))
        some = list(dict.fromkeys(words[i] for i in missing.tolist()))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, some), np.uint64, len(some))
        order = np.argsort(h)
        found = np.empty(len(some), np.int64)
        found[order] = self.find_words(h[order])
        self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
        self.ids_of = np.concatenate([self.ids_of, found])
        if facts:
            self.facts_of = np.concatenate([self.facts_of, self.about(found)])
        at[missing] = np.fromiter((self.known[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return at

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 where unknown."""
        at = self.slots(words)
        return self.ids_of[at]

    def end_id(self) -> int:
        return int(self.find_words(np.array([END], np.uint64))[0])

    def find(self, table: str, keys: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, rows, where, place in the table of offsets) for the keys that a table of keys has."""
        bits = self.model.bits
        shard = (keys >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
        for s, a, b in runs(shard[order]):
            offsets = self.shard(f"{table}.offset", s, "<u4")
            wide = (len(offsets) - 1).bit_length() - 1
            small = width - bits - wide <= 32
            stored = self.shard(f"{table}.low", s, "<u4" if small else "<u8")
            if not len(stored):
                continue
            rows = order[a:b]
            own = keys[rows]
            place = place_of(own, wide, bits).astype(np.int64)
            low, high = offsets[place].astype(np.int64), offsets[place + 1].astype(np.int64)
            rest = rest_of(own, wide, bits, small)
            at = lower_bound(stored, rest, low, high)
            hit = np.flatnonzero(at < high)
            hit = hit[stored[at[hit]] == rest[hit]]
            yield s, rows[hit], at[hit], place[hit]

    def counts(self, table: str, s: int, at: np.ndarray) -> np.ndarray:
        n = self.shard(f"{table}.count", s, "u1")[at].astype(np.int64)
        over = n == 255
        if over.any():
            big = self.shard(f"{table}.big", s, "<u8", 2)
            n[over] = big[np.searchsorted(big[:, 0], at[over].astype(np.uint64)), 1]
        return n

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs by their keys."""
        out = np.zeros(len(keys), np.int64)
        for s, rows, at, _ in self.find("pair", keys, 2 * self.model.id_bits):
            out[rows] = self.counts("pair", s, at)
        return out

    def followers(self, k: int, keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        """[words, 5] of n-grams of order k, by keys of their contexts: count, times a context, followers seen once, twice, more often."""
        out, table = np.zeros((len(keys), 5), np.int64), f"gram{k}"
        for s, rows, at, place in self.find(table, keys, 2 * self.model.id_bits if k == 3 else 64):
            word, many = self.shard(f"{table}.word", s, "<u4"), self.shard(f"{table}.many", s, "<u4", 4)
            first, end = self.starts(table, s, at, place), self.starts(table, s, at + 1, place)
            w = words[rows].astype(np.uint32)
            there = lower_bound(word, w, first, end)
            found = np.flatnonzero(there < end)
            found = found[word[there[found]] == w[found]]
            out[rows[found], 0] = self.counts(table, s, there[found])
            size, sums = end - first, np.zeros((len(at), 4), np.int64)
            few = np.flatnonzero(size <= SUMMED)
            for i in range(SUMMED):  # of few followers the sums are worked out, of many they are stored
                few = few[size[few] > i]
                if not len(few):
                    break
                n = self.counts(table, s, first[few] + i)
                sums[few, 0] += n
                for c in (1, 2):
                    sums[few, c] += n == c
            more = np.flatnonzero(size > SUMMED)
            sums[more, :3] = many[np.searchsorted(many[:, 0], at[more].astype(np.uint32)), 1:]
            sums[:, 3] = size - sums[:, 1] - sums[:, 2]
            out[rows, 1:] = sums
        return out

    def starts(self, table: str, s: int, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the followers of contexts start, which are of a place or the first behind it."""
        offsets, begin, near, far = (self.shard(f"{table}.{name}", s, kind, columns) for name, kind, columns in (("offset", "<u4", 1), ("begin", "<u4", 1), ("near", "u1", 1), ("far", "<u4", 2)))
        behind = at == offsets[place + 1]
        out = begin[place + behind].astype(np.int64)
        inside = np.flatnonzero(~behind)
        n = near[at[inside]].astype(np.int64)
        out[inside] += n
        over = inside[n == 255]
        if len(over):
            out[over] = far[np.searchsorted(far[:, 0], at[over].astype(np.uint32)), 1]
        return out

    def about(self, ids: np.ndarray) -> np.ndarray:
        """[ids, 6]: raw count, times a context, continuations, followers seen once, twice, more often; zeros for -1."""
        m, out, order = self.model, np.zeros((len(ids), 6), np.int64), np.argsort(ids)
        order = order[ids[order] >= 0]
        own = ids[order]
        for s, a, b in runs(own >> m.id_shift):
            at = own[a:b] - (s << m.id_shift)
            out[order[a:b], 1] = self.shard("about.total", s, "<i8")[at]
            out[order[a:b], 2:] = self.shard("about.kinds", s, "<u4", 4)[at]
        for s, a, b in runs(np.searchsorted(m.offsets, own, side="right") - 1):
            if s < len(m.offsets) - 1:
                out[order[a:b], 0] = self.shard("word.count", s, "<i8")[own[a:b] - m.offsets[s]]
        return out


def place_of(keys: np.ndarray, wide: int, bits: int) -> np.ndarray:
    return (keys << np.uint64(bits)) >> np.uint64(64 - wide)


def rest_of(keys: np.ndarray, wide: int, bits: int, small: bool) -> np.ndarray:
    rest = keys << np.uint64(bits + wide)
    return (rest >> np.uint64(32)).astype("<u4") if small else rest


def key_table(keys: np.ndarray, width: int, bits: int) -> dict[str, np.ndarray]:
    """Arrays of a shard's sorted keys: what is left of each behind its shard and place, and where each place starts.

    There are so many places that about PLACED keys share one, and as 32 bits need, if 16 bits of places give them that.
    """
    wide = max(1, (len(keys) // PLACED).bit_length())
    if width - bits - 32 <= 16:
        wide = max(wide, width - bits - 32)
    place = place_of(keys, wide, bits)
    return {"low": rest_of(keys, wide, bits, width - bits - wide <= 32), "offset": np.searchsorted(place, np.arange((1 << wide) + 1, dtype=np.uint64)).astype("<u4")}


def lower_bound(stored: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each wanted value the first place in stored[low:high], sorted, that is not below it."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        below = stored[mid] < wanted[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    if len(sorted_values):
        first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        yield from zip(sorted_values[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_values)], strict=True)


_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def pair_keys(u: np.ndarray, w: np.ndarray, id_bits: int) -> np.ndarray:
    """One-to-one keys of pairs of ids: scrambled within their bits, which stand first in the 64."""
    width = 2 * id_bits
    mask, half = np.uint64((1 << width) - 1), np.uint64(id_bits)
    x = (u.astype(np.uint64) << half) | w.astype(np.uint64)
    for odd in _ODD:
        x ^= x >> half
        x = (x * np.uint64(odd & int(mask))) & mask
    return (x ^ (x >> half)) << np.uint64(64 - width)


def pairs_of(keys: np.ndarray, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids that keys stand for."""
    width = 2 * id_bits
    mask, half = (1 << width) - 1, np.uint64(id_bits)
    x = keys >> np.uint64(64 - width)
    for odd in reversed(_ODD):
        x ^= x >> half
        x = (x * np.uint64(pow(odd & mask, -1, 1 << width))) & np.uint64(mask)
    x ^= x >> half
    return x >> half, x & np.uint64((1 << id_bits) - 1)


def context_keys(ids: list[np.ndarray], id_bits: int) -> np.ndarray:
    """64-bit keys of contexts of two ids (one to one) or more (hashed); their first bits are the shard."""
    key = pair_keys(ids[0], ids[1], id_bits)
    for x in ids[2:]:
        key = mix(mix(key) + x.astype(np.uint64))
    return key


def in_order(key: np.ndarray, w: np.ndarray, width: int, id_bits: int) -> np.ndarray:
    """Order of n-grams by key and last word: by one number, whose few mix-ups are put right where 64 bits do not hold both."""
    spare = 64 - width - id_bits
    if spare >= 0:
        return np.argsort(key | (w.astype(np.uint64) << np.uint64(spare)))
    top = key >> np.uint64(id_bits)
    order = np.argsort((top << np.uint64(id_bits)) | w.astype(np.uint64))
    k, t = key[order], top[order]
    mixed = np.flatnonzero((t[1:] == t[:-1]) & (k[1:] != k[:-1])) if len(k) else ()
    if len(mixed):
        rows = np.flatnonzero(np.isin(t, t[mixed]))
        some = order[rows]
        order[rows] = some[np.lexsort((w[some], key[some]))]
    return order


def inside(key: np.ndarray, width: int, bits: int) -> np.ndarray:
    """A key without the bits of its shard, as a small number."""
    return (key << np.uint64(bits)) >> np.uint64(64 - max(width - bits, 1))


def outside(shard: int, rest: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The keys of a shard from ``inside``."""
    return (np.uint64(shard) << np.uint64(64 - bits)) | (rest << np.uint64(64 - max(width - bits, 1)) >> np.uint64(bits))


def first_of(key: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (w[1:] != w[:-1])])) if len(key) else np.empty(0, np.int64)


def gaps(key: np.ndarray, width: int) -> np.ndarray:
    """Sorted keys as differences, which compress well."""
    return np.diff(key >> np.uint64(64 - width), prepend=np.uint64(0))


def ungapped(gap: np.ndarray, width: int) -> np.ndarray:
    return np.cumsum(gap, dtype=np.uint64) << np.uint64(64 - width)


def sent_grams(ids: list[np.ndarray], n: np.ndarray, model: Model) -> pa.RecordBatch:
    """Blocks of n-grams for the shards of their order: pairs and triples by key, longer ones with their ids."""
    bits, b = model.bits, model.id_bits
    if len(ids) == 2:
        key, n = tally(pair_keys(*ids, b), n)
        return sent(key, bits, 2 * b, n.astype("<u4"))
    width = 2 * b if len(ids) == 3 else 64
    key = context_keys(ids[:-1], b)
    if len(ids) == 3 and width - bits + b <= 64 and bits <= 16:
        # Within a shard 64 bits hold the rest of the key and the word.
        shard = (key >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(shard, kind="stable")
        whole = (inside(key, width, bits) << np.uint64(b)) | ids[2]
        parts = [(s, *tally(whole[order[x:y]], n[order[x:y]])) for s, x, y in runs(shard[order])]
        last = np.uint64((1 << b) - 1)
        blocks = [pack(gaps(outside(s, k >> np.uint64(b), width, bits), width), (k & last).astype("<u4"), c.astype("<u4")) for s, k, c in parts]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int64()), pa.array(blocks, pa.binary())], names=["shard", "block"])
    order = in_order(key, ids[-1], width, b)
    key, ids = key[order], [x[order] for x in ids]
    first = first_of(key, ids[-1])
    n = np.add.reduceat(n[order], first) if len(first) else n
    columns = ids[2:] if len(ids) == 3 else ids
    return sent(key[first], bits, width, *(x[first].astype("<u4") for x in columns), n.astype("<u4"))


def sent(key: np.ndarray, bits: int, width: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A packed block for each shard, of sorted keys and what goes with them."""
    parts = list(runs((key >> np.uint64(64 - bits)).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int64()), pa.array([pack(gaps(key[a:b], width), *(x[a:b] for x in arrays)) for _, a, b in parts], pa.binary())], names=["shard", "block"])


def joined(blocks: list[bytes], width: int, *kinds: str) -> list[np.ndarray]:
    """Keys and what goes with them, of all blocks."""
    parts = [unpack(x, "<u8", *kinds) for x in blocks]
    return [np.concatenate([ungapped(p[0], width) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, len(kinds) + 1))]


def numbered(out: pa.RecordBatch, numbers: np.ndarray) -> pa.Table:
    """Blocks with counts of counts, which travel with the first."""
    return pa.Table.from_batches([out]).append_column("numbers", pa.array([numbers.tolist() if i == 0 else [0] * len(numbers) for i in range(len(out))], pa.list_(pa.int64())))


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def tokenised(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts, and how many each has."""
    words = [t.encode().lower().split() for t in texts]
    return [w for ws in words for w in ws], np.array([len(w) for w in words], np.int64)


def with_ends(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with the end token behind each text, and where each text starts."""
    last = np.cumsum(n + 1) - 1
    out = np.full(int(n.sum()) + len(n), end, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = ids
    return out, last - n


def fold(id_column: str = "doc_id", folds: int = 7):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of counts one to four; where a count is missing, the plain 0.5, 1, 1.5."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k)) for k in (1, 2, 3))


def count_words(texts: DataFrame, folder: str, bits: int) -> tuple[tuple[int, ...], int]:
    """Pass 1: writes the word shards; the id of each shard's first word with the vocabulary's size, and the tokens."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        keys, values, size = [], [], 0

        def out() -> pa.RecordBatch:
            k, v = summed(np.concatenate(keys), np.concatenate(values))
            return sent(k, bits, 64, v)

        for batch in batches:
            for _, _, texts_ in text_slices(batch.column(0)):
                words, n = tokenised(texts_)
                h = np.fromiter(map(hashes.get, words, repeat(0)), np.uint64, len(words))
                missing = np.flatnonzero(h == 0).tolist()
                if missing:
                    if len(hashes) + len(missing) > KNOWN_WORDS:
                        hashes.clear()
                    new = {w: xxhash.xxh3_64_intdigest(w) for w in {words[i] for i in missing}}
                    hashes.update(new)
                    h[missing] = np.fromiter((new[words[i]] for i in missing), np.uint64, len(missing))
                k, v = counted(h)
                keys += [k, np.array([END], np.uint64)]
                values += [v, np.array([len(n)], np.int64)]
                size += len(k)
                if size > GATHERED:
                    yield out()
                    keys, values, size = [], [], 0
        if keys:
            yield out()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        k, v = summed(*joined(t.column("block").to_pylist(), 64, "<i8"))
        put(f"{folder}/word-{s:05d}", {"hash": k, "count": v})
        return pa.table({"shard": [s], "words": [len(k)], "tokens": [int(v.sum())]})

    # An empty block for every shard, so that each is written.
    every = texts.sparkSession.range(1 << bits).select(F.col("id").alias("shard"), F.lit(pack(np.empty(0, "<u8"), np.empty(0, "<i8"))).alias("block"))
    got = texts.mapInArrow(gather, "shard long, block binary").unionByName(every).groupBy("shard").applyInArrow(merge, "shard long, words long, tokens long").orderBy("shard").collect()
    return (0, *np.cumsum([r["words"] for r in got]).tolist()), sum(r["tokens"] for r in got)


def small_counts(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; 255 stands for what is in ``big``."""
    over = np.flatnonzero(n >= 255)
    return {"count": np.minimum(n, 255).astype("u1"), "big": np.column_stack([over, n[over]]).astype("<u8")}


def layout(keys: np.ndarray, words: np.ndarray, n: np.ndarray, width: int, bits: int) -> dict[str, np.ndarray]:
    """Arrays of a shard: contexts, where their followers start (a byte behind their place's start), followers with counts, sums for many followers."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    start = np.append(first, len(keys))
    many = np.flatnonzero(np.diff(start) > SUMMED)
    sums = [np.add.reduceat(x.astype(np.int64), first)[many] if len(first) else many for x in (n, n == 1, n == 2)]
    if len(keys) >= 1 << 32 or max(int(x.max(initial=0)) for x in sums) >= 1 << 32:
        raise ValueError("a shard holds more than 2 ** 32 n-grams: raise the number of shards")
    table = key_table(keys[first], width, bits)
    begin = start[table["offset"]]
    near = start[:-1] - np.repeat(begin[:-1], np.diff(table["offset"].astype(np.int64)))
    far = np.flatnonzero(near >= 255)
    return {
        **table, **small_counts(n), "begin": begin.astype("<u4"), "near": np.minimum(near, 255).astype("u1"), "far": np.column_stack([far, start[far]]).astype("<u4"),
        "word": words.astype("<u4"), "many": np.column_stack([many, *sums]).astype("<u4"),
    }


def count_grams(texts: DataFrame, words: Model, order: int = 2) -> Model:
    """Passes 2 and 3: writes the shards of n-grams and what is known about each id; the finished model."""
    folder, bits, start, shift, id_bits = words.folder, words.bits, words.vocabulary, words.id_shift, words.id_bits
    fill = start + 1  # stands before the start where a text's n-gram is shorter than the order
    if id_bits > 32:
        raise ValueError("a vocabulary of 2 ** 32 words or more does not fit the keys of pairs")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, held, size = Shards(words), [], 0
        end = shards.end_id()

        def out() -> pa.RecordBatch:
            *ids, n = (np.concatenate(x) for x in zip(*held, strict=True))
            got = sent_grams(ids, n, words)
            return numbered(got, np.zeros(4 * order + 4, np.int64)).to_batches()[0]

        for batch in batches:
            for _, _, some in text_slices(batch.column(0)):
                flat, n = tokenised(some)
                ids, first = with_ends(shards.ids(flat), n, end)
                columns = [ids]
                for back in range(1, order):
                    before = np.concatenate([[start], columns[0][:-1]]) if len(ids) else ids
                    before[first] = start if back == 1 else fill
                    columns.insert(0, before)
                held.append((*(c.astype("<u4") for c in columns), np.ones(len(ids), np.int64)))
                size += len(held[-1][0])
                if size > GATHERED:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def longer(k: int):
        def merge(key: tuple, t: pa.Table) -> pa.Table:
            s = key[0].as_py()
            width = 2 * id_bits if k == 3 else 64
            key, *columns, n = joined(t.column("block").to_pylist(), width, *["<u4"] * (2 if k == 3 else k + 1))
            if k == 3 and width - bits + id_bits <= 64:
                whole, n = tally((inside(key, width, bits) << np.uint64(id_bits)) | columns[0], n.astype(np.int64))
                key, columns = outside(s, whole >> np.uint64(id_bits), width, bits), [(whole & np.uint64((1 << id_bits) - 1)).astype("<u4")]
            else:
                by = in_order(key, columns[-1], width, id_bits)
                first = first_of(key[by], columns[-1][by])
                n = np.add.reduceat(n[by].astype(np.int64), first) if len(first) else n.astype(np.int64)
                key, columns = key[by[first]], [c[by[first]] for c in columns]
            ids = [*pairs_of(key, id_bits), *columns] if k == 3 else columns
            real = ids[0] != fill
            put(f"{folder}/gram{k}-{s:05d}", layout(key[real], ids[-1][real], n[real], width, bits))
            numbers = np.array(t.column("numbers").to_pylist(), np.int64).sum(0)
            numbers[4 * k : 4 * k + 4] += counts_of_counts(n[real])
            return numbered(sent_grams(ids[1:], np.where(real, 1, n), words), numbers)

        return merge

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        k, v = joined(t.column("block").to_pylist(), 2 * id_bits, "<u4")
        k, v = tally(k, v.astype(np.int64))
        put(f"{folder}/pair-{s:05d}", {**key_table(k, 2 * id_bits, bits), **small_counts(v)})
        u, w = pairs_of(k, id_bits)
        one = lambda x: x.astype(np.int64)
        context = summed(u, v, one(v == 1), one(v == 2), one(v >= 3))
        ids, n = counted(w)
        zero = np.zeros(len(ids), np.int64)
        both = summed(np.concatenate([context[0], ids]), *(np.concatenate(x) for x in ((context[1], zero), (np.zeros(len(context[0]), np.int64), n), *((c, zero) for c in context[2:]))))
        parts = list(runs((both[0] >> np.uint64(shift)).astype(np.int64)))
        columns = both[0].astype("<u4"), both[1], *(x.astype("<u4") for x in both[2:])
        out = pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int64()), pa.array([pack(*(c[a:b] for c in columns)) for _, a, b in parts], pa.binary())], names=["shard", "block"])
        numbers = np.array(t.column("numbers").to_pylist(), np.int64).sum(0)
        numbers[8:12] += counts_of_counts(v)
        return numbered(out, numbers)

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        low, high = s << shift, min((s + 1) << shift, start + 1)
        total, kinds = np.zeros(high - low, np.int64), np.zeros((high - low, 4), np.int64)
        for block in t.column("block").to_pylist():
            ids, tot, *rest = unpack(block, "<u4", "<i8", *["<u4"] * 4)
            at = ids.astype(np.int64) - low
            total[at] += tot
            kinds[at] += np.column_stack(rest).astype(np.int64)
        put(f"{folder}/about-{s:05d}", {"total": total, "kinds": kinds.astype("<u4")})
        of_grams = np.array(t.column("numbers").to_pylist(), np.int64).sum(0)
        c = kinds[:, 0]
        return pa.table({"continuations": [int(c.sum())], "more": [int((c >= 3).sum())], **{f"n{i}": [int((c == i).sum())] for i in (1, 2, 3, 4)}, **{f"p{i}": [int(of_grams[i])] for i in range(8, 4 * order + 4)}})

    names = ["continuations", "more", *(f"n{i}" for i in range(1, 5)), *(f"p{i}" for i in range(8, 4 * order + 4))]
    schema = "shard long, block binary, numbers array<long>"

    def every(k: int) -> DataFrame:
        """An empty block for every shard, so that each is written."""
        empty = pack(np.empty(0, "<u8"), *[np.empty(0, "<u4")] * (1 if k == 2 else 2 if k == 3 else k + 1))
        return texts.sparkSession.range(1 << bits).select(F.col("id").alias("shard"), F.lit(empty).alias("block"), F.array_repeat(F.lit(0).cast("long"), 4 * order + 4).alias("numbers"))

    found = texts.mapInArrow(gather, schema)
    for k in range(order, 2, -1):
        found = found.unionByName(every(k)).groupBy("shard").applyInArrow(longer(k), schema)
    pairs = found.unionByName(every(2)).groupBy("shard").applyInArrow(merge, schema)
    got = pairs.groupBy("shard").applyInArrow(finish, ", ".join(f"{n} long" for n in names)).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    of_words = _discounts([got[f"n{i}"] for i in range(1, 5)])
    of_grams = [_discounts([got[f"p{i}"] for i in range(4 * k, 4 * k + 4)]) for k in range(2, order + 1)]
    left = (of_words[0] * got["n1"] + of_words[1] * got["n2"] + of_words[2] * got["more"]) / max(1, got["continuations"])
    return Model(folder, bits, words.offsets, words.tokens, (of_words, *of_grams), got["continuations"], left)


def train(texts: DataFrame, bits: int | None = None, order: int = 2) -> Model:
    """A model of n-grams of up to ``order`` words of the texts in the one column of ``texts``, in 2 ** bits shards (from the number of shuffle partitions)."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark: SparkSession = texts.sparkSession
    if bits is None:
        bits = max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    folder = shared_dir(spark, "ngram-model")
    offsets, tokens = count_words(texts, folder, bits)
    words = Model(folder, bits, offsets, tokens, ((0.5, 1.0, 1.5),) * order, 0, 1.0)
    return count_grams(texts, words, order) if tokens else words


def less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discount."""
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


_shards: dict[str, Shards] = {}


def score_texts(texts: list[str], model: Model) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, log10 probability under add-one unigrams and under the model."""
    if model.folder not in _shards:
        _shards.clear()
        _shards[model.folder] = Shards(model)
    shards, v = _shards[model.folder], model.vocabulary
    flat, n = tokenised(texts)
    if not model.tokens:
        return {"n_tokens": n + 1, "n_known": n * 0, "base_score": n * 0.0, "score": n * 0.0}
    slot, id_bits = shards.slots(flat, facts=True), model.id_bits
    marks = np.array([shards.end_id(), v])  # the end of a text and its start
    all_ids, all_facts = np.concatenate([shards.ids_of, marks]), np.concatenate([shards.facts_of, shards.about(marks)])
    slot, first = with_ends(slot, n, len(all_ids) - 2)
    back = np.concatenate([[0], slot[:-1]])
    back[first] = len(all_ids) - 1
    ids, before, w, u = all_ids[slot], all_ids[back], all_facts[slot], all_facts[back]
    base = np.log10((w[:, 0] + 1) / (model.tokens + v + 1))
    of_words, of_pairs, *of_longer = model.discounts
    p = np.maximum(less(w[:, 2], of_words), 0) / max(1, model.continuations) + model.word_mass / (v + 1)
    c, known = np.zeros(len(ids), np.int64), (ids >= 0) & (before >= 0)
    keys = np.zeros(len(ids), np.uint64)
    keys[known] = pair_keys(before[known], ids[known], id_bits)
    c[known] = shards.pair_counts(keys[known])
    total = np.maximum(1, u[:, 1])
    p = np.where(u[:, 1] > 0, np.maximum(less(c, of_pairs), 0) / total + (u[:, 3:] @ np.array(of_pairs)) / total * p, p)
    place = np.arange(len(ids)) - np.repeat(first, n + 1)
    context = [before]
    for k, d in enumerate(of_longer, 3):
        context.insert(0, np.concatenate([[-1], context[0][:-1]]))
        whole = np.flatnonzero((place >= k - 2) & np.all([x >= 0 for x in context], axis=0))
        # A context of two words is the pair that ends one token before.
        g = shards.followers(k, keys[whole - 1] if k == 3 else context_keys([x[whole] for x in context], id_bits), ids[whole])
        total = np.maximum(1, g[:, 1])
        p[whole] = np.where(g[:, 1] > 0, np.maximum(less(g[:, 0], d), 0) / total + (g[:, 2:] @ np.array(d)) / total * p[whole], p[whole])
    return {"n_tokens": n + 1, "n_known": np.add.reduceat(w[:, 0] > 0, first, dtype=np.int64), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity (ten to the mean negative score) of every row."""
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                got = score_texts(texts, model)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(got[k]) for k in names)], names=["doc_id", *names])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out_scores(docs: DataFrame, folds: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Scores of all rows by a model of the rows outside fold ``held``, with held_out."""
    model = train(docs.where(fold(folds=folds) != held).select("text"), order=order)
    s = score(docs, model)
    return s.select("doc_id", (fold(folds=folds) == held).alias("held_out"), *s.columns[1:])
