"""Fingerprints by a randomised edit embedding.

A text of n characters is walked for 2n steps by a random walk that all texts share: at step j the walk gives the
character it stands on and moves on to the next one if the step's random bit for that character is one. Two texts that
differ by few edits soon walk in step again behind each edit, so edit distance becomes Hamming distance. The embedding
is sampled in SLOTS places: each slot takes, of the steps that a shared hash gives to it, the one of smallest priority
below 2n, so that texts of near lengths sample nearly the same steps. A slot keeps the six-bit class of its character; a
step behind the text's end gives nothing.

The walk runs for all texts of a batch at a time, longest first, one vector operation per step, so a step costs only
the texts that are that long. The fingerprint is text: a base-64 digit for each slot, ``-`` for an empty one.

Null text is the empty text, whose fingerprint is empty in every slot and has likeness 1 to itself. Repeated rows are
done each; extra columns are left out. Rows follow each other by doc_id (null first), then text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import kept, mix, slices, texts_of
from tideway.llm.linking import classes

SLOTS = 256
#: Steps per character: with even bits the walk stays two steps on a character, so that 2n steps reach about its end.
STEPS = 2
EMPTY = 255
#: Characters fall into so many classes that have a random bit of their own at each step.
CLASSES = 64
BANDS, ROWS = 24, 6
LIKENESS = 0.8
#: Characters that are walked at a time.
WALKED_CHARS = 8_000_000
#: Rows of a range of ids, and how many ranges there are at most; a range is streamed, not held.
ROWS_PER_PART, MOST_PARTS = 5_000, 4_096
_G = np.uint64(0x9E3779B97F4A7C15)
_WALK, _SLOT, _CLASS = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_CLASS_OF = (mix(np.arange(0x110000, dtype=np.uint64) + _CLASS) % np.uint64(CLASSES)).astype(np.uint8)
_DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", np.uint8)


class Samples:
    """The steps that slots take: for every slot the prefix minima of the priorities of its steps, found as far as asked for."""

    def __init__(self, slots: int):
        self.slots, self.upto = slots, 0
        self.lowest = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
        self.steps: list[list[int]] = [[] for _ in range(slots)]

    def reach(self, steps: int) -> None:
        while self.upto < steps:
            j = np.arange(self.upto, min(max(steps, self.upto + 1), self.upto + 262_144), dtype=np.uint64)
            h = mix(j * _G + _SLOT)
            slot = (h % np.uint64(self.slots)).astype(np.int64)
            may = np.flatnonzero(h < self.lowest[slot])
            for k in may:
                if h[k] < self.lowest[slot[k]]:
                    self.lowest[slot[k]] = h[k]
                    self.steps[slot[k]].append(int(j[k]))
            self.upto = int(j[-1]) + 1


_samples: dict[int, Samples] = {}


def moves(first: int, count: int) -> np.ndarray:
    """[count, CLASSES + 1]: whether a walk that stands on a class moves on, at steps first, first + 1, ...; never behind the end."""
    bits = mix(np.arange(first, first + count, dtype=np.uint64) * _G + _WALK)
    out = np.zeros((count, CLASSES + 1), np.int64)
    out[:, :CLASSES] = (bits[:, None] >> np.arange(CLASSES, dtype=np.uint64)) & np.uint64(1)
    return out


def fingerprints(texts: list[str], slots: int = SLOTS) -> np.ndarray:
    """uint8 [texts, slots]: a character class in each slot, EMPTY where there is nothing."""
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    out = np.full((len(texts), slots), EMPTY, np.uint8)
    if not len(n) or not n.max():
        return out
    start = np.cumsum(n + 1) - (n + 1)
    codes = _CLASS_OF[np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
    codes[start + n] = CLASSES  # what stands behind each text
    length = STEPS * n[order]
    longest = int(length[0])
    sample = _samples.setdefault(slots, Samples(slots))
    sample.reach(longest)
    wanted = np.unique(np.array([s for own in sample.steps for s in own], np.int64))
    wanted = wanted[wanted < longest]
    column = np.full(longest + 1, -1, np.int32)
    column[wanted] = np.arange(len(wanted))
    seen = np.full((len(wanted), len(n)), CLASSES, np.uint8)
    at = start[order]
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more steps than j
    for first in range(0, longest, 4096):
        table = moves(first, min(4096, longest - first))
        for j in range(first, first + len(table)):
            k = live[j]
            here = codes[at[:k]]
            if (c := column[j]) >= 0:
                seen[c, :k] = here
            at[:k] += table[j - first][here]
    rows = np.arange(len(n))
    for s, steps in enumerate(sample.steps):
        steps = np.array([x for x in steps if x < longest], np.int64)
        if len(steps):
            last = np.searchsorted(steps, length, side="left") - 1  # the newest minimum below each length
            ok = last >= 0
            out[order[ok], s] = seen[column[steps[last[ok]]], rows[ok]]
    out[out == CLASSES] = EMPTY
    return out


def as_text(prints: np.ndarray) -> list[str]:
    wide = np.where(prints == EMPTY, ord("-"), _DIGITS[prints % CLASSES]).astype(np.uint8)
    return [r.tobytes().decode() for r in wide]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the slots that are filled in either, the share that is equal; 1 where none is."""
    filled = (x != EMPTY) | (y != EMPTY)
    return np.where(filled.any(1), ((x == y) & filled).sum(1) / np.maximum(1, filled.sum(1)), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters of the start of another text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def part_of(marks: list[int]):
    """Column: how many marks lie below doc_id, looked up in two steps of about the root of their number each; -1 for null."""
    if not marks:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    wide = max(1, int(len(marks) ** 0.5))
    coarse = f"size(filter(array({', '.join(f'{m}L' for m in marks[wide - 1 :: wide])}), m -> doc_id > m))" if len(marks) >= wide else "0"
    fine = ", ".join(f"array({', '.join(f'{m}L' for m in marks[i : i + wide])})" for i in range(0, len(marks), wide))
    return F.expr(f"case when doc_id is null then -1 else {wide} * {coarse} + coalesce(size(filter(get(array({fine}), {coarse}), m -> doc_id > m)), 0) end")


def with_following(docs: DataFrame, rows_per_part: int = ROWS_PER_PART, most_parts: int = MOST_PARTS) -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, lead) in parts by ranges of doc_id; a part ends with the first row of the next one, marked lead.

    Parts come from quantiles of the ids, at most ``most_parts``; a text is moved once, but for the first of each part.
    """
    ids = docs.select("doc_id")
    parts = min(most_parts, max(1, -(-ids.count() // rows_per_part)))
    marks = ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) if parts > 1 else []
    part = part_of(sorted({int(x) for x in marks}))
    first = {r["part"]: r["doc_id"] for r in ids.groupBy(part.alias("part")).agg(F.min("doc_id").alias("doc_id")).collect()}  # a row a part
    there = sorted(first)
    before = [(p, there[i - 1]) for i, p in enumerate(there)]  # the last part comes before the first
    rows = docs.select(part.alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = rows.where(F.col("doc_id").isin([x for x in first.values() if x is not None]) | F.col("doc_id").isNull())
    heads = heads.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    goes_to = docs.sparkSession.createDataFrame(before, "part int, goes_to int")
    lead = heads.join(F.broadcast(goes_to), "part").select(F.col("goes_to").alias("part"), "r.doc_id", "r.text", F.lit(True).alias("lead"))
    return rows.withColumn("lead", F.lit(False)).unionByName(lead), max(1, len(there))


def digests(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    rows, parts = with_following(docs)

    def done(part: list[tuple[int | None, str]], following: list[str]) -> pa.RecordBatch:
        texts = [t for _, t in part]
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        prints = fingerprints([*texts, *changed, following[-1]], slots)
        own, other, last = prints[: len(texts)], prints[len(texts) : -1], prints[-1:]
        nxt = np.concatenate([own[1:], last])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in part], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(as_text(own)),
                pa.array(as_text(other)),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, nxt)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int | None, str, bool]] = []
        size = 0

        def flush(upto: int) -> Iterator[pa.RecordBatch]:
            """Rows before ``upto``; each is followed by the next one of its part."""
            some = [i for i in range(upto) if not waiting[i][3]]
            a = 0
            while a < len(some):
                b = a + 1
                while b < len(some) and some[b] == some[b - 1] + 1:
                    b += 1
                run_of = some[a:b]
                yield done([waiting[i][1:3] for i in run_of], [waiting[i + 1][2] for i in run_of])
                a = b

        for batch in batches:
            p, i, lead = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for k, t in enumerate(texts_of(batch.column(2))):
                waiting.append((p[k], i[k], t, lead[k]))
                size += len(t)
                if size >= WALKED_CHARS:
                    yield from flush(len(waiting) - 1)
                    waiting, size = waiting[-1:], len(waiting[-1][2])
        yield from flush(len(waiting))

    spread = rows.repartition(parts, "part").sortWithinPartitions("part", "lead", "doc_id", "text")
    return spread.select("part", "doc_id", "text", "lead").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def sign(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(id, sig binary) of the smallest id of each distinct text; the empty text has no signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for x, y in slices(texts, WALKED_CHARS):
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array([s.tobytes() if t else None for s, t in zip(fingerprints(texts[x:y], slots), texts[x:y], strict=True)], pa.binary())], names=["id", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, sig binary")


def near_links(docs: DataFrame, least: float = LIKENESS, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): documents whose fingerprints are linked by bands of sampled slots and verified on all slots."""
    signed = kept(sign(docs, slots), "fingerprints")
    texts = kept(signed.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("id")), "distinct-fingerprints")
    order = np.argsort(mix(np.arange(slots, dtype=np.uint64) + _WALK))

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, slots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in m[:, order]], pa.binary())], names=["id", "sig"])

    shuffled = kept(texts.select("id", "sig").mapInArrow(sampled, "id long, sig binary"), "sampled-fingerprints")
    bags = lambda ids: kept(shuffled.join(ids, "id").select("id", F.col("sig").alias("bag")), "bags")
    alike = lambda x, others: likeness(np.frombuffer(x, np.uint8)[None, :], np.frombuffer(b"".join(others), np.uint8).reshape(-1, slots))
    roots = classes(shuffled, "u1", bands, rows, likeness, least, bags, alike, least)
    named = texts.join(roots, "id", "left").select("sig", F.coalesce("root", "id").alias("class_id"))
    return signed.join(named, "sig", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
