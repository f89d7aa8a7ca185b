"""Near-duplicates by BagMinHash over multisets of word shingles.

A shingle that occurs w times has weight w. Its weights 0..w are discretised at the integers and covered by dyadic
blocks [0,1), [1,2), [2,4), [4,8) ..., each with a Poisson process of its own whose rate is the block's width; a point
of a block that is only partly inside the weight is thinned by its position. A point has a time and one of ``m``
registers, and a register keeps its earliest time. Two texts agree in a register with the probability of their weighted
Jaccard similarity. Only points before a time at which nearly always all registers are filled are made, so that a long
text costs little more than its shingles; the few texts with an empty register are done again with twice that time.

Texts that are equal are one text from the start. Bands of the signatures give candidates, which are verified by the
exact overlap of the multisets (see ``linking``).

Null text is the empty text. A text of one to four words has one shingle, all its words; a text without words has none
and is a copy only of equal texts. Repeated rows are copies of each other, rows of one id with different texts are
separate texts under that id. Extra columns are left out, or pass unchanged in ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import WordHashes, freed, kept, mix, ragged, spread_join, text_slices
from tideway.llm.linking import classes

SHINGLE = 5
SIMILARITY = 0.8
#: Registers; bands times rows of them make the buckets. A pair at the threshold is missed with probability 5e-5.
M, BANDS, ROWS = 128, 25, 5
#: Pairs whose signatures agree less than the threshold by this many standard deviations of the estimate are not verified.
SLACK = 4.0
_G = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes()


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, one text after another, and how many each has."""
    words = [t.encode().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = _hashes([w for ws in words for w in ws])
    size = np.where(n > 0, np.maximum(n, width), 0)
    at = np.cumsum(size) - size
    padded = np.zeros(int(size.sum()), np.uint64)
    padded[ragged(at, n)] = flat
    count = np.maximum(size - width + 1, 0)
    i = ragged(at, count)
    h = np.zeros(len(i), np.uint64)
    for k in range(width):
        h = (h ^ padded[i + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return mix(h), count


def multisets(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times it occurs), by text and hash."""
    h, count = shingles(texts, width)
    doc = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """uint32 signatures [texts, m] of weighted sets; the rows of texts without elements are zero."""
    if m & (m - 1) or not 0 < m <= 256:
        raise ValueError("registers must be a power of two up to 256, as eight bits of a hash choose one")
    best = np.full((texts, m), np.inf)
    total = np.bincount(doc, weight, texts)
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64), 0) + 1
    unit = np.repeat(np.arange(len(doc)), blocks)
    j = ragged(np.zeros(len(doc), np.int64), blocks)
    low = np.where(j > 0, 2.0 ** (j - 1), 0.0)
    width = np.where(j > 0, low, 1.0)
    unit_doc, unit_weight = doc[unit], weight[unit]
    seed = mix(element[unit] ^ mix((j.astype(np.uint64) + np.uint64(1)) * _G))
    todo, reach = np.flatnonzero(total > 0), np.log(m) + 3
    while len(todo):
        horizon = np.zeros(texts)
        horizon[todo] = reach / total[todo]
        own = np.flatnonzero(horizon[unit_doc] > 0)
        d, s, w, lo, weight_of, until = unit_doc[own], seed[own], width[own], low[own], unit_weight[own], horizon[unit_doc[own]]
        t, best[todo] = np.zeros(len(own)), np.inf
        flat = best.reshape(-1)
        while len(d):
            s = s + _G
            r = mix(s)
            t = t - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / (m * w)
            on = t < until
            d, s, w, lo, weight_of, until, t, r = (x[on] for x in (d, s, w, lo, weight_of, until, t, r))
            inside = lo + w * ((r & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24) < weight_of
            register = ((r >> np.uint64(24)) & np.uint64(0xFF)).astype(np.int64) * m >> 8
            np.minimum.at(flat, d[inside] * m + register[inside], t[inside])
        todo = todo[np.isinf(best[todo]).any(1)]
        reach *= 2
    best[total == 0] = 0
    return (mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal registers, an unbiased estimate of the weighted Jaccard similarity."""
    return (x == y).mean(1)


def occurrences(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's multiset as a sorted array of distinct 64-bit numbers, one for each occurrence of a shingle."""
    h, count = shingles(texts, width)
    doc = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)], at, 0)) if len(h) else at
    ids = mix(h + (at - first).astype(np.uint64) * _G)
    edge = np.concatenate([[0], np.cumsum(count)])
    return [np.sort(ids[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


def jaccard(x: bytes, others: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarities of a multiset with others, each given as the bytes of its occurrences."""
    a = np.frombuffer(x, np.uint64)
    sizes = np.array([len(y) // 8 for y in others], np.int64)
    b = np.frombuffer(b"".join(others), np.uint64)
    if not len(a):
        return np.zeros(len(others))
    hit = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
    before = np.concatenate([[0], np.cumsum(hit)])
    end = np.cumsum(sizes)
    common = before[end] - before[end - sizes]
    return common / (len(a) + sizes - common)


def with_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest binary): null text is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def sign(docs: DataFrame, width: int = SHINGLE, m: int = M) -> DataFrame:
    """(doc_id, digest, sig) of every row; no signature where the text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, texts in text_slices(b.column(1)):
                doc, h, w = multisets(texts, width)
                sig, there = signatures(doc, h, w, y - x, m), np.bincount(doc, minlength=y - x) > 0
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], b.column(2)[x:y], pa.array([s.tobytes() if ok else None for s, ok in zip(sig, there, strict=True)], pa.binary())], names=["doc_id", "digest", "sig"])

    return with_digest(docs).mapInArrow(run, "doc_id long, digest binary, sig binary")


def bags_of(docs: DataFrame, rows: DataFrame, width: int):
    """For ``linking.classes``: the multisets of the texts with given ids, of ``rows`` (id, doc_id, digest)."""

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, texts in text_slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array([o.tobytes() for o in occurrences(texts, width)], pa.binary())], names=["id", "bag"])

    def table(ids: DataFrame) -> DataFrame:
        wanted = rows.join(ids, "id").select("id", F.col("doc_id").alias("of"), F.col("digest").alias("with"))
        # By a merge at any size: the ids grow with the corpus, and so their texts are moved once.
        found = with_digest(docs).join(wanted.hint("merge"), (F.col("digest") == F.col("with")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("id", "text").dropDuplicates(["id"])
        return kept(found.mapInArrow(bags, "id long, bag binary"), "bags")

    return table


def texts_and_classes(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, m: int = M, bands: int = BANDS, band_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row; (doc_id, digest, copies, text_id, class_id) of every distinct text, doc_id the smallest of its rows."""
    signed = kept(sign(docs, width, m), "signatures")
    texts = kept(signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "texts")
    ids = kept(signed.select("doc_id", "digest"), "ids", light=True, frees=[signed])
    # Ids are unique but for rows of one id with different texts; such texts get ids of their own, below all others.
    twice = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1 or doc_id is null").withColumnRenamed("doc_id", "twice_id")
    own = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), F.col("doc_id")).when(F.col("digest") == F.col("first"), F.col("doc_id"))
    other = F.lit(-(2**62)) + F.shiftrightunsigned(F.xxhash64("digest"), 2)
    named = texts.join(twice, F.col("doc_id").eqNullSafe(F.col("twice_id")), "left").select("doc_id", "digest", "copies", "sig", F.coalesce(own, other).alias("id"))
    texts = kept(named, "text-ids", light=True, frees=[texts])
    rows = texts.select("id", "doc_id", "digest")
    plausible = similarity - SLACK * (similarity * (1 - similarity) / m) ** 0.5
    roots = classes(texts.select("id", "sig"), "<u4", bands, band_rows, agreement, plausible, bags_of(docs, rows, width), jaccard, similarity)
    found = texts.join(roots, "id", "left").select("doc_id", "digest", "copies", F.col("id").alias("text_id"), F.coalesce("root", "id").alias("class_id"))
    return ids, kept(found, "classes", light=True, frees=[texts, roots])


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, digest, text_id, class_id) of every row: text_id is the smallest id with an equal text, class_id the smallest of the near-duplicates."""
    ids, texts = texts_and_classes(docs, **options)
    return spread_join(ids, texts.drop("doc_id"), "digest", "copies").select("doc_id", "digest", "text_id", "class_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_id, class_id and whether the row's id stands for its class."""
    return groups(docs, **options).select("doc_id", "text_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest id; all columns stay as they are."""
    ids, texts = texts_and_classes(docs, **options)
    # Of a class the text of its own id stays, with the smallest id that has it; rows that repeat id and text are one.
    stays = texts.where("text_id = class_id").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col("__id")) & (F.col(b) == F.col("__of"))
    counted = kept(ids.groupBy("doc_id", "digest").count(), "rows", light=True, frees=[ids])
    drop = kept(counted.join(stays, same("doc_id", "digest"), "left_anti").select("doc_id", "digest"), "dropped", light=True)
    again = not counted.where("count > 1").isEmpty()
    freed(counted, texts)
    marked = docs.withColumn("__digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    left = marked.join(drop.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")), same("doc_id", "__digest"), "left_anti")
    if again:
        left = left.dropDuplicates(["doc_id", "__digest"])
    return left.drop("__digest")
