"""Toxicity by a weighted finite-state pattern grammar, scored clause by clause.

Words become symbols: insult, threat verb, future, target, negation, reporting verb, quotation mark, other. Small
transducers rewrite them one after another: negation turns an insult or threat inside its scope into a negated one,
reported speech (a reporting verb earlier in the clause, or open quotation marks) into a reported one, target marks an
insult that has a person close to it as directed, and threat accepts future or first person before a threat verb. They
are composed into one deterministic table, which runs over the words of each clause that holds an insult or a threat
verb. The symbols that come out, weighted by the insult's own weight, give a document's evidence.

Insults are a small list of fixed words and what is learned: words, and openings that several words share, which are
many times as frequent in toxic documents and mark them significantly. Their weights are the log of that ratio. Words that
stand in clauses with insults and mark such documents as clean or toxic join the grammar as reporting words or targets. A
document's evidence is, for each symbol that comes out, the strongest weight, and the dose: the weights of what is neither
negated nor reported, over the number of words. A logistic layer turns it into a score; it is fitted around a prior, so
that patterns without labelled cases keep sensible weights. Fitting reads at most ``sample_rows`` labelled rows, those with
the smallest hash of their id; only rows of the training folds are read.

Null text is the empty text, which gets the score of no evidence. Repeated rows are scored each. With no labels, or
labels of one class, the prior decides. Labels that contradict each other count as one toxic and one clean row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.llm.bagminhash import texts_and_classes
from tideway.llm.common import freed, kept, texts_of

#: Labelled rows that fitting reads at most, and the number of folds, of which one is kept out.
SAMPLE_ROWS = 40_000
FOLDS = 5
#: What is learned is so many times as frequent in toxic documents, stands in so many of them, and is so significant.
LEAST_RATIO, LEAST_DOCUMENTS, LEAST_SURPRISE = 6.0, 4, 28.0
#: Letters of an opening, and words in toxic documents that share it at least.
OPENINGS, KINDS = range(2, 9), 5
#: Entries that a task gathers before it sends them.
GATHERED = 300_000

# Words of the grammar, in English, German, French and Spanish.
INSULTS = """idiot idiots moron morons imbecile loser losers scum trash clown worthless pathetic disgusting stupid dumb
vermin scumbag bastard bitch asshole retard dumbass dickhead abschaum vollidiot arschloch dummkopf trottel hurensohn
missgeburt connard connasse salaud ordure crétin abruti imbécile débile gilipollas cabrón imbécil estúpido estúpida
basura escoria"""
THREATS = """kill murder hurt destroy beat stab shoot strangle burn töten umbringen schlagen erschießen vernichten tuer
frapper détruire égorger matar golpear destruir apuñalar matarte"""
FUTURE = "will ll gonna going shall i we werde werden wir ich vais allons je voy vamos voya"
TARGETS = """you your you're youre u he she they this these those everyone du dich dir ihr euch sie dein deine tu te toi
vous ton ta tú ti usted ustedes vosotros tu eres"""
NEGATIONS = "not never no none nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún"
REPORTS = """said says say saying wrote writes quoted quote reported claims claimed called calls allegedly according sagte
sagt schrieb nannte behauptet laut dit écrit affirme selon appelé dijo dice escribió llamó según afirma"""
QUOTES = "\"“”«»„"
SEED_WEIGHT = 7.0

Symbol = str  # I insult, V threat verb, F future, T target, N negation, R report, Q quote, O other; D, n, r, X, x come out
INPUTS = "IVFTNRQO"
#: What the table can give for a word: directed, plain, negated and reported insult, threat, weakened threat.
OUTPUTS = "DInrXx"


class Transducer:
    """A deterministic letter transducer: step(state, symbol) -> (state, symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def scope_of_negation(width: int = 3) -> Transducer:
    def step(left: int, s: Symbol):
        if s == "N":
            return width, "O"
        return max(0, left - 1), {"I": "n", "V": "v"}.get(s, s) if left else s

    return Transducer(0, step)


def reported_speech() -> Transducer:
    def step(state: tuple[bool, bool], s: Symbol):
        told, quoted = state
        if s == "R":
            return (True, quoted), "O"
        if s == "Q":
            return (told, not quoted), "O"
        return state, {"I": "r", "V": "v"}.get(s, s) if told or quoted else s

    return Transducer((False, False), step)


def near_target(width: int = 4) -> Transducer:
    def step(left: int, s: Symbol):
        if s == "T":
            return width, "O"
        return max(0, left - 1), "D" if s == "I" and left else s

    return Transducer(0, step)


def threat(width: int = 3) -> Transducer:
    def step(left: int, s: Symbol):
        if s == "F":
            return width, "O"
        if s in "Vv":
            return 0, {"V": "X", "v": "x"}[s] if left else "O"
        return max(0, left - 1), s

    return Transducer(0, step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What a gives goes into b."""

    def step(state, s: Symbol):
        p, mid = a.step(state[0], s)
        q, out = b.step(state[1], mid)
        return (p, q), out

    return Transducer((a.start, b.start), step)


def table(t: Transducer) -> list[dict[Symbol, tuple[int, Symbol]]]:
    """The reachable states of ``t`` as numbered rows."""
    number, rows, todo = {t.start: 0}, [], [t.start]
    while todo:
        state, row = todo.pop(0), {}
        for s in INPUTS:
            after, out = t.step(state, s)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row[s] = (number[after], out)
        rows.append(row)
    return rows


GRAMMAR = table(reduce(compose, [scope_of_negation(), reported_speech(), near_target(), threat()]))
CLASSES = {w: s for s, words in (("T", TARGETS), ("F", FUTURE), ("V", THREATS), ("R", REPORTS), ("N", NEGATIONS)) for w in words.split()}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
CLAUSE = re.compile(r"[^.!?;\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Prior of the layer: bias, weights in the order of OUTPUTS, that of the dose; how firmly it is held.
PRIOR = np.array([-3.5, 9.0, 7.0, 3.0, 2.0, 8.0, 2.0, 1.0])
HOLD = 1.0
#: Features of a document; which outputs make the dose; words that are added to its own in the dose.
FEATURES, DOSED, SHORT = len(OUTPUTS) + 1, "DIX", 10


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS.split(), SEED_WEIGHT))
    openings: dict[str, float] = field(default_factory=dict)
    context: dict[str, Symbol] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Runs the grammar over texts."""

    def __init__(self, model: Model):
        self.model, self.lengths = model, sorted({len(p) for p in model.openings})
        self.classes = model.context | CLASSES
        self.triggers = ahocorasick.Automaton()
        for w in {*model.words, *model.openings, *THREATS.split()}:
            self.triggers.add_word(w, len(w))
        self.triggers.make_automaton()

    def weight(self, word: str) -> float:
        """The insult weight of a word; 0 if it is none."""
        m = self.model
        return max(m.words.get(word, 0.0), *(m.openings.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), 0.0)

    def clauses(self, low: str) -> Iterator[list[tuple[str, Symbol, float]]]:
        """The words, symbols and insult weights of each clause of a lower-case text that may hold an insult or threat."""
        hits = [e - n + 1 for e, n in self.triggers.iter(low) if e - n < 0 or not low[e - n].isalpha()]
        hits.sort()
        for c in CLAUSE.finditer(low) if hits else ():
            k = bisect_left(hits, c.start())
            if k == len(hits):
                break
            if hits[k] >= c.end():
                continue
            out = []
            for word in TOKEN.findall(c[0]):
                s, w = "Q" if word in QUOTES else self.classes.get(word, ""), 0.0
                if not s:
                    w = self.weight(word)
                    s = "I" if w > 0 else "O"
                out.append((word, s, w))
            yield out

    def evidence(self, text: str) -> np.ndarray:
        """For each of OUTPUTS the strongest weight, squared on a scale of 0 to 1, and the dose."""
        out, dose, low = np.zeros(FEATURES), 0.0, text.lower()
        for clause in self.clauses(low):
            state = 0
            for _, s, w in clause:
                state, given = GRAMMAR[state][s]
                if (i := OUTPUTS.find(given)) >= 0:
                    w = w or SEED_WEIGHT
                    out[i] = max(out[i], w)
                    dose += w if given in DOSED else 0.0
        out = np.minimum(1.0, out / SEED_WEIGHT) ** 2
        if dose:
            out[-1] = math.log1p(100 * dose / (len(low.split()) + SHORT))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.model.weights[0] + evidence @ self.model.weights[1:])))


def fold(id_column: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text (null: the empty text), modulo ``folds``; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the sampled rows of the training folds, written once; the ids are at most ``sample_rows`` and so may be broadcast.

    Of a class of near copies one row of each label stays: copies are not evidence of their own, and would make any word of
    a much-copied toxic document look significant. A passage that distinct documents share costs none of them.
    """
    some = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 0))
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    rows = kept(rows, "toxicity-labelled", light=True)
    ids, texts = texts_and_classes(rows)
    freed(ids)
    # The sample bounds the rows of a class, and so what one task orders.
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    nth = F.row_number().over(Window.partitionBy("class_id", "toxic").orderBy("doc_id", "digest"))
    first = rows.withColumn("digest", digest).join(texts.select("digest", "class_id"), "digest").withColumn("nth", nth).where("nth = 1")
    return kept(first.select("text", "toxic"), "toxicity-sample", frees=[rows, texts])


def surprise(pos, neg, rate: float):
    """Twice the log-likelihood ratio of pos toxic among pos + neg, against the overall rate."""
    n = pos + neg
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * F.lit(share)))).otherwise(0.0)
    return 2 * (part(pos, rate) + part(neg, 1 - rate))


def fit(rows: DataFrame) -> Model:
    """A model from (text, toxic) rows, which must be few enough to be read three times.

    What is significant in so many rows, and distinct rows of evidence with their number, come to the driver.
    """
    model = Model()
    n_toxic, n = rows.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    if not 0 < n_toxic < n:
        return model
    rates: dict[tuple[str, int], float] = {}
    for r in lexicon(rows, n_toxic, n).collect():
        rates[r["entry"], r["opening"]] = (r["pos"] + 0.5) / (r["pos"] + r["neg"] + 1)
        if r["marks"]:
            (model.openings if r["opening"] else model.words)[r["entry"]] = float(r["weight"])
    for r in context(rows, model, rates).collect():
        model.context[r["word"]] = "T" if r["toxic"] else "R"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([matcher_of(model).evidence(t) for t in texts_of(b.column(0))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(FEATURES)] + [b.column(1)], names=[*(f"x{i}" for i in range(FEATURES)), "toxic"])

    got = rows.select("text", "toxic").mapInArrow(run, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", toxic int")
    counts = np.array([list(r) for r in got.groupBy(*got.columns).count().collect()], float)
    model.weights = logistic(counts[:, :FEATURES], counts[:, -2], counts[:, -1])
    return model


def lexicon(rows: DataFrame, n_toxic: int, n: int) -> DataFrame:
    """(entry, opening 0/1, weight, pos, neg, marks) of the words, and openings of words, that mark toxic rows, and of the fixed insults."""
    fields = "entry string, opening int, pos long, neg long, hits long, misses long"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                own: dict[tuple[str, int], int] = {}
                for w, times in Counter(LETTERS.findall(text.lower())).items():
                    own[w, 0] = times
                    for k in OPENINGS:
                        if len(w) >= k:
                            own[w[:k], 1] = own.get((w[:k], 1), 0) + times
                for key, times in own.items():
                    c = seen.setdefault(key, [0, 0, 0, 0])
                    c[1 - toxic] += 1
                    c[3 - toxic] += times
                if len(seen) > GATHERED:
                    yield table_of(seen)
                    seen = {}
            yield table_of(seen)

    def table_of(seen: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
        counts = np.array(list(seen.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array([e for e, _ in seen], pa.string()), pa.array([o for _, o in seen], pa.int32()), *(pa.array(counts[:, i]) for i in range(4))], names=[f.split()[0] for f in fields.split(", ")])

    counts = rows.select("text", "toxic").mapInArrow(count, fields).groupBy("entry", "opening").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "hits", "misses")))
    counts = kept(counts, "toxicity-words")
    words = counts.where("opening = 0")
    total = words.agg(F.sum("hits"), F.sum("misses")).first()
    ratio = ((F.col("hits") + 0.5) / ((total[0] or 0) + 1)) / ((F.col("misses") + 0.5) / ((total[1] or 0) + 1))
    clear = (F.col("pos") >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO) & (F.col("pos") * (n - n_toxic) > F.col("neg") * n_toxic) & (surprise(F.col("pos"), F.col("neg"), n_toxic / n) >= LEAST_SURPRISE)
    # An opening must hold for the words that do not mark by themselves as well.
    others = words.where((F.col("pos") > 0) & ~clear & (F.length("entry") >= OPENINGS[0]))
    longest = F.least(F.length("entry"), F.lit(OPENINGS[-1]))
    shared = others.select(F.explode(F.transform(F.sequence(F.lit(OPENINGS[0]), longest), lambda k: F.col("entry").substr(F.lit(1), k))).alias("entry"), "hits", "misses")
    kinds = shared.groupBy("entry").agg(F.count("*").alias("kinds"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).where((F.col("kinds") >= KINDS) & (ratio >= LEAST_RATIO))
    fixed = (F.col("opening") == 0) & F.col("entry").isin(INSULTS.split())
    marked = counts.where(clear | fixed).select("entry", "opening", F.log(ratio).alias("weight"), "pos", "neg", clear.alias("marks"))
    return marked.where("opening = 0").unionByName(marked.where("opening = 1").join(kinds, "entry", "left_semi"))


def context(rows: DataFrame, model: Model, rates: dict[tuple[str, int], float]) -> DataFrame:
    """(word, toxic 0/1): words in clauses with an insult that are toxic more, or less, often than rows with these insults are.

    ``rates`` gives for an insult the share of toxic rows among those that hold it; a row is expected to be toxic at the
    highest rate of its insults.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(model)
        for b in batches:
            seen: dict[str, list[float]] = {}
            for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                own, rate = set(), 0.0
                for clause in matcher.clauses(text.lower()):
                    insults = [w for w, s, _ in clause if s == "I"]
                    if insults:
                        own.update(w for w, s, _ in clause if s == "O")
                        keys = [(w, 0) for w in insults] + [(w[:k], 1) for w in insults for k in matcher.lengths if len(w) >= k]
                        rate = max([rate, *(rates[k] for k in keys if k in rates)])
                for w in own if rate else ():
                    c = seen.setdefault(w, [0, 0, 0.0])
                    c[1 - toxic] += 1
                    c[2] += rate
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(2)), pa.array([c[2] for c in seen.values()], pa.float64())], names=["word", "pos", "neg", "expected"])

    counts = rows.select("text", "toxic").mapInArrow(count, "word string, pos long, neg long, expected double")
    counts = counts.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("expected").alias("expected"))
    n, pos, neg, expected = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg"), F.col("expected")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    odds = (pos + 0.5) / (neg + 0.5) * (n - expected + 0.5) / (expected + 0.5)
    clear = (n >= LEAST_DOCUMENTS) & (2 * (part(pos, expected) + part(neg, n - expected)) >= LEAST_SURPRISE) & ((odds >= LEAST_RATIO) | (odds <= 1 / LEAST_RATIO))
    return counts.where(clear).select("word", (odds > 1).cast("int").alias("toxic"))


_made: dict[int, tuple[Model, Matcher]] = {}


def matcher_of(model: Model) -> Matcher:
    """The model's matcher, made once in each worker."""
    if id(model) not in _made:
        _made.clear()
        _made[id(model)] = (model, model.matcher())
    return _made[id(model)][1]


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Weights (bias first) that maximise the likelihood under a normal prior around PRIOR, by Newton's steps."""
    x, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - HOLD * (w - PRIOR)
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matcher_of(model)
            p = m.score(np.array([m.evidence(t) for t in texts_of(b.column(1))]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matcher_of(model)
            p = m.score(np.array([m.evidence(t) for t in texts_of(b.column(at))]).reshape(-1, FEATURES))
            yield b.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the labelled rows outside fold 0."""
    scored = score(docs, fit(training_rows(docs, labels, sample_rows)))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
