"""Operators on whole corpora against brute force."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.llm import bagminhash, common, edit_embedding, learned_partitions, linking, ngram_lm, toxicity
from tideway.llm import queries as Q


def words(rng, n, vocabulary=400):
    return ["w%d" % rng.randrange(vocabulary) for _ in range(n)]


def roots(pairs, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_classes(docs, least=0.8):
    """Classes of (id, text) by all pairs."""
    first = {}
    for i, t in docs:
        first[t] = min(i, first.get(t, i))
    ids = sorted(first.values())
    bags = {i: o.tobytes() for i, o in zip([first[t] for t in first], bagminhash.occurrences(list(first)), strict=True)}
    pairs = [(a, b) for x, a in enumerate(ids) for b, j in zip(ids[:x], bagminhash.jaccard(bags[a], [bags[b] for b in ids[:x]]) if x else (), strict=False) if j >= least]
    own = roots(pairs, ids)
    return {i: own[first[t]] for i, t in docs}


# --- BagMinHash -------------------------------------------------------------------------------------------------------


def test_multisets_count_occurrences():
    doc, h, w = bagminhash.multisets(["a b c d e a b c d e a b c d e", "", "x y", None or ""])
    assert Counter(doc.tolist()) == {0: 5, 2: 1} and sorted(w[doc == 0]) == [2, 2, 2, 2, 3] and w[doc == 2].tolist() == [1]
    x, y = bagminhash.occurrences(["a a a a a a a", "a a a a a a"])
    assert bagminhash.jaccard(x.tobytes(), [y.tobytes(), x.tobytes(), b""]).tolist() == [2 / 3, 1, 0]


def test_signatures_are_unbiased():
    rng, errors, spread = random.Random(4), [], []
    for k in range(80):
        a = words(rng, 120)
        b = [rng.choice(a) if rng.random() < 0.05 else w for w in a]
        if k % 2:  # heavy weights
            a, b = a + ["r"] * rng.randrange(5, 300), b + ["r"] * rng.randrange(5, 300)
        texts = [" ".join(a), " ".join(b)]
        doc, h, w = bagminhash.multisets(texts)
        s = bagminhash.signatures(doc, h, w, 2)
        x, y = bagminhash.occurrences(texts)
        j = bagminhash.jaccard(x.tobytes(), [y.tobytes()])[0]
        errors.append(bagminhash.agreement(s[:1], s[1:])[0] - j)
        spread.append(j * (1 - j) / bagminhash.M)
    assert abs(np.mean(errors)) < 3 * math.sqrt(np.mean(spread) / len(errors)) and np.mean(np.square(errors)) < 1.5 * np.mean(spread)


def corpus(rng):
    docs = []
    for _ in range(60):
        docs.append(" ".join(words(rng, rng.randrange(1, 200), 4000)))
    base = words(rng, 120, 4000)
    for _ in range(120):  # a group of near copies, from very near to far
        own = list(base)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = "z%d" % rng.randrange(99)
        docs.append(" ".join(own))
    docs += [docs[3]] * 40 + ["", "", "one two", "one two", "One two", "rep " * 3000, "rep " * 2900]
    passage = words(rng, 60, 4000)
    docs += [" ".join(words(rng, 60, 4000) + passage + words(rng, 60, 4000)) for _ in range(40)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def small_bounds(monkeypatch):
    """Bounds at which a small table has hot keys, several blocks and too many edges for one task."""
    for module, name, value in ((linking, "BLOCK", 7), (linking, "FEW", 10), (linking, "COMMON", 5), (common, "COMMON", 5)):
        monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_against_all_pairs(spark, small, monkeypatch):
    if small:
        small_bounds(monkeypatch)
    docs = corpus(random.Random(6))
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string").repartition(5)
    got = bagminhash.near_duplicates(table).collect()
    want = near_classes(docs)
    assert {r.doc_id: r.class_id for r in got} == want and all(r.stays == (r.doc_id == r.class_id) for r in got)
    kept = bagminhash.deduplicate(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicate_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (4, "p q r", "a"), (4, "s t u", "b"), (None, "lone row here", "c"), (7, "w " * 50_000, "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = bagminhash.near_duplicates(table).collect()
    assert len(got) == len(rows)
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, (x for x in classes.values() if None not in x)))[:2] == [[1, 2], [3]]
    left = sorted(bagminhash.deduplicate(table).select("doc_id", "text").collect(), key=str)
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in left) == [(0, "lone "), (1, ""), (3, "x y z"), (4, "p q r"), (4, "s t u"), (7, "w w w")]
    assert bagminhash.near_duplicates(table.where("false")).count() == 0 and bagminhash.deduplicate(table.where("false")).count() == 0


def test_registers_are_guarded():
    one = np.zeros(1, np.int64), np.ones(1, np.uint64), np.ones(1)
    for m in (0, 3, 100, 512):
        with pytest.raises(ValueError):
            bagminhash.signatures(*one, 1, m)
    assert bagminhash.signatures(*one, 1, 256).shape == (1, 256)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "COMMON", 10)
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(300)] + [(99, 1000)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 99").withColumn("w", F.col("k") * 10)
    got = common.spread_join(left, right, "k", "n")
    assert got.columns == ["k", "v", "n", "w"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_tables_are_deleted(spark, data, tmp_path):
    def there():
        root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        return {x for x in os.listdir(root)}

    before = there()
    got = bagminhash.deduplicate(spark.read.parquet(f"{data}/documents.parquet"))
    assert got.count() > 0
    assert {x.rsplit("-", 1)[0] for x in there() - before} == {"dropped"}  # what the result reads


@pytest.mark.parametrize("small", [False, True])
def test_components(spark, small, monkeypatch):
    if small:
        small_bounds(monkeypatch)
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    ids = {x for p in pairs for x in p}
    got = {r.id: r.root for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(pairs, ids)
    assert got == {i: r for i, r in want.items() if i in got} and all(want[i] == i for i in ids - set(got))


# --- language model ---------------------------------------------------------------------------------------------------


def brute_scores(docs, held=2, folds=7):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == held
    train = [tokens(t) for i, t in docs if not is_held(i)]
    c = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip(["start", *x], x, strict=False))
    behind, total, kinds = Counter(w for _, w in pairs), Counter(), defaultdict(lambda: [0, 0, 0])
    for (u, _), n in pairs.items():
        total[u] += n
        kinds[u][min(n, 3) - 1] += 1
    number = lambda counts: [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
    dw, dp = ngram_lm._discounts(number(behind)), ngram_lm._discounts(number(pairs))
    n, v, all_ = sum(c.values()), len(c), len(pairs)
    mass = sum(dw[min(x, 3) - 1] for x in behind.values()) / max(1, all_)
    less = lambda x, d: max(x - d[min(x, 3) - 1], 0) if x else 0
    one = lambda w: less(behind[w], dw) / max(1, all_) + mass / (v + 1)
    two = lambda u, w: less(pairs[u, w], dp) / total[u] + sum(a * b for a, b in zip(kinds[u], dp, strict=True)) / total[u] * one(w) if total[u] else one(w)
    for i, t in docs:
        x = tokens(t)
        yield i, is_held(i), len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(two(u, w)) for u, w in zip(["start", *x], x, strict=False))
    assert abs(sum(two("start", w) for w in c) + (two("start", "new") if "new" not in c else 0) - 1) < 1e-9


def test_model_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 60), 80)).replace("w1", "W1\t")) for i in range(200)] + [(500, None), (501, ""), (502, "nur neue\x0bWörter"), (502, "nur neue\x0bWörter"), (None, "w1 w2")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(4)
    got = sorted((tuple(r)[:7] for r in ngram_lm.held_out_scores(table).collect()), key=str)
    for a, b in zip(got, sorted(brute_scores(docs), key=str), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def brute_scores_of_order(docs, order, held=2, folds=7):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    train = [["start", *tokens(t)] for i, t in docs if zlib.crc32(("" if i is None else str(i)).encode()) % folds != held]
    raw = {k: Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in range(1, order + 1)}
    counts = {order: raw[order]}
    for k in range(order - 1, 0, -1):  # the distinct words before, or how often a text starts so
        counts[k] = Counter(g[1:] for g in raw[k + 1]) + Counter({g: n for g, n in raw[k].items() if g[0] == "start" and k > 1})
    d = {k: ngram_lm._discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    after = defaultdict(list)
    for c in counts.values():
        for g, n in c.items():
            after[g[:-1]].append(n)
    v = len(counts[1])

    def p(context, w):
        k, of = len(context) + 1, after[context]
        lower = p(context[1:], w) if context else 1 / (v + 1)
        if not of:
            return lower
        n = counts[k][(*context, w)]
        return (max(n - d[k][min(n, 3) - 1], 0) if n else 0) / sum(of) + sum(d[k][min(x, 3) - 1] for x in of) / sum(of) * lower

    for i, t in docs:
        x = ["start", *tokens(t)]
        yield i, len(x) - 1, sum(math.log10(p(tuple(x[max(0, j - order + 1) : j]), x[j])) for j in range(1, len(x)))
    assert abs(sum(p(("w3", "w4")[: order - 1], w) for (w,) in [*counts[1], ("new",)]) - 1) < 1e-9


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longer_models_against_brute_force(spark, order):
    rng = random.Random(9)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 60), 12))) for i in range(150)] + [(i, "w1 w2 w3") for i in range(400, 900)] + [(1000, None), (1001, "w1"), (1002, "neu w1 w2 neu"), (None, "w1 w2")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in ngram_lm.held_out_scores(table, order=order).collect()), key=str)
    for a, b in zip(got, sorted(brute_scores_of_order(docs, order), key=str), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_keys_of_pairs():
    rng = np.random.default_rng(2)
    for b in (2, 9, 21, 23, 32):
        u, w = (rng.integers(0, 1 << b, 3000, dtype=np.uint64) for _ in range(2))
        key = ngram_lm.pair_keys(u, w, b)
        assert all((x == y).all() for x, y in zip(ngram_lm.pairs_of(key, b), (u, w), strict=True))
        for bits in (1, 6, 10):
            shard = int(key[0] >> np.uint64(64 - bits))
            own = key[(key >> np.uint64(64 - bits)) == shard]
            assert (ngram_lm.outside(shard, ngram_lm.inside(own, 2 * b, bits), 2 * b, bits) == own).all()
        for own in (key, (key >> np.uint64(40)) << np.uint64(40)):  # the latter share their first bits
            order = ngram_lm.in_order(own, w, 2 * b, b)
            assert (order == order).all() and (np.diff(own[order].astype(float)) >= 0).all()
            same = own[order][1:] == own[order][:-1]
            assert (w[order][1:][same] >= w[order][:-1][same]).all()
    x, n = rng.integers(0, 50, 400, dtype=np.uint64), rng.integers(1, 30, 400)
    want = Counter()
    for a, c in zip(x.tolist(), n.tolist(), strict=True):
        want[a] += c
    k, c = ngram_lm.tally(x, n)
    assert dict(zip(k.tolist(), c.tolist(), strict=True)) == want and (np.diff(k.astype(int)) > 0).all()


def test_stored_keys_and_followers(tmp_path):
    """Large shards: tables of keys and followers against dictionaries."""
    rng = np.random.default_rng(4)
    for b, many in ((8, 40_000), (23, 40_000), (31, 3_000)):
        model = ngram_lm.Model(f"file://{tmp_path}/m{b}", 1, (0, 1 << (b - 1)), 1, ((0.5, 1.0, 1.5),) * 3, 1, 1.0)
        assert model.id_bits == b
        top = min(1 << (b - 1), 200)
        ids = [rng.integers(0, top, many), rng.integers(0, top, many), rng.integers(0, 40, many)]
        ids[0][: many // 3] = ids[1][: many // 3] = 7  # a context with many followers
        ids[2][: many // 3] = np.arange(many // 3) % (1 << (b - 1))
        seen = Counter(zip(*(x.tolist() for x in ids), strict=True))
        u, v, w = (np.array(x, np.uint64) for x in zip(*seen, strict=True))
        n, key = np.array(list(seen.values())), ngram_lm.pair_keys(u, v, b)
        for s in (0, 1):
            own = np.flatnonzero((key >> np.uint64(63)) == s)
            own = own[ngram_lm.in_order(key[own], w[own], 2 * b, b)]
            ngram_lm.put(f"{model.folder}/gram3-{s:05d}", ngram_lm.layout(key[own], w[own], n[own], 2 * b, 1))
        by = defaultdict(list)
        for (x, y, z), c in seen.items():
            by[x, y].append(c)
        asked = list(seen)[:: max(1, len(seen) // 3000)] + [(x, y, 45) for x, y, _ in list(seen)[:500]] + [(top, top, 1), (0, top, 2)]
        got = ngram_lm.Shards(model).followers(3, ngram_lm.pair_keys(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]), b), np.array([a[2] for a in asked]))
        want = [[seen.get(a, 0), sum(f := by.get(a[:2], [])), f.count(1), f.count(2), sum(c > 2 for c in f)] for a in asked]
        assert got.tolist() == want


def test_model_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.held_out_scores(none).count() == 0
    model = ngram_lm.train(none.select("text"))
    only = ngram_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.score) == (3, 0, 0, 0)
    a, b, c = np.arange(70_000, dtype=np.uint64) * 977, np.arange(70_000), np.arange(0)
    assert all((x == y).all() for x, y in zip(ngram_lm.unpack(ngram_lm.pack(a, b), "<u8", "<i8"), (a, b), strict=True)) and len(ngram_lm.unpack(ngram_lm.pack(c), "<i8")[0]) == 0


def test_model_learns(spark, data):
    got = Q.op8_ngram_lm(spark, data).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def exact(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        yield int(ids[q]), [int(ids[j]) for j in order], [float(d[j]) for j in order]


def test_recall_and_distances(spark, monkeypatch):
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16))
    x[1000:2500] = x[1000]  # copies
    rows = list(enumerate(x.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = defaultdict(list)
    for r in learned_partitions.search(table, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, ids, d in exact(rows):
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 11)) and [s for *_, s in own] == sorted(s for *_, s in own)
        assert all(s == pytest.approx(math.dist(x[q], x[i]), rel=1e-12) for _, i, s in own)
        if q in range(1000, 2500):
            assert [i for _, i, _ in own] == ids  # ties go to the smaller id
        hit, total = hit + len(set(ids) & {i for _, i, _ in own}), total + 10
    assert hit / total >= 0.9
    router = learned_partitions.fit(x[rng.choice(8000, 3000, False)], 8)
    assert 1 <= router.probes < 8


def recall(spark, x, k=10):
    """Share of the nearest neighbours found, and of the vectors that queries were compared with, in their parts."""
    rows = list(enumerate(x.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(set)
    for r in learned_partitions.search(table, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    asked = np.arange(0, len(x), 100)
    near = learned_partitions.nearest(x[asked], x, k + 1)
    return sum(len({*n.tolist()} - {q} & got[q]) for q, n in zip(asked.tolist(), near, strict=True)) / (k * len(asked))


def test_two_levels_of_parts(spark, monkeypatch):
    """Few parts for each network, so that a small table needs two levels of them."""
    monkeypatch.setattr(learned_partitions, "MOST_PARTS", 8)
    monkeypatch.setattr(learned_partitions, "PART_ROWS", 60)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12)) * 4
    x = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 12))
    tree = learned_partitions.grow(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, vector array<double>"), len(x), 10, 1000)
    assert len(tree.below) == 8 and all(r.parts > 1 for r in tree.below.values())
    leaf = tree.place(x)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    assert len(np.unique(leaf)) > 16 and all(p in w for p, w in zip(leaf[:50], tree.ways(x[:50], sizes), strict=True))
    seen = [sizes[w].sum() / len(x) for w in tree.ways(x[::100], sizes)]
    assert np.mean(seen) < 0.5
    assert recall(spark, x) >= 0.9


def test_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in learned_partitions.search(table, F.col("vec_id") % 100 == 0, k=2).collect())
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            others = sorted((math.dist(v, w), j) for n, (j, w) in enumerate(rows) if n != i)[:2]
            want.update((q, r, j, d) for r, (d, j) in enumerate(others, 1))
    assert got == want


def test_small_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [1.0, float("inf")], 1), (6, [1.0], 1), (7, [1.0, 1.0], 1), (100, [3.0, 4.0], 1), (200, [0.0, 0.0], 1), (8, [1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in learned_partitions.search(table, F.col("vec_id") % 100 == 0).collect())
    good = [(i, v) for i, v, _ in rows if i in (0, 7, 8, 100)]
    assert got == sorted((q, n + 1, i, d) for q, ids, ds in exact(good) for n, (i, d) in enumerate(zip(ids, ds, strict=True)))
    assert learned_partitions.search(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(1200, 8))
    label = learned_partitions.balanced_parts(learned_partitions.nearest(x, x, 11), 6)
    assert label.min() >= 0 and np.bincount(label, minlength=6).max() <= math.ceil(200 * 1.05)


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline
    from tideway.llm import pii

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash near-dedup", "pii", "best-fit packing"]
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{data}/labels.parquet")))
    matcher = model.matcher()
    clean = [i for i, r in rows.items() if matcher.score(matcher.evidence(r["text"] or "")[None, :])[0] < 0.5]
    kept = sorted(set(near_classes([(i, rows[i]["text"] or "") for i in clean]).values()))
    at = docs
    for name, want in (("toxicity", clean), ("minhash near-dedup", kept), ("pii", kept)):
        at = stages[name](spark, at, data)
        assert at.columns == docs.columns and sorted(r.doc_id for r in at.select("doc_id").collect()) == sorted(want)
    for r in at.collect():
        text = pii.masked(rows[r.doc_id]["text"], pii.find(rows[r.doc_id]["text"]))
        assert (r.text, r.n_chars, r.lang) == (text, len(text), rows[r.doc_id]["lang"])
    got = corpus_pipeline.run(spark, data)
    assert sorted({r.doc_id for r in got.select("doc_id").collect()}) == kept and got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_edges(spark, tmp_path):
    """Null texts and ids, repeated rows and empty tables pass through all stages."""
    import corpus_pipeline

    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "some words of text here", None, None, 23), (3, "some words of text here", None, None, 23), (None, "a row without an id of its own", "en", "b", 30), (None, None, None, None, None), (7, "mail me@here.org " + "x " * 5_000, "en", "a", 1)]
    for name, docs, labels in (("some", rows, [(3, 1, 0), (None, 0, 1), (99, 0, 1)]), ("none", [], [])):
        spark.createDataFrame(docs, ddl).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    # Null texts are empty ones, and so copies of each other: the row of the smallest id stays.
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == [(False, 1), (False, 3), (False, 7), (True, 0)]
    assert sum(r.length for r in got if r.doc_id == 1) == 1 and corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_fingerprint_links_against_all_pairs(spark):
    rng = random.Random(9)
    docs = []
    for g in range(25):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(300, 900)))
        docs.append(base)
        for _ in range(g % 5):  # from very near to farther copies
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = "z"
            docs.append("".join(own))
    docs += [docs[0], docs[0], "", "", "kurz"]
    prints = edit_embedding.fingerprints(docs)
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if docs[a] and docs[b] and edit_embedding.likeness(prints[a : a + 1], prints[b : b + 1])[0] >= edit_embedding.LIKENESS]
    want = roots(pairs, range(len(docs)))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in edit_embedding.near_links(table).collect()}
    assert len(set(want.values())) < len(docs) - 20 and {i: c for i, c in got.items() if docs[i]} == {i: c for i, c in want.items() if docs[i]}


def test_entry_without_this_subpackage(spark):
    import subprocess
    import sys

    code = "import sys\nclass No:\n  def find_spec(s, n, *a):\n    if n.startswith('tideway.llm') or n == 'corpus_pipeline': raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'project_map' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Q.__file__.rsplit("/tideway/", 1)[0], check=False).returncode == 0
