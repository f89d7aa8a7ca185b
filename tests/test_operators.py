"""Rules that the parity queries do not reach: refusals, edges, folds in the driver, stores and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tideway.functions import routing
from tideway.operators import aggregates, config, dedupe, ownership, positions, reader, topics, workflow, workqueue
from tideway.operators.order import numbered
from tideway.sources import store
from tideway.streaming import pipelines

ENTRY = "partition int, ms long, seq long, type string, key string"


def entries(spark, n=40, partitions=3):
    return spark.createDataFrame([(i % partitions, 1000 + i // 2, i % 2, "ab"[i % 2], f"k{i % 5}") for i in range(n)], ENTRY)


def test_numbering_needs_no_single_task(spark):
    rows = numbered(entries(spark), ["partition"], span_ms=3)
    for p in range(3):
        own = sorted((r.ms, r.seq, r.ordinal, r.total) for r in rows.where(F.col("partition") == p).collect())
        assert [r[2] for r in own] == list(range(1, len(own) + 1)) and {r[3] for r in own} == {len(own)}


def test_ids_continue_behind_the_tail(spark):
    rows = spark.createDataFrame([(0, 5, 1), (0, 9, 2), (0, 9, 3), (1, 3, 4)], "partition int, ms long, n int")
    tails = spark.createDataFrame([(0, 9, 4)], "partition int, ms long, seq long")
    got = {r.n: (r.ms, r.seq) for r in topics.assign_ids(rows, ["n"], tails).collect()}
    assert got == {1: (9, 5), 2: (9, 6), 3: (9, 7), 4: (3, 0)}


def test_routing(spark):
    rows = spark.createDataFrame([(i, 0, "" if i % 2 else f"k{i}") for i in range(20)], "ms long, seq long, key string")
    got = {r.ms: r.partition for r in topics.route(rows, 4, "ms", "seq").collect()}
    assert all(got[i] == (routing.partition_of(f"k{i}", 4) if i % 2 == 0 else (i // 2 + 1) % 4) for i in range(20))
    with pytest.raises(Exception, match="no such partition"):
        topics.route(rows.withColumn("wanted", F.lit(9)), 4, "ms", "seq", "wanted").collect()
    spread = [0] * 8
    for i in range(8000):
        spread[routing.partition_of(f"key-{i}", 8)] += 1
    assert max(abs(n - 1000) for n in spread) < 110


def test_reads_refuse_what_makes_no_sense(spark):
    e = entries(spark)
    with pytest.raises(ValueError):
        reader.read_after(e, 0, (0, 0), 0)
    with pytest.raises(ValueError):
        reader.start_positions(e, e, e, e, "stored", "stored")
    assert reader.filter_counts(e, [" ", ""]).agg(F.sum("filtered")).first()[0] == 0


def test_release(spark):
    target = lambda m, t, n: spark.range(1).select(topics.release_target(m, topics.release_at(m, t), F.lit(n)).alias("x")).first().x
    assert [target(100, 0.8, 90), target(100, 0.8, 120), target(100, 1.0, 100), target(100, 0, 50)] == [70, 80, 99, 1]
    assert topics.release_at(100, float("nan")) == 0


def test_no_consumers_no_clamp(spark):
    none = spark.createDataFrame([], "consumer string, partition int, ms long, seq long")
    got = topics.trim_report(entries(spark), none, 2_000_000, 1998, 1000).collect()
    assert all(not r.released and r.holder is None for r in got) and sum(r.kept for r in got) == 0


def test_partitions_never_shrink(spark):
    meta = spark.createDataFrame([("t", 4, 10)], "topic string, partitions int, max_len int")
    with pytest.raises(Exception, match="shrink"):
        topics.ensure_topic(meta, spark.createDataFrame([("t", 3, 10)], "topic string, partitions int, max_len int")).collect()


def test_preview_counts_what_is_read_again(spark):
    e = entries(spark)
    stored = reader.batches(e, 1000).select("partition", F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    target = (1007, 1)
    preview = positions.totals(positions.preview(e, stored, target)).first()
    again = reader.behind(e, stored.select("partition", F.lit(target[0]).cast("long").alias("ms"), F.lit(target[1]).cast("long").alias("seq"))).count()
    assert preview.to_reprocess == again and preview.to_skip == 0 and not preview.any_trimmed_away


def test_unknown_event_type_is_an_error(spark):
    with pytest.raises(Exception, match="no handler"):
        aggregates.known_types(entries(spark), ["a"]).collect()


def test_decisions():
    log = [("made", {})]
    handlers = {"made": lambda s, b: s.update(n=0), "added": lambda s, b: s.update(n=s["n"] + b["by"])}
    load = lambda: aggregates.Aggregate(handlers).load(log)

    def append(version, events):
        if version != len(log):
            return False
        log.extend(events)
        return True

    assert aggregates.decide(load, append, lambda a: a.raise_("added", by=2)) == ("done", 2)
    assert aggregates.decide(load, append, lambda a: None) == ("done", 2)
    assert aggregates.decide(load, lambda *_: False, lambda a: a.raise_("added", by=2)) == ("conflict", -1)

    def refuse(a):
        raise aggregates.Refused

    assert aggregates.decide(load, append, refuse) == ("refused", 2)
    with pytest.raises(KeyError):
        aggregates.Aggregate(handlers).load([("gone", {})])


def test_claims_against_a_loop(spark):
    rng = random.Random(3)
    rows = sorted((f"k{rng.randrange(4)}", rng.randrange(4000), i) for i in range(300))
    got = {(r.key, r.ms, r.seq): r.won for r in dedupe.claims(spark.createDataFrame(rows, "key string, ms long, seq long"), "key", 250).collect()}
    until = {}
    for k, ms, seq in rows:
        won = ms >= until.get(k, -1)
        assert got[k, ms, seq] == won
        if won:
            until[k] = ms + 250


def test_expired_marker_behind_the_mark(spark):
    rows = spark.createDataFrame([("s", 0, 10, "x"), ("s", 100, 10, "x"), ("s", 101, 11, "x"), ("s", 102, 12, "y"), ("s", 300, 13, "y")], "source string, at long, position long, dedupe_id string")
    got = sorted((r["at"], r.forwarded) for r in dedupe.forwarded_once(rows, 50).collect())
    assert got == [(0, True), (100, False), (101, True), (102, True), (300, True)]


def test_leases():
    t = ownership.Leases(8)
    assert t.cycle("a", 0, 100) == list(range(8))
    assert t.cycle("b", 1, 100) == []
    assert t.cycle("a", 2, 100) == [0, 1, 2, 3]
    assert t.cycle("b", 3, 100) == [4, 5, 6, 7]
    assert t.cycle("a", 4, 100, frozenset({1})) == [0, 2, 3] and "i:a" not in t.fields
    assert t.cycle("b", 5, 100) == [1, 4, 5, 6, 7]
    t.release("b")
    assert t.cycle("c", 200, 100) == list(range(8))


def test_ranges_tile_and_agree(spark):
    g = spark.range(24 * 8).select((F.col("id") % 24 + 1).cast("int").alias("p"), (F.col("id") / 24 + 1).cast("int").alias("c"))
    start, length = ownership.owned(F.col("p"), F.col("c"), F.col("i"))
    rows = g.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i")).select("*", start.alias("s"), length.alias("n"))
    rows = rows.where("n > 0").select("*", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("x"))
    rows = rows.withColumn("o", ownership.owner_of(F.col("x"), F.col("p"), F.col("c")))
    assert rows.where("o <> i").isEmpty()
    assert rows.groupBy("p", "c").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d")).where("n <> p or d <> p").isEmpty()


def test_config():
    assert config.topic_error({"retention_seconds": 60}) and not config.topic_error({"retention_seconds": 60, "max_len": 5})
    assert config.topic_error({"trim": "none"}) and not config.topic_error({"trim": "none"}, development=True)
    got = config.consumer_errors([{"topic": "t"}, {"topic": "t"}, {"topic": "u", "persist": "none"}, {"topic": "v", "instances": {"count": 2}}, {"topic": " "}])
    assert [bool(x) for x in got] == [False, True, True, True, True]
    assert config.reset_target(id="5-1") == ("id", (5, 1)) and config.reset_target(to="END") == ("end", None)
    assert config.reset_target()[0] == config.reset_target(id="1-1", to="end")[0] == config.reset_target(from_="soon")[0] == "error"
    assert config.reset_target(from_="2026-09-01T00:00:00Z")[0] == "date"
    assert [config.reset_status(("start", None), r, f) for r, f in ((False, False), (True, False), (True, True))] == [200, 409, 200]
    assert config.name_error("a/b", "topic") and not config.name_error("a.b:c-d_e", "topic")


def test_workflow_submits():
    answers, waits = [503, None, 202], []
    assert workflow.submit("u", b"", lambda u, b: answers.pop(0), waits.append) == ("accepted", 3) and waits == [0.2, 0.4]
    assert workflow.submit("u", b"", lambda u, b: 400, waits.append) == ("failed", 1)
    assert workflow.submit("u", b"", lambda u, b: 500, lambda s: None) == ("failed", 5)
    assert workflow.submit("u", b"", lambda u, b: 409, lambda s: None) == ("already_started", 1)


def test_acknowledging_inside_a_batch(spark):
    b = spark.createDataFrame([(0, 0, 5, 0), (0, 1, 9, 0)], "partition int, batch long, last_ms long, last_seq long")
    done = lambda ms: sorted(r.batch for r in workqueue.acknowledged(b, spark.createDataFrame([(0, ms, 0)], "partition int, ms long, seq long")).collect())
    assert [done(4), done(5), done(8), done(9), done(10)] == [[], [0], [0], [0, 1], []]


def test_store_and_outbox(spark, tmp_path):
    e = entries(spark).withColumn("topic", F.lit("t"))
    for _ in range(2):  # the second time changes nothing
        store.append(e, f"{tmp_path}/topics", 0)
    store.append(e.limit(5), f"{tmp_path}/topics", 1)
    assert store.read(spark, f"{tmp_path}/topics", "t").count() == 45
    state = spark.createDataFrame([("n", 1)], "name string, seq long")
    bad = spark.createDataFrame([("n", 0, 1)], "name string, expected long, length long")
    assert not store.outbox(state, e, f"{tmp_path}/state", f"{tmp_path}/out", 0, bad) and not (tmp_path / "out").exists()
    assert store.outbox(state, e, f"{tmp_path}/state", f"{tmp_path}/out", 0, bad.where("false"))
    assert store.read(spark, f"{tmp_path}/out").count() == 40


def test_stream_to_view_and_again(spark, tmp_path):
    e = entries(spark).withColumn("topic", F.lit("t"))
    store.append(e, f"{tmp_path}/topics", 0)
    handler = pipelines.view_writer(f"{tmp_path}/view")
    run = lambda: pipelines.start(pipelines.entries(spark, f"{tmp_path}/topics", "t", ["a"]).withColumn("view", F.col("ms")), handler, f"{tmp_path}/cp").awaitTermination()
    run()
    want = lambda t: {r.key: r.ms for r in t.where("type = 'a'").groupBy("key").agg(F.max("ms").alias("ms")).collect()}
    assert {r.key: r.view for r in pipelines.view(spark, f"{tmp_path}/view").collect()} == want(e)
    more = e.withColumn("ms", F.col("ms") + 500).limit(9)
    store.append(more, f"{tmp_path}/topics", 1)
    run()
    assert {r.key: r.view for r in pipelines.view(spark, f"{tmp_path}/view").collect()} == want(e.unionByName(more))


def test_stream_claims_equal_the_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", 40 * i, 0) for i in range(60)]
    e = spark.createDataFrame(rows, "key string, ms long, seq long").withColumns({"topic": F.lit("t"), "partition": F.lit(0), "type": F.lit("a")})
    store.append(e, f"{tmp_path}/topics", 0)
    q = pipelines.claims(pipelines.entries(spark, f"{tmp_path}/topics", "t"), 500).writeStream.format("memory").queryName("won").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.key, r.ms, r.seq, r.won)
    assert sorted(map(key, spark.table("won").collect())) == sorted(map(key, dedupe.claims(e, "key", 500).collect()))


def test_error_policies(spark):
    waits, calls, failed = [], [], []

    def flaky(rows, batch):
        calls.append(batch)
        if len(calls) < 4:
            raise pipelines.Block

    pipelines.handled(flaky, sleep=waits.append)(None, 7)
    assert calls == [7] * 4 and waits == [1.0, 2.0, 4.0]

    def broken(rows, batch):
        raise RuntimeError("no")

    pipelines.handled(broken, failed=failed)(None, 1)
    assert failed == [(1, "no")]
    with pytest.raises(RuntimeError):
        pipelines.handled(broken, "stop")(None, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ENTRY)
    pos = spark.createDataFrame([], "consumer string, partition int, ms long, seq long")
    assert topics.bounds(none).count() == reader.batches(none, 10).count() == positions.preview(none, pos, (1, 0)).count() == 0
    assert topics.tail(none, spark.createDataFrame([(0,)], "partition int")).first()[1:] == (0, 0)
    assert positions.totals(positions.preview(none, pos, (1, 0))).first()[:2] == (0, 0)


def test_views_are_merged(spark, tmp_path):
    write = pipelines.view_writer(f"{tmp_path}/v", merged_every=3)
    assert pipelines.view(spark, f"{tmp_path}/v").count() == 0
    want = {}
    for batch in (0, 1, 2, 2, 4, 5, 6):  # a batch is written again, another one is passed over
        rows = [(f"k{i % 4}", f"{batch}.{i}", batch * 10 + i, 0) for i in range(batch, batch + 3)]
        write(spark.createDataFrame(rows, "key string, view string, ms long, seq long"), batch)
        want.update({k: v for k, v, *_ in rows})
        assert {r.key: r.view for r in pipelines.view(spark, f"{tmp_path}/v").collect()} == want
    assert pipelines._numbers(spark, f"{tmp_path}/v/whole") == [5] and pipelines._numbers(spark, f"{tmp_path}/v/changes") == [6]


def test_forwarded_by_spans(spark, monkeypatch):
    import random

    from tideway.operators import dedupe

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), at, rng.randrange(200)) for at in range(300)]
    monkeypatch.setattr(dedupe, "span_width", lambda *_: 17)
    got = {r.at: r.forwarded for r in dedupe.forwarded(spark.createDataFrame(rows, "source string, at long, position long")).collect()}
    marks, want = {}, {}
    for source, at, position in rows:
        want[at] = source not in marks or position > marks[source]
        marks[source] = max(position, marks.get(source, -1))
    assert got == want


def test_claims_jump(spark):
    import random

    from tideway.operators import dedupe

    rng = random.Random(5)
    rows = sorted((rng.choice("abc"), rng.randrange(2_000), i) for i in range(500))
    got = {(r.key, r.ms, r.seq): r.won for r in dedupe.claims(spark.createDataFrame(rows, "key string, ms long, seq long"), "key", 90).collect()}
    until = {}
    for key, ms, seq in rows:
        won = ms >= until.get(key, -1)
        until[key] = ms + 90 if won else until[key]
        assert got[key, ms, seq] == won
    assert dedupe.claims(spark.createDataFrame([], "key string, ms long, seq long"), "key", 90).count() == 0


def test_clamp_and_lags_against_loops(spark):
    import random

    from tideway.operators import health, topics

    rng = random.Random(7)
    ids = {(p, rng.randrange(50_000), s) for p in range(4) for s in range(3) for _ in range(40)}
    entries_ = spark.createDataFrame(sorted(ids), "partition int, ms long, seq long")
    held = [(c, p, rng.randrange(50_000), rng.randrange(3)) for c in ("a", "b", "c", "d") for p in range(4) if (c, p) not in {("c", 1), ("a", 2), ("d", 2)}]
    at = spark.createDataFrame(held, "consumer string, partition int, ms long, seq long")
    got = {r.partition: (r.clamp_ms, r.clamp_seq, r.holder) for r in topics.clamp(at, spark.range(5).selectExpr("cast(id as int) partition")).collect()}
    by = {(c, p): (m, s) for c, p, m, s in held}
    assert got == {p: min((*by.get((c, p), (0, 0)), c) for c in "abcd") for p in range(5)}
    assert topics.clamp(at.where("false"), spark.range(5).selectExpr("cast(id as int) partition")).count() == 0
    behind = health.entries_behind(entries_, at.withColumnsRenamed({"ms": "pm", "seq": "ps"}), span_ms=7_000)
    assert {(r.consumer, r.partition): r.entries for r in behind.collect()} == {(c, p): sum(q == p and (m, s) > own for q, m, s in ids) for (c, p), own in by.items()}


def test_stores_and_ids(spark):
    from tideway.operators import aggregates, positions

    rows = spark.createDataFrame([("t", "c", 0, 5, 1), ("t", "c", 1, 6, 0)], positions.POSITION)
    none, memory = positions.NoStore(), positions.MemoryStore()
    for store_ in (none, memory):
        store_.save(rows)
        store_.save(rows.where("partition = 0").selectExpr("topic", "consumer", "partition", "ms + 1 ms", "seq"))
    assert none.load(spark).count() == 0 and sorted(map(tuple, memory.load(spark).collect())) == [("t", "c", 0, 6, 1), ("t", "c", 1, 6, 0)]
    assert aggregates.bind_id(None, "x") == aggregates.bind_id("x", "x") == "x"
    for bound, id_ in ((None, " "), (None, ""), ("x", "y")):
        with pytest.raises(ValueError):
            aggregates.bind_id(bound, id_)


def test_groups_keep_what_they_have(spark):
    from tideway.operators import workqueue

    ddl = "topic string, partition int, member_group string, ms long, seq long"
    there, wanted = spark.createDataFrame([("t", 0, "g", 9, 1)], ddl), spark.createDataFrame([("t", 0, "g", 0, 0), ("t", 1, "g", 0, 0)], ddl)
    assert sorted(map(tuple, workqueue.created(there, wanted).collect())) == [("t", 0, "g", 9, 1, False), ("t", 1, "g", 0, 0, True)]


@pytest.mark.parametrize("span", [10, 700, 100_000])
def test_newest_by_spans(spark, span):
    rng = random.Random(span)
    rows = sorted({(p, rng.randrange(3_000), s) for p in range(3) for s in range(2) for _ in range(60)})
    df = spark.createDataFrame(rows, "partition int, ms long, seq long")
    limits = spark.createDataFrame([(0, 17), (1, 1_000)], "partition int, most long")
    want = [r for p, most in ((0, 17), (1, 1_000)) for r in [x for x in rows if x[0] == p][-most:]]
    assert sorted(map(tuple, topics.newest(df, limits, span).collect())) == want


def test_previous_by_spans(spark):
    from tideway.operators import order

    rng = random.Random(2)
    rows = [(rng.randrange(3), at, rng.choice(["x", "y", None])) for at in range(200)]
    df = spark.createDataFrame(rows, "partition int, at long, writer string")
    last, want = {}, {}
    for p, at, w in rows:
        want[at], last[p] = last.get(p), w
    for width in (9, 1_000):
        assert {r.at: r.before for r in order.previous(df, ["partition"], "at", "writer", width).collect()} == want
