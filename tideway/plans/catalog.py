"""The registered queries of the event-stream operators. Each is thin: a fixture relation, one operator, named columns."""

from __future__ import annotations

import re
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.functions import bodies, codec, ids, routing, texts
from tideway.operators import aggregates, config, dedupe, delivery, health, ownership, positions, projections, reader, topics, workflow, workqueue
from tideway.operators.order import numbered
from tideway.sources import fixtures as X
from tideway.sources import store
from tideway.sources.fixtures import NOW_MS, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col
GUIDS = [f"{i:08x}-0000-4000-8000-000000000000" for i in range(1, 5)]
PIVOT = (1_705_276_800_000, 0)
TYPES = ["purchase", "signup"]


def query(oracle: str | None = None):
    def add(f: Callable[[DataFrame, SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(X.events(spark, sf_dir), spark, sf_dir)
        if oracle:
            SQL[f.__name__] = re.sub(r"\bat\b", '"at"', oracle)  # a keyword to the SQL engine
        return f

    return add


# --- ids, entries, headers, texts -------------------------------------------------------------------------------------

ID_TEXTS = """CASE event_id % 8 WHEN 0 THEN ms || '-' || seq WHEN 1 THEN '-' WHEN 2 THEN ms || '-' WHEN 3 THEN '-1' WHEN 4 THEN '1-2-3'
  WHEN 5 THEN ' 1-2' WHEN 6 THEN '007-' || event_id ELSE '9223372036854775808-0' END"""


@query(sql("entry", body=f""", t AS (SELECT event_id, {ID_TEXTS} AS text FROM entry),
  p AS (SELECT *, CASE WHEN regexp_full_match(text, '[0-9]+-[0-9]+') THEN TRY_CAST(split_part(text, '-', 1) AS BIGINT) END AS a,
    CASE WHEN regexp_full_match(text, '[0-9]+-[0-9]+') THEN TRY_CAST(split_part(text, '-', 2) AS BIGINT) END AS b FROM t)
  SELECT event_id, text, a IS NOT NULL AND b IS NOT NULL AS valid, CASE WHEN b IS NOT NULL THEN a END AS ms, CASE WHEN a IS NOT NULL THEN b END AS seq FROM p"""))  # fmt: skip
def id_parse(e, spark, sf_dir):
    rows = e.select("event_id", F.expr(ID_TEXTS).alias("text")).withColumn("id", ids.parse(C("text")))
    return rows.select("event_id", "text", C("id").isNotNull().alias("valid"), "id.ms", "id.seq")


@query(sql("entry", body="SELECT event_id, ms || '-' || seq AS id FROM entry"))
def id_format(e, spark, sf_dir):
    return e.select("event_id", ids.text(C("ms"), C("seq")).alias("id"))


@query(sql("entry", body=f"""SELECT partition, count(*) FILTER (WHERE (ms, seq) < ({PIVOT[0]}, {PIVOT[1]})) AS before, count(*) FILTER (WHERE (ms, seq) >= ({PIVOT[0]}, {PIVOT[1]})) AS at_or_after,
  max(ms) FILTER (WHERE (ms, seq) < ({PIVOT[0]}, {PIVOT[1]})) AS last_before FROM entry GROUP BY partition"""))
def id_order(e, spark, sf_dir):
    less = ids.pair(C("ms"), C("seq")) < ids.pair(*PIVOT)
    return e.groupBy("partition").agg(F.count_if(less).alias("before"), F.count_if(~less).alias("at_or_after"), F.max(F.when(less, C("ms"))).alias("last_before"))


@query(sql("entry", body="SELECT event_id, epoch_ms(epoch_ms(ms)) AS first_ms, CAST(0 AS BIGINT) AS first_seq, strftime(epoch_ms(ms), '%Y-%m-%d %H:%M:%S') AS enqueued FROM entry"))
def id_time(e, spark, sf_dir):
    first = ids.from_time(ids.time_of(C("ms")))
    return e.select("event_id", first["ms"].alias("first_ms"), first["seq"].alias("first_seq"), F.date_format(ids.time_of(C("ms")), "yyyy-MM-dd HH:mm:ss").alias("enqueued"))


@query(sql("entry", body=f"""SELECT event_id, CASE WHEN seq > 0 THEN ms WHEN ms > 0 THEN ms - 1 ELSE 0 END AS before_ms, CASE WHEN seq > 0 THEN seq - 1 WHEN ms > 0 THEN {ids.MOST} ELSE 0 END AS before_seq,
  ms AS next_ms, seq + 1 AS next_seq FROM entry"""))
def id_neighbours(e, spark, sf_dir):
    a, b = ids.before(C("ms"), C("seq")), ids.following(C("ms"), C("seq"))
    return e.select("event_id", a["ms"].alias("before_ms"), a["seq"].alias("before_seq"), b["ms"].alias("next_ms"), b["seq"].alias("next_seq"))


def _headers(e: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.lit("user").alias("key"), C("key").alias("value")), F.struct(F.lit("kind").alias("key"), C("type").alias("value")), F.struct(F.lit("user").alias("key"), F.lit("é").alias("value")))
    return e.withColumn("headers", F.when(C("event_id") % 3 > 0, pairs).otherwise(F.expr("cast(array() as array<struct<key:string,value:string>>)")))


PACKED = "CASE WHEN event_id % 3 > 0 THEN '4:user' || length(key) || ':' || key || '4:kind' || length(type) || ':' || type || '4:user2:é' ELSE '' END"


@query(sql("entry", body=f", p AS (SELECT event_id, {PACKED} AS packed FROM entry) SELECT event_id, packed, octet_length(encode(packed)) AS bytes FROM p"))
def header_pack(e, spark, sf_dir):
    return _headers(e).select("event_id", codec.pack_headers(C("headers")).alias("p")).select("event_id", C("p").cast("string").alias("packed"), F.octet_length("p").cast("long").alias("bytes"))


@query(sql("entry", body="SELECT event_id, CAST(CASE WHEN event_id % 3 > 0 THEN 3 ELSE 0 END AS BIGINT) AS n, CASE WHEN event_id % 3 > 0 THEN 'user=' || key || ';kind=' || type || ';user=é' ELSE '' END AS pairs FROM entry"))
def header_unpack(e, spark, sf_dir):
    rows = _headers(e).select("event_id", codec.unpack_headers(codec.pack_headers(C("headers"))).alias("h"))
    return rows.select("event_id", F.size("h").cast("long").alias("n"), F.array_join(F.transform("h", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("pairs"))


@query(sql("entry", body="SELECT event_id, CASE WHEN event_id % 3 > 0 THEN key END AS first_user, CASE WHEN event_id % 3 > 0 THEN 'é' END AS last_user, CAST(CASE WHEN event_id % 3 > 0 THEN 2 ELSE 0 END AS BIGINT) AS names FROM entry"))
def header_lookup(e, spark, sf_dir):
    rows = _headers(e).withColumn("map", codec.header_map(C("headers")))
    return rows.select("event_id", codec.header(C("headers"), "user").alias("first_user"), C("map")["user"].alias("last_user"), F.size("map").cast("long").alias("names"))


@query(sql("entry", body=f"SELECT event_id, 'b=' || hex(encode(body)) || ';t=' || hex(encode(type)) || ';k=' || hex(encode(key)) || CASE WHEN event_id % 3 > 0 THEN ';h=' || hex(encode({PACKED})) ELSE '' END AS fields FROM entry"))
def entry_encode(e, spark, sf_dir):
    none = F.lit(None).cast("string")
    f = codec.encode(C("body"), C("type"), C("key"), none, none, C("headers"))
    return _headers(e).select("event_id", F.array_join(F.transform(f, lambda x: F.concat(x["name"], F.lit("="), F.hex(x["value"]))), ";").alias("fields"))


@query(sql("entry", body="SELECT event_id, body, type, key, CASE WHEN event_id % 2 = 0 THEN 'c-' || event_id ELSE '' END AS correlation_id, CASE WHEN event_id % 3 > 0 THEN 3 ELSE 0 END AS n_headers FROM entry"))
def entry_decode(e, spark, sf_dir):
    corr = F.when(C("event_id") % 2 == 0, F.concat(F.lit("c-"), C("event_id").cast("string")))
    rows = _headers(e).select("event_id", codec.encode(C("body"), C("type"), C("key"), corr, F.lit(None).cast("string"), C("headers")).alias("f")).withColumn("d", codec.decode(C("f")))
    return rows.select("event_id", C("d.body").cast("string").alias("body"), "d.type", "d.key", "d.correlation_id", F.size(codec.unpack_headers(C("d.packed_headers"))).alias("n_headers"))


@query(sql("entry", body="SELECT event_id, 'entry ' || ms || '-' || seq || '  partition ' || partition || '  topic events' AS first_line, length(body) AS bytes, left(body, 48) AS shown FROM entry"))
def dump_entry(e, spark, sf_dir):
    d = codec.dump(C("topic"), C("partition"), ids.text(C("ms"), C("seq")), C("type"), C("key"), C("body"))
    rows = e.select("event_id", F.split(d, "\n").alias("l"), F.octet_length("body").cast("long").alias("bytes"))
    return rows.select("event_id", F.get("l", F.lit(0)).alias("first_line"), "bytes", F.trim(F.get("l", F.size("l") - 2)).alias("shown"))


POSITION_TEXT = f"CASE event_id % 4 WHEN 0 THEN ms || '-' || seq || '|{GUIDS[0].upper()}' WHEN 1 THEN ms || '-' || seq WHEN 2 THEN ms || '-' || seq || '|nobody' ELSE 'x|{GUIDS[0]}' END"


@query(sql("entry", body=f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ms END AS ms, CASE WHEN event_id % 4 < 3 THEN seq END AS seq, CASE WHEN event_id % 4 = 0 THEN '{GUIDS[0]}' WHEN event_id % 4 < 3 THEN '{texts.NO_GUID}' END AS instance_id FROM entry"))
def position_parse(e, spark, sf_dir):
    return e.select("event_id", texts.position(F.expr(POSITION_TEXT)).alias("p")).select("event_id", "p.ms", "p.seq", "p.instance_id")


MARKER_TEXT = "CASE event_id % 3 WHEN 0 THEN ms || '-' || seq || '|2026-10-25T14:00:00.5000000+02:00' WHEN 1 THEN ms || '-' || seq ELSE ms || '-' || seq || '|yesterday' END"


@query(sql("entry", body="""SELECT event_id, '__reset:' || partition AS field, CASE WHEN event_id % 3 < 2 THEN ms END AS ms, CASE WHEN event_id % 3 < 2 THEN seq END AS seq,
  CASE event_id % 3 WHEN 0 THEN '2026-10-25T14:00:00.5000000+02:00' WHEN 1 THEN '0001-01-01T00:00:00.0000000+00:00' END AS issued FROM entry"""))
def marker_parse(e, spark, sf_dir):
    return e.select("event_id", texts.marker_field(C("partition")).alias("field"), texts.marker(F.expr(MARKER_TEXT)).alias("m")).select("event_id", "field", "m.ms", "m.seq", "m.issued")


@query(sql("entry", body=f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{GUIDS[1]}' END AS instance_id, CASE WHEN event_id % 2 = 0 THEN 'pod-' || partition END AS pod, CASE WHEN event_id % 2 = 0 THEN partition END AS ordinal FROM entry"))
def owner_parse(e, spark, sf_dir):
    o = texts.owner(F.concat(F.when(C("event_id") % 2 == 0, GUIDS[1]).otherwise("nobody"), F.lit("|pod-"), C("partition").cast("string")))
    return e.select("event_id", o.alias("o")).select("event_id", "o.instance_id", "o.pod", texts.pod_ordinal(C("o.pod")).alias("ordinal"))


@query(sql("entry", body="""SELECT DISTINCT 're:s:{events}:' || partition AS stream, 're:p:{events}:svc' AS positions, 're:p:{events}:svc:meta' AS positions_meta, 're:o:{events}:svc' AS ownership, 're:m:{events}' AS topic_meta,
  're:{events}:state:u:' || key AS state, 're:dedupe:{events}:' || key AS dedupe, 're:s:events:' || partition AS spread FROM entry"""))
def key_build(e, spark, sf_dir):
    t, svc = F.lit("events"), F.lit("svc")
    return e.select("partition", "key").distinct().select(
        texts.key("stream", t, C("partition")).alias("stream"), texts.key("positions", t, svc).alias("positions"), texts.key("positions_meta", t, svc).alias("positions_meta"), texts.key("ownership", t, svc).alias("ownership"),
        texts.key("topic_meta", t).alias("topic_meta"), texts.key("state", t, F.concat(F.lit("u:"), C("key"))).alias("state"), texts.key("dedupe", t, C("key")).alias("dedupe"), texts.key("stream", t, C("partition"), tagged=False).alias("spread"),
    ).distinct()


TRACE = "CASE WHEN event_id % 9 > 0 THEN '00-' || lpad(lower(to_hex(user_id % 3)), 32, '0') || '-' || lpad(lower(to_hex(event_id)), 16, '0') || '-01' END"


@query(sql("ord", body=f""", t AS (SELECT partition, (ordinal - 1) // 5 AS batch, ordinal, (ordinal - 1) % 5 AS at, {TRACE} AS tp FROM ord),
  s AS (SELECT partition, batch, count(*) AS messages, count(DISTINCT substr(tp, 4, 32)) AS traces, count(tp) AS traced, arg_min(coalesce(substr(tp, 37, 16), ''), ordinal) AS first_span, count(tp) FILTER (WHERE at < 16) AS near FROM t GROUP BY ALL)
  SELECT partition, batch, messages, traces, CASE WHEN traces = 1 AND traced = messages THEN first_span END AS parent,
    CASE WHEN messages = 1 THEN 0 WHEN traces = 1 AND traced = messages THEN messages - 1 ELSE near END AS links FROM s"""))  # fmt: skip
def batch_trace(e, spark, sf_dir):
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    tp = F.when(C("event_id") % 9 > 0, F.concat(F.lit("00-"), hexed(C("user_id") % 3, 32), F.lit("-"), hexed(C("event_id"), 16), F.lit("-01")))
    return delivery.batch_traces(e.withColumn("trace_parent", tp), 5)


# --- scans ------------------------------------------------------------------------------------------------------------


@query(sql("entry", body=f"SELECT ms, seq, type, key FROM entry WHERE partition = 1 AND (ms, seq) > ({PIVOT[0]}, {PIVOT[1]}) ORDER BY ms, seq LIMIT 100"))
def read_after(e, spark, sf_dir):
    return reader.read_after(e.select("partition", "ms", "seq", "type", "key"), 1, PIVOT, 100).select("ms", "seq", "type", "key")


@query(sql("pos", body=""", b AS (SELECT e.partition, e.ms, e.seq, e.event_id, row_number() OVER (PARTITION BY e.partition ORDER BY e.ms, e.seq) AS n FROM entry e JOIN pos p ON p.consumer = 'slow' AND p.partition = e.partition WHERE (e.ms, e.seq) > (p.ms, p.seq))
  SELECT partition, ms, seq, event_id FROM b WHERE n <= 50"""))
def read_many(e, spark, sf_dir):
    return reader.read_many(e.select("partition", "ms", "seq", "event_id"), X.positions(spark, sf_dir).where("consumer = 'slow'"), 50)


@query("SELECT turn AS seq, role FROM conversations WHERE conv_id = 1 AND turn > 0 ORDER BY turn LIMIT 10")
def state_read(e, spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(C("conv_id").cast("string").alias("name"), F.lit(0).cast("long").alias("ms"), C("turn").alias("seq"), "role")
    return reader.read_state(rows, "1", (0, 0), 10).select("seq", "role")


@query(sql("edge", body="SELECT * FROM edge"))
def bounds(e, spark, sf_dir):
    return topics.bounds(e)


@query(sql("parts", "edge", body="SELECT partition, coalesce(newest_ms, 0) AS ms, coalesce(newest_seq, 0) AS seq FROM parts LEFT JOIN edge USING (partition)"))
def topic_tail(e, spark, sf_dir):
    """Half of the entries are trimmed away; the tail stays where it was."""
    high = topics.tail(e, X.partitions(spark))
    return topics.tail(e.where("event_id % 2 = 0"), X.partitions(spark), high)


@query(sql("edge", body="SELECT e.partition, e.ms, e.seq, e.event_id FROM entry e JOIN edge g ON e.partition = 2 AND g.partition = 2 AND e.ms = g.newest_ms AND e.seq = g.newest_seq"))
def entry_lookup(e, spark, sf_dir):
    newest = topics.bounds(e.where("partition = 2")).select(C("newest_ms").alias("ms"), C("newest_seq").alias("seq"))
    return e.where("partition = 2").join(newest, ["ms", "seq"], "left_semi").select("partition", "ms", "seq", "event_id")


@query(sql("parts", "pos", "edge", body=""", m AS (SELECT 2 AS partition, CAST(1704067200000 AS BIGINT) AS ms, CAST(7 AS BIGINT) AS seq)
  SELECT parts.partition, coalesce(m.ms, pos.ms, edge.newest_ms, 0) AS ms, coalesce(m.seq, pos.seq, edge.newest_seq, 0) AS seq, CASE WHEN m.ms IS NOT NULL THEN 'marker' WHEN pos.ms IS NOT NULL THEN 'stored' ELSE 'now' END AS source
  FROM parts LEFT JOIN m USING (partition) LEFT JOIN pos ON pos.consumer = 'partial' AND pos.partition = parts.partition LEFT JOIN edge ON edge.partition = parts.partition"""))
def start_position(e, spark, sf_dir):
    p = X.partitions(spark)
    markers = spark.createDataFrame([(2, 1_704_067_200_000, 7)], "partition int, ms long, seq long")
    return reader.start_positions(p, X.positions(spark, sf_dir).where("consumer = 'partial'"), topics.tail(e, p), markers, "stored", "now")


@query(sql("parts", body=f"SELECT partition, CAST({PIVOT[0] - 1} AS BIGINT) AS ms, CAST({ids.MOST} AS BIGINT) AS seq, 'date' AS source FROM parts"))
def start_date(e, spark, sf_dir):
    none = spark.createDataFrame([], "partition int, ms long, seq long")
    return reader.start_positions(X.partitions(spark), none, none, none, "date", date_ms=PIVOT[0])


@query(sql("entry", body="SELECT partition, ms, seq, type, event_id FROM entry WHERE type IN ('purchase', 'signup')"))
def filter_type(e, spark, sf_dir):
    return e.where(reader.types([*TYPES, " ", None])).select("partition", "ms", "seq", "type", "event_id")


@query(sql("entry", body="SELECT partition, count(*) FILTER (WHERE type IN ('purchase', 'signup')) AS kept, count(*) FILTER (WHERE type NOT IN ('purchase', 'signup')) AS filtered FROM entry GROUP BY partition"))
def filter_counts(e, spark, sf_dir):
    return reader.filter_counts(e, TYPES)


@query(sql("ord", body="""SELECT partition, (ordinal - 1) // 100 AS batch, count(*) AS read, count(*) FILTER (WHERE type IN ('purchase', 'signup')) AS kept, arg_max(ms, ordinal) AS last_ms, arg_max(seq, ordinal) AS last_seq FROM ord GROUP BY ALL"""))
def batches(e, spark, sf_dir):
    return reader.batches(e.select("partition", "ms", "seq", "type"), 100, TYPES)


@query(sql("entry", body="SELECT partition, ms || '-' || seq AS \"offset\", ms AS enqueued_ms, type, key AS partition_key, body AS data FROM entry"))
def compat_view(e, spark, sf_dir):
    return reader.compat(e)


# --- producers --------------------------------------------------------------------------------------------------------


@query("SELECT CAST(o_custkey % 4 AS INTEGER) AS partition, epoch_us(o_orderdate) // 1000 AS ms, CAST(row_number() OVER (PARTITION BY o_custkey % 4, epoch_us(o_orderdate) // 1000 ORDER BY o_orderkey) - 1 AS BIGINT) AS seq, o_orderkey FROM orders")
def assign_ids(e, spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((C("o_custkey") % 4).cast("int").alias("partition"), F.unix_millis(C("o_orderdate").cast("timestamp")).alias("ms"), "o_orderkey")
    return topics.assign_ids(o, ["o_orderkey"]).select("partition", "ms", "seq", "o_orderkey")


@query(sql("entry", body="SELECT event_id, CAST(row_number() OVER (ORDER BY ms, event_id) % 6 AS INTEGER) AS partition FROM entry"))
def route_rr(e, spark, sf_dir):
    rows = e.select("ms", "event_id", F.lit("").alias("key"))
    return topics.route(rows, 6, "ms", "event_id").select("event_id", "partition")


@query(sql("entry", body="SELECT event_id, CAST(event_id % 6 AS INTEGER) AS partition FROM entry"))
def route_explicit(e, spark, sf_dir):
    rows = e.select("ms", "event_id", "key", (C("event_id") % 6).cast("int").alias("wanted"))
    return topics.route(rows, 6, "ms", "event_id", "wanted").select("event_id", "partition")


#: Fixed values by rule: the partition of each user number, from the reference implementation of the hash.
ROUTED = ", ".join(f"('{i}', {xxhash.xxh3_64_intdigest(str(i).encode()) % 6})" for i in range(2_000))


@query(sql("entry", body=f"SELECT key, event_id, CAST(r.partition AS INTEGER) AS partition FROM entry JOIN (VALUES {ROUTED}) r(key, partition) USING (key)"))
def route_key(e, spark, sf_dir):
    return routing.by_key(e.select("key", "event_id"), 6)


@query(sql("entry", body="SELECT count(DISTINCT key) AS keys, true AS one_partition_each, true AS in_range FROM entry"))
def route_key_invariants(e, spark, sf_dir):
    per = routing.by_key(e.select("key"), 6).groupBy("key").agg(F.min("partition").alias("a"), F.max("partition").alias("b"))
    return per.agg(F.count("*").alias("keys"), F.bool_and(C("a") == C("b")).alias("one_partition_each"), F.bool_and((C("a") >= 0) & (C("b") < 6)).alias("in_range"))


@query(sql("entry", body="""SELECT event_id, 'user.' || type AS type, '{"user":' || user_id || ',"kind":"' || type || '"}' AS body FROM entry"""))
def typed_publish(e, spark, sf_dir):
    return e.select("event_id", F.concat(F.lit("user."), C("type")).alias("type"), F.to_json(F.struct(C("user_id").alias("user"), C("type").alias("kind"))).alias("body"))


BODIES = "CASE event_id % 10 WHEN 0 THEN 'null' WHEN 1 THEN '{bad' WHEN 2 THEN '' ELSE body END"
DECODE_TYPES = {t: T.StructType([T.StructField("k", T.LongType())]) for t in ("purchase", "signup", "view")}


@query(sql("entry", body=f""", b AS (SELECT *, {BODIES} AS text FROM entry) SELECT event_id, partition,
  CASE WHEN type NOT IN ('purchase', 'signup', 'view') THEN 'unknown' WHEN text = 'null' THEN 'null' WHEN text IN ('{{bad', '') THEN 'malformed' ELSE 'ok' END AS outcome,
  CASE WHEN type = 'purchase' AND event_id % 10 > 2 THEN CAST(json_extract(text, '$.k') AS BIGINT) END AS purchase_k FROM b"""))
def typed_decode(e, spark, sf_dir):
    rows = e.select("event_id", "partition", "type", F.expr(BODIES.replace("ELSE body", "ELSE cast(body as string)")).alias("body"))
    return projections.EventTypes(DECODE_TYPES).decoded(rows).select("event_id", "partition", "outcome", C("purchase.k").alias("purchase_k"))


@query(sql("ord", body="""SELECT user_id, arg_max(value, (ms, seq)) AS value FROM ord GROUP BY user_id HAVING arg_max(type, (ms, seq)) <> 'error'"""))
def view_upsert(e, spark, sf_dir):
    rows = e.withColumn("gone", C("type") == "error")
    return projections.upserted(rows, "user_id", "value", "gone")


@query(sql("ord", body="SELECT user_id, arg_max(value, (ms, seq)) AS value FROM ord WHERE user_id IN (3, 5, 8) GROUP BY user_id"))
def view_get(e, spark, sf_dir):
    return projections.upserted(e, "user_id", "value").where(C("user_id").isin(3, 5, 8))


@query(sql("pos", body=""", b AS (SELECT e.* FROM entry e LEFT JOIN pos p ON p.consumer = 'partial' AND p.partition = e.partition WHERE p.ms IS NULL OR (e.ms, e.seq) > (p.ms, p.seq))
  SELECT key, arg_max(type || ':' || event_id, (ms, seq)) AS view, max(ms) AS ms, arg_max(seq, (ms, seq)) AS seq FROM b WHERE type IN ('purchase', 'signup') GROUP BY key"""))
def project_map(e, spark, sf_dir):
    """The flagship: a topic read behind stored positions, filtered by type, its last event of each key as a view."""
    rows = reader.behind(e, X.positions(spark, sf_dir).where("consumer = 'partial'"))
    return projections.projected(rows, F.concat(C("type"), F.lit(":"), C("event_id").cast("string")), reader.types(TYPES))


@query(sql("ord", body="SELECT partition, (ordinal - 1) // 100 AS batch, key, count(*) AS events, round(sum(value), 4) AS total FROM ord GROUP BY ALL"))
def project_batch(e, spark, sf_dir):
    return projections.by_batch(e, 100, [F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")])


@query(sql("entry", body=""", b AS (SELECT * FROM (VALUES ('purchase', 0, 'revenue'), ('purchase', 1, 'activity'), ('view', 0, 'activity'), ('signup', 0, 'users')) t(type, at, projection))
  SELECT projection, type, at, count(*) AS events FROM entry JOIN b USING (type) GROUP BY ALL"""))
def project_dispatch(e, spark, sf_dir):
    got = projections.dispatched(e.select("type"), {"purchase": ["revenue", "activity"], "view": ["activity"], "signup": ["users"]})
    return got.groupBy("projection", "type", "at").agg(F.count("*").alias("events"))


@query(sql("ord", recursive=True, body=""", o AS (SELECT partition AS source, event_id, ms, row_number() OVER (PARTITION BY partition ORDER BY ms, event_id) AS n FROM entry),
  r AS (SELECT source, event_id, ms, n, CAST(0 AS BIGINT) AS batch, ms AS first_ms, 1 AS size FROM o WHERE n = 1 UNION ALL
    SELECT o.source, o.event_id, o.ms, o.n, CASE WHEN r.size >= 8 OR o.ms - r.first_ms >= 1800000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.size >= 8 OR o.ms - r.first_ms >= 1800000 THEN o.ms ELSE r.first_ms END,
      CASE WHEN r.size >= 8 OR o.ms - r.first_ms >= 1800000 THEN 1 ELSE r.size + 1 END FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1)
  SELECT source, event_id, ms, batch FROM r"""))  # fmt: skip
def buffer_batches(e, spark, sf_dir):
    return delivery.buffer_batches(e.select(C("partition").alias("source"), "ms", "event_id"), 8, 1_800_000)


# --- folds ------------------------------------------------------------------------------------------------------------


@query(sql("entry", body=""", f AS (SELECT *, max(CASE WHEN type = 'signup' THEN (ms, seq) END) OVER (PARTITION BY key) AS since FROM entry)
  SELECT key, count(*) AS version, round(sum(CASE WHEN since IS NULL OR (ms, seq) >= since THEN value ELSE 0 END), 4) AS value FROM f GROUP BY key"""))
def aggregate_fold(e, spark, sf_dir):
    got = aggregates.sum_since(aggregates.known_types(e, ["click", "error", "purchase", "signup", "view"]), "key", C("value"), C("type") == "signup")
    return got.withColumn("value", F.round("value", 4))


@query(sql("item", body="""SELECT key, coalesce(arg_max(name, (ms, seq)) FILTER (WHERE type IN ('item.created', 'item.renamed')), '') AS name,
  coalesce(arg_max(type = 'item.created', (ms, seq)) FILTER (WHERE type IN ('item.created', 'item.deactivated')), false) AS active,
  CAST(sum(CASE type WHEN 'item.checked-in' THEN count WHEN 'item.removed' THEN -count ELSE 0 END) AS BIGINT) AS count, count(*) AS version FROM item GROUP BY key"""))
def inventory_fold(e, spark, sf_dir):
    return aggregates.items(X.item_events(e))


@query(sql("item", body=""", made AS (SELECT key, max((ms, seq)) AS made FROM item WHERE type = 'item.created' GROUP BY key), s AS (SELECT item.* FROM item JOIN made USING (key) WHERE (ms, seq) >= made)
  SELECT key, arg_max(name, (ms, seq)) FILTER (WHERE type IN ('item.created', 'item.renamed')) AS name, count(*) FILTER (WHERE type = 'item.deactivated') = 0 AS active,
    CAST(sum(CASE type WHEN 'item.checked-in' THEN count WHEN 'item.removed' THEN -count ELSE 0 END) AS BIGINT) AS count, max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM s GROUP BY key"""))
def inventory_view(e, spark, sf_dir):
    """Every seventh event is delivered twice, which changes nothing."""
    rows = X.item_events(e)
    return aggregates.item_views(rows.unionByName(rows.where("event_id % 7 = 0")))


def _commands(e: DataFrame) -> DataFrame:
    rows = numbered(e.select("key", "ms", "seq", "event_id"), ["key"])
    n = C("ordinal") - 1
    return rows.select(C("key").alias("name"), C("ordinal").alias("at"), F.when(C("event_id") % 11 > 0, F.floor(n / 2)).alias("expected"), F.when(C("event_id") % 5 == 0, 2).otherwise(1).cast("long").alias("events"))


@query(sql("entry", recursive=True, body=""", o AS (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS at FROM entry),
  c AS (SELECT key AS name, at, CASE WHEN event_id % 11 > 0 THEN (at - 1) // 2 END AS expected, CAST(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS events FROM o),
  r AS (SELECT name, at, expected IS NULL OR expected = 0 AS accepted, CASE WHEN expected IS NULL OR expected = 0 THEN events ELSE 0 END AS version FROM c WHERE at = 1 UNION ALL
    SELECT c.name, c.at, c.expected IS NULL OR c.expected = r.version, r.version + CASE WHEN c.expected IS NULL OR c.expected = r.version THEN c.events ELSE 0 END FROM r JOIN c ON c.name = r.name AND c.at = r.at + 1)
  SELECT name, at, accepted, version FROM r"""))  # fmt: skip
def optimistic_append(e, spark, sf_dir):
    return aggregates.optimistic_appends(_commands(e))


@query(sql("entry", recursive=True, body=""", c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS at, ['create','check_in','remove','check_in','deactivate','remove','check_in'][event_id % 7 + 1] AS command, event_id % 6 AS n FROM entry),
  r AS (SELECT key, at, command = 'create' AS done, command = 'create' AS there, command = 'create' AS active, CAST(0 AS BIGINT) AS count FROM c WHERE at = 1 UNION ALL
    SELECT key, at, ok, there OR ok, CASE WHEN ok AND command = 'create' THEN true WHEN ok AND command = 'deactivate' THEN false ELSE active END, count + CASE WHEN NOT ok THEN 0 WHEN command = 'check_in' THEN n WHEN command = 'remove' THEN -n ELSE 0 END
    FROM (SELECT c.key, c.at, command, n, there, active, count, CASE command WHEN 'create' THEN NOT there WHEN 'check_in' THEN there AND n > 0 WHEN 'remove' THEN there AND n > 0 AND n <= count ELSE there AND active END AS ok FROM r JOIN c ON c.key = r.key AND c.at = r.at + 1))
  SELECT key, at, CASE WHEN done THEN 'done' ELSE 'refused' END AS outcome, count FROM r"""))  # fmt: skip
def command_decisions(e, spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("create"), F.lit("check_in"), F.lit("remove"), F.lit("check_in"), F.lit("deactivate"), F.lit("remove"), F.lit("check_in")), (C("event_id") % 7 + 1).cast("int"))
    rows = numbered(e.select("key", "ms", "seq", "event_id"), ["key"])
    return aggregates.command_decisions(rows.select("key", C("ordinal").alias("at"), kinds.alias("command"), (C("event_id") % 6).alias("count")))


@query(sql("entry", body="SELECT 'events' AS topic, 'c' || user_id % 3 AS consumer, partition, arg_max(ms, event_id) AS ms, arg_max(seq, event_id) AS seq FROM entry GROUP BY ALL"))
def positions_latest(e, spark, sf_dir):
    return positions.latest(e.select("topic", F.concat(F.lit("c"), (C("user_id") % 3).cast("string")).alias("consumer"), "partition", "ms", "seq", C("event_id").alias("written")))


@query(sql("entry", body="SELECT partition, ms // 3600000 AS tick, max(ms) AS ms, arg_max(seq, (ms, seq)) AS seq FROM entry GROUP BY ALL"))
def flush_ticks(e, spark, sf_dir):
    return positions.flushes(e, 3_600_000)


@query(sql("entry", body="SELECT key, type, min(ms) AS ms, arg_min(seq, (ms, seq)) AS seq FROM entry GROUP BY ALL"))
def dedupe_first(e, spark, sf_dir):
    return dedupe.first_claims(e, ["key", "type"])


@query(sql("entry", recursive=True, body=""", o AS (SELECT key, ms, seq, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM entry),
  r AS (SELECT key, ms, seq, n, true AS won, ms + 21600000 AS until FROM o WHERE n = 1 UNION ALL SELECT o.key, o.ms, o.seq, o.n, o.ms >= r.until, CASE WHEN o.ms >= r.until THEN o.ms + 21600000 ELSE r.until END FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
  SELECT key, ms, seq, won FROM r"""))
def dedupe_ttl(e, spark, sf_dir):
    return dedupe.claims(e, "key", 21_600_000)


FORWARD = "event_id - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END"


@query(sql("entry", body=f""", m AS (SELECT key AS source, event_id AS at, {FORWARD} AS position FROM entry), h AS (SELECT *, max(position) OVER (PARTITION BY source ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m)
  SELECT source, at, position, mark IS NULL OR position > mark AS forwarded FROM h"""))
def forward(e, spark, sf_dir):
    return dedupe.forwarded(e.select(C("key").alias("source"), C("event_id").alias("at"), F.expr(FORWARD).alias("position")))


@query(sql("entry", recursive=True, body=""", o AS (SELECT key AS source, ms AS m_at, event_id AS position, event_id % 3 AS id, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS n FROM entry),
  r AS (SELECT source, m_at, position, id, n, true AS ok, position AS mark, CASE WHEN id = 0 THEN m_at + 21600000 ELSE 0 END AS u0, CASE WHEN id = 1 THEN m_at + 21600000 ELSE 0 END AS u1, CASE WHEN id = 2 THEN m_at + 21600000 ELSE 0 END AS u2 FROM o WHERE n = 1 UNION ALL
    SELECT source, m_at, position, id, n, ok, CASE WHEN ok THEN position ELSE mark END, CASE WHEN ok AND id = 0 THEN m_at + 21600000 ELSE u0 END, CASE WHEN ok AND id = 1 THEN m_at + 21600000 ELSE u1 END, CASE WHEN ok AND id = 2 THEN m_at + 21600000 ELSE u2 END
    FROM (SELECT o.*, mark, u0, u1, u2, o.position > mark AND CASE o.id WHEN 0 THEN u0 WHEN 1 THEN u1 ELSE u2 END <= o.m_at AS ok FROM r JOIN o ON o.source = r.source AND o.n = r.n + 1))
  SELECT source, m_at AS at, position, CAST(id AS VARCHAR) AS dedupe_id, ok AS forwarded FROM r"""))  # fmt: skip
def forward_once(e, spark, sf_dir):
    rows = e.select(C("key").alias("source"), C("ms").alias("at"), C("event_id").alias("position"), (C("event_id") % 3).cast("string").alias("dedupe_id"))
    return dedupe.forwarded_once(rows, 21_600_000)


# --- trimming ---------------------------------------------------------------------------------------------------------

DAYS = 7 * 86_400


@query(sql("ord", body="SELECT partition, ms, seq, event_id FROM ord WHERE total - ordinal < 500"))
def trim_maxlen(e, spark, sf_dir):
    return topics.trim_maxlen(e.select("partition", "ms", "seq", "event_id"), 500)


@query(sql("entry", body=f"SELECT partition, ms, seq, event_id FROM entry WHERE (ms, seq) >= ({PIVOT[0]}, {PIVOT[1]})"))
def trim_minid(e, spark, sf_dir):
    return topics.trim_minid(e, PIVOT).select("partition", "ms", "seq", "event_id")


@query(sql("entry", body=f"SELECT partition, ms, seq, event_id FROM entry WHERE ms >= {NOW_MS - 1000 * DAYS}"))
def trim_retention(e, spark, sf_dir):
    return topics.trim_retention(e, NOW_MS, DAYS).select("partition", "ms", "seq", "event_id")


CLAMP = """, held AS (SELECT c.consumer, parts.partition, coalesce(p.ms, 0) AS ms, coalesce(p.seq, 0) AS seq FROM (SELECT DISTINCT consumer FROM pos) c CROSS JOIN parts LEFT JOIN pos p ON p.consumer = c.consumer AND p.partition = parts.partition),
  clamp AS (SELECT partition, arg_min(ms, (ms, seq, consumer)) AS clamp_ms, arg_min(seq, (ms, seq, consumer)) AS clamp_seq, arg_min(consumer, (ms, seq, consumer)) AS holder FROM held GROUP BY partition)"""


@query(sql("pos", "parts", body=CLAMP + " SELECT * FROM clamp"))
def trim_clamp(e, spark, sf_dir):
    return topics.clamp(X.positions(spark, sf_dir), X.partitions(spark))


def _trim_sql(max_len: int) -> str:
    at, cut = topics.release_at(max_len, 0.8), NOW_MS - 1000 * DAYS
    return sql("pos", "parts", body=CLAMP + f""", s AS (SELECT partition, any_value(total) AS length FROM ord GROUP BY partition),
  p AS (SELECT s.partition, length, CAST({cut} AS BIGINT) AS cutoff_ms, clamp_ms, clamp_seq, CASE WHEN clamp_ms < {cut} THEN holder END AS holder, clamp_ms < {cut} AND length >= {at} AS released FROM s JOIN clamp USING (partition)),
  q AS (SELECT *, CASE WHEN holder IS NOT NULL AND NOT released THEN clamp_ms ELSE cutoff_ms END AS fm, CASE WHEN holder IS NOT NULL AND NOT released THEN clamp_seq ELSE 0 END AS fs,
    CASE WHEN released THEN greatest(1, least(length - greatest(1, {max_len - at}), {at})) END AS keep FROM p),
  k AS (SELECT o.partition, count(*) AS kept, arg_min(ms, (ms, seq)) AS head_ms, arg_min(seq, (ms, seq)) AS head_seq FROM ord o JOIN q USING (partition) WHERE (ms, seq) >= (fm, fs) AND (keep IS NULL OR total - ordinal < keep) GROUP BY o.partition)
  SELECT q.partition, length, cutoff_ms, clamp_ms, clamp_seq, holder, released, head_ms, head_seq, coalesce(kept, 0) AS kept, length - coalesce(kept, 0) AS removed FROM q LEFT JOIN k USING (partition)""")  # fmt: skip


@query(_trim_sql(1_000_000))
def trim_report(e, spark, sf_dir):
    return topics.trim_report(e, X.positions(spark, sf_dir), NOW_MS, DAYS, 1_000_000)


@query(_trim_sql(600))
def trim_release(e, spark, sf_dir):
    return topics.trim_report(e, X.positions(spark, sf_dir), NOW_MS, DAYS, 600)


# --- resets -----------------------------------------------------------------------------------------------------------


def _preview_sql(target: str | None, consumer: str, missing_now: bool = False, tail: str = "SELECT * FROM out", cap: int = positions.COUNT_CAP) -> str:
    t_ms, t_seq = (target.split(",")) if target else ("newest_ms", "newest_seq")
    a_ms, a_seq = ("newest_ms", "newest_seq") if missing_now else ("0", "0")
    n = f"CASE WHEN n >= {cap} THEN least(n, {-(-cap // positions.PAGE) * positions.PAGE}) ELSE n END"
    return sql("pos", "edge", body=f""", b AS (SELECT g.partition, p.ms AS current_ms, p.seq AS current_seq, CAST({t_ms} AS BIGINT) AS target_ms, CAST({t_seq} AS BIGINT) AS target_seq, CASE WHEN p.ms IS NULL THEN CAST({a_ms} AS BIGINT) END AS assumed_ms,
      coalesce(p.ms, {a_ms}) AS bm, coalesce(p.seq, {a_seq}) AS bs, length, oldest_ms, oldest_seq, newest_ms, newest_seq FROM edge g LEFT JOIN pos p ON p.consumer = '{consumer}' AND p.partition = g.partition),
  c AS (SELECT b.partition, count(*) AS n FROM b JOIN entry e ON e.partition = b.partition AND (e.ms, e.seq) > least((target_ms, target_seq), (bm, bs)) AND (e.ms, e.seq) <= greatest((target_ms, target_seq), (bm, bs)) GROUP BY b.partition),
  o AS (SELECT b.*, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (partition)),
  out AS (SELECT partition, current_ms, current_seq, target_ms, target_seq, CASE WHEN (target_ms, target_seq) < (bm, bs) THEN 'rewind' WHEN (target_ms, target_seq) > (bm, bs) THEN 'skip' ELSE 'none' END AS direction, CAST({n} AS BIGINT) AS entries, n < {cap} AS exact,
    length, (oldest_ms, oldest_seq) > (target_ms, target_seq + 1) AS trimmed_away, assumed_ms, oldest_ms, oldest_seq, newest_ms, newest_seq FROM o) {tail}""")  # fmt: skip


@query(_preview_sql(f"{PIVOT[0]},0", "partial"))
def reset_preview_date(e, spark, sf_dir):
    return positions.preview(e, X.positions(spark, sf_dir).where("consumer = 'partial'"), PIVOT)


@query(_preview_sql("1704240000000,5", "slow", cap=1_000))
def reset_preview_id(e, spark, sf_dir):
    return positions.preview(e, X.positions(spark, sf_dir).where("consumer = 'slow'"), (1_704_240_000_000, 5), cap=1_000)


@query(_preview_sql(None, "partial", missing_now=True))
def reset_preview_end(e, spark, sf_dir):
    return positions.preview(e, X.positions(spark, sf_dir).where("consumer = 'partial'"), None, "now")


@query(_preview_sql(f"{PIVOT[0]},0", "partial", tail="SELECT CAST(coalesce(sum(entries) FILTER (WHERE direction = 'rewind'), 0) AS BIGINT) AS to_reprocess, CAST(coalesce(sum(entries) FILTER (WHERE direction = 'skip'), 0) AS BIGINT) AS to_skip, bool_or(trimmed_away) AS any_trimmed_away FROM out"))
def reset_totals(e, spark, sf_dir):
    return positions.totals(reset_preview_date(e, spark, sf_dir))


@query(_preview_sql(f"{PIVOT[0]},0", "partial", tail="""SELECT partition, 'p' || partition || '  current ' || CASE WHEN current_ms IS NOT NULL THEN current_ms || '-' || current_seq ELSE '(none, assuming ' || assumed_ms || '-0)' END || ' -> ' || target_ms || '-' || target_seq
  || '  ' || direction || ' ' || CASE WHEN exact THEN '' ELSE '≥' END || entries || ' of ' || length || '  oldest ' || oldest_ms || '-' || oldest_seq AS line FROM out"""))
def reset_describe(e, spark, sf_dir):
    return positions.described(reset_preview_date(e, spark, sf_dir))


@query(sql("pos", body=f"SELECT consumer, partition, CASE WHEN consumer = 'slow' THEN {PIVOT[0]} ELSE ms END AS ms, CASE WHEN consumer = 'slow' THEN 0 ELSE seq END AS seq, CASE WHEN consumer = 'slow' THEN '{texts.ADMIN}' ELSE '{GUIDS[0]}' END AS instance_id FROM pos"))
def reset_apply(e, spark, sf_dir):
    stored = X.positions(spark, sf_dir).select(F.lit("events").alias("topic"), "consumer", "partition", "ms", "seq", F.lit(GUIDS[0]).alias("instance_id"))
    return positions.reset(stored, X.partitions(spark), PIVOT, "slow", "events").drop("topic")


@query(sql("parts", body=f"SELECT partition, '__reset:' || partition AS field, '{PIVOT[0]}-0|2024-02-01T00:00:00.0000000+00:00' AS value FROM parts WHERE partition <> 1"))
def reset_markers(e, spark, sf_dir):
    pending = positions.markers(X.partitions(spark), PIVOT, "2024-02-01T00:00:00.0000000+00:00")
    return positions.taken(pending, pending.where("partition = 1"))


@query("SELECT 'n' || n_nationkey AS topic, CAST(4 + n_nationkey % 2 AS INTEGER) AS partitions, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 500 ELSE 10000 END AS INTEGER) AS max_len, n_nationkey % 3 > 0 AS created, n_nationkey % 3 = 0 AND n_nationkey % 2 = 1 AS grown FROM nation")
def ensure_topic(e, spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("topic"), "n_nationkey")
    meta = n.where("n_nationkey % 3 = 0").select("topic", F.lit(4).alias("partitions"), F.lit(500).alias("max_len"))
    return topics.ensure_topic(meta, n.select("topic", (4 + C("n_nationkey") % 2).cast("int").alias("partitions"), F.lit(10_000).alias("max_len")))


# --- ownership --------------------------------------------------------------------------------------------------------

RANGES = "SELECT CAST(p.range AS INTEGER) AS partitions, CAST(c.range AS INTEGER) AS count, CAST(i.range AS INTEGER) AS index FROM range(1, 25) p, range(1, 9) c, range(9) i"


def _grid(spark: SparkSession) -> DataFrame:
    rows = spark.range(24 * 8 * 9).select((C("id") / 72 + 1).cast("int").alias("partitions"), (F.floor(C("id") / 9) % 8 + 1).cast("int").alias("count"), (C("id") % 9).cast("int").alias("index"))
    return rows


@query(f"""SELECT partitions, count, index, CAST(CASE WHEN index < count THEN index * (partitions // count) + least(index, partitions % count) ELSE 0 END AS INTEGER) AS start,
  CAST(CASE WHEN index < count THEN partitions // count + CASE WHEN index < partitions % count THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS length FROM ({RANGES})""")
def static_ranges(e, spark, sf_dir):
    start, length = ownership.owned(C("partitions"), C("count"), C("index"))
    return _grid(spark).select("partitions", "count", "index", start.alias("start"), length.alias("length"))


@query(f"""SELECT partitions, count, CAST(partition AS INTEGER) AS partition, index AS owner FROM (SELECT *, unnest(range(start, start + length)) AS partition FROM (SELECT partitions, count, index, index * (partitions // count) + least(index, partitions % count) AS start,
  partitions // count + CASE WHEN index < partitions % count THEN 1 ELSE 0 END AS length FROM ({RANGES}) WHERE index < count))""")
def owner_of(e, spark, sf_dir):
    rows = _grid(spark).where("index = 0").select("partitions", "count", F.explode(F.sequence(F.lit(0), C("partitions") - 1)).alias("partition"))
    return rows.withColumn("owner", ownership.owner_of(C("partition"), C("partitions"), C("count")))


@query(f"""SELECT 's' || s.s_suppkey AS topic, CAST(p.range AS INTEGER) AS partition, CASE WHEN (s.s_suppkey + p.range) % 5 > 0 THEN 'i' || (s.s_suppkey + p.range) % 3 END AS owner, (s.s_suppkey + p.range) % 5 = 0 AS unowned FROM supplier s, range({X.PARTITIONS}) p""")
def ownership_map(e, spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), C("s_suppkey").cast("string")).alias("topic"), "s_suppkey", F.lit(X.PARTITIONS).alias("partitions"))
    leases = s.select("topic", "s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(X.PARTITIONS - 1))).alias("partition")).withColumn("n", C("s_suppkey") + C("partition"))
    leases = leases.select("topic", "partition", F.concat(F.lit("i"), (C("n") % 3).cast("string")).alias("owner"), F.when(C("n") % 5 > 0, NOW_MS + 1000).otherwise(NOW_MS).alias("expires_ms"))
    return ownership.owner_map(leases, s.select("topic", "partitions"), NOW_MS)


@query(sql("entry", body=f""", w AS (SELECT partition, event_id AS at, ['{GUIDS[0]}','{GUIDS[1]}','{GUIDS[2]}','{texts.ADMIN}'][CAST(user_id // 4 % 4 + 1 AS INTEGER)] AS writer FROM entry), b AS (SELECT *, lag(writer) OVER (PARTITION BY partition ORDER BY at) AS before FROM w)
  SELECT partition, at, writer, before, CASE WHEN before IS NULL OR before = writer OR before = '{texts.ADMIN}' THEN 'ignored' WHEN before NOT IN ('{GUIDS[0]}', '{GUIDS[1]}') THEN 'stale' WHEN writer < before THEN 'keeps' ELSE 'stands_down' END AS verdict FROM b"""))
def contested(e, spark, sf_dir):
    who = F.element_at(F.array(*[F.lit(g) for g in (*GUIDS[:3], texts.ADMIN)]), (F.floor(C("user_id") / 4) % 4 + 1).cast("int"))
    return positions.contention(e.select("partition", C("event_id").alias("at"), who.alias("writer")), spark.createDataFrame([(g,) for g in GUIDS[:2]], "instance_id string"))


@query()
def lease_cycle(e, spark, sf_dir):
    calls = e.select(F.concat(F.lit("t"), C("partition").cast("string")).alias("topic"), C("ms").alias("at"), F.concat(F.lit("m"), (C("user_id") % 5).cast("string")).alias("me"), F.lit(16).cast("long").alias("partitions"), F.lit(7_200_000).cast("long").alias("ttl_ms"))
    return ownership.lease_cycles(calls)


# --- lag and health ---------------------------------------------------------------------------------------------------

LAGS = f""", l AS (SELECT p.consumer, p.partition, length, CASE WHEN (p.ms, p.seq) >= (newest_ms, newest_seq) THEN 0 WHEN (p.ms, p.seq) < (oldest_ms, oldest_seq) OR newest_ms <= oldest_ms THEN length
    ELSE greatest(1, least(CAST(trunc(CAST(length AS DOUBLE) * (newest_ms - p.ms) / (newest_ms - oldest_ms)) AS BIGINT), length)) END AS entries_est,
  (SELECT count(*) FROM entry e WHERE e.partition = p.partition AND (e.ms, e.seq) > (p.ms, p.seq)) AS entries,
  CASE WHEN (p.ms, p.seq) >= (newest_ms, newest_seq) THEN 0.0::DOUBLE ELSE CAST({NOW_MS} - p.ms AS DOUBLE) END AS lag_ms FROM pos p JOIN edge USING (partition))"""


@query(sql("pos", "edge", body=LAGS + " SELECT consumer, partition, lag_ms FROM l"))
def lag_ms(e, spark, sf_dir):
    return health.lags(e, X.positions(spark, sf_dir), NOW_MS).select("consumer", "partition", "lag_ms")


@query(sql("pos", "edge", body=LAGS + " SELECT consumer, partition, length, entries_est FROM l"))
def lag_entries_est(e, spark, sf_dir):
    return health.lags(e, X.positions(spark, sf_dir), NOW_MS).select("consumer", "partition", "length", "entries_est")


@query(sql("pos", "edge", body=LAGS + " SELECT consumer, partition, entries FROM l"))
def lag_entries_exact(e, spark, sf_dir):
    return health.lags(e, X.positions(spark, sf_dir), NOW_MS).select("consumer", "partition", "entries")


@query(sql("entry", body=""", d AS (SELECT partition, ms // 86400000 AS at, max(event_id) AS tail FROM entry GROUP BY ALL), s AS (SELECT *, CASE WHEN at % 3 = 0 THEN tail ELSE NULL END AS moved FROM d),
  p AS (SELECT partition, at, coalesce(max(moved) OVER w, 0) AS position, max(tail) OVER w AS tail FROM s WINDOW w AS (PARTITION BY partition ORDER BY at)), b AS (SELECT *, tail > position AS behind FROM p),
  n AS (SELECT *, CASE WHEN lag(position) OVER w IS NOT DISTINCT FROM position AND lag(behind) OVER w IS NOT DISTINCT FROM behind THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY partition ORDER BY at)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY partition ORDER BY at) AS run FROM n) SELECT partition, at, position, tail, behind, CASE WHEN behind THEN min(at) OVER (PARTITION BY partition, run) END AS since FROM r"""))
def behind_since(e, spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("partition").orderBy("at")
    days = e.groupBy("partition", F.floor(C("ms") / 86_400_000).alias("at")).agg(F.max("event_id").alias("tail"))
    rows = days.withColumn("moved", F.when(C("at") % 3 == 0, C("tail"))).select("partition", "at", F.coalesce(F.max("moved").over(w), F.lit(0)).alias("position"), F.max("tail").over(w).alias("tail"))
    return health.behind_since(rows)


def _graded(e: DataFrame) -> DataFrame:
    s = X.statuses(e)
    status, rule = health.grade({c: C(c) for c in s.columns})
    return s.withColumns({"status": status, "rule": rule})


@query(sql("graded", body="SELECT CASE WHEN rule IN ('Stalled', 'BlockedTooLong', 'StoppedTooLong', 'BehindTail') THEN 'unhealthy' WHEN rule = 'None' THEN 'healthy' ELSE 'degraded' END AS status, rule, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM graded GROUP BY ALL"))
def health_grade(e, spark, sf_dir):
    return _graded(e).groupBy("status", "rule").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUIET = """, q AS (SELECT process, topic, consumer, count(*) AS partitions, bool_and(NOT behind AND tail_age_ms BETWEEN 0 AND 60000 AND unchanged_ms >= silence_limit * 1000) AS ok, min(unchanged_ms) AS silent_ms
  FROM status WHERE state = 'running' AND silence_limit > 0 GROUP BY ALL)"""


@query(sql("status", body=QUIET.replace("process, topic", "event_id // 3 AS process, topic") + " SELECT process, topic, consumer, partitions, silent_ms FROM q WHERE ok"))
def silent_consumer(e, spark, sf_dir):
    return health.silent(X.statuses(e).withColumn("process", F.floor(C("event_id") / 3)))


@query(sql("graded", body=""", s AS (SELECT * REPLACE (event_id // 3 AS process) FROM graded), q AS (SELECT process, count(*) AS quiet FROM (SELECT process, consumer, bool_and(NOT behind AND tail_age_ms BETWEEN 0 AND 60000 AND unchanged_ms >= silence_limit * 1000) AS ok
    FROM s WHERE state = 'running' AND silence_limit > 0 GROUP BY ALL) WHERE ok GROUP BY process),
  t AS (SELECT process, count(*) AS n, count(*) FILTER (WHERE state = 'blocked') AS blocked, count(*) FILTER (WHERE state = 'stopped') AS stopped, count(*) FILTER (WHERE state = 'starting') AS starting, count(*) FILTER (WHERE state = 'running') AS running,
    bool_or(lag_ms > lag_limit_ms AND lag_entries <> 0) AS lagging, bool_or(rule = 'Stalled') AS a, bool_or(rule = 'BlockedTooLong') AS b, bool_or(rule = 'StoppedTooLong') AS c, bool_or(rule = 'BehindTail') AS d FROM s GROUP BY process),
  r AS (SELECT process, CASE WHEN process % 13 = 0 THEN 'ConnectionDown' WHEN a THEN 'Stalled' WHEN b THEN 'BlockedTooLong' WHEN c THEN 'StoppedTooLong' WHEN d THEN 'BehindTail' WHEN process % 17 = 0 THEN 'NoConsumerStarted'
    WHEN running + blocked + starting = 0 THEN 'AllPartitionsStopped' WHEN running = 0 AND starting > 0 THEN 'NotReadingYet' WHEN blocked > 0 THEN 'Blocked' WHEN stopped > 0 THEN 'Stopped' WHEN lagging THEN 'Lagging' WHEN process % 7 = 0 THEN 'OwnershipDegraded'
    WHEN quiet > 0 THEN 'Silent' ELSE 'None' END AS rule FROM t LEFT JOIN q USING (process))
  SELECT process, CASE WHEN rule = 'None' THEN 'healthy' WHEN rule IN ('ConnectionDown', 'Stalled', 'BlockedTooLong', 'StoppedTooLong', 'BehindTail', 'NoConsumerStarted', 'AllPartitionsStopped') THEN 'unhealthy' ELSE 'degraded' END AS status, rule FROM r"""))
def health_report(e, spark, sf_dir):
    s = _graded(e).withColumn("process", F.floor(C("event_id") / 3))
    p = s.select("process").distinct().select("process", F.lit(3).alias("consumers"), F.when(C("process") % 17 == 0, 0).otherwise(3).alias("started"), (C("process") % 13 == 0).alias("connection_down"), (C("process") % 7 == 0).alias("ownership_degraded"))
    return health.report(s, p)


@query(sql("entry", body=f"SELECT partition, type, count(*) FILTER (WHERE type IN ('purchase', 'signup')) AS consumed, count(*) FILTER (WHERE type NOT IN ('purchase', 'signup')) AS filtered, {NOW_MS} - min(ms) AS oldest_lag_ms, round(avg(octet_length(encode(body))), 6) AS mean_bytes FROM entry GROUP BY ALL"))
def metrics_consumed(e, spark, sf_dir):
    return health.consumed(e, reader.types(TYPES), NOW_MS)


# --- delivery ---------------------------------------------------------------------------------------------------------

FAILS = "event_id % 173 = 0"


@query(sql("ord", body=f"SELECT partition, (ordinal - 1) // 100 AS batch, count(*) AS read, CASE WHEN bool_or({FAILS}) THEN 0 ELSE count(*) END AS handled FROM ord GROUP BY ALL"))
def err_best_effort(e, spark, sf_dir):
    return delivery.best_effort(e, 100, F.expr(FAILS))


@query(sql("entry", body=f"SELECT partition, count(*) FILTER (WHERE NOT {FAILS}) AS handled, count(*) FILTER (WHERE {FAILS}) AS skipped FROM entry GROUP BY partition"))
def err_per_message(e, spark, sf_dir):
    return delivery.per_message(e, F.expr(FAILS))


@query(sql("ord", body=f", f AS (SELECT partition, min(ordinal) AS at FROM ord WHERE {FAILS} GROUP BY partition) SELECT o.partition, count(*) FILTER (WHERE f.at IS NULL OR ordinal < f.at) AS handled, max(CASE WHEN ordinal = f.at THEN ms END) AS stopped_ms, max(CASE WHEN ordinal = f.at THEN seq END) AS stopped_seq FROM ord o LEFT JOIN f USING (partition) GROUP BY o.partition"))
def err_stop_partition(e, spark, sf_dir):
    return delivery.stop_partition(e, F.expr(FAILS))


@query("SELECT range AS attempt, CAST(least(30000, 1000 * pow(2, range - 1)) AS BIGINT) AS block_ms, CAST(least(5000, 200 * pow(2, range - 1)) AS BIGINT) AS retry_ms FROM range(1, 40)")
def backoff_ladder(e, spark, sf_dir):
    return spark.range(1, 40).select(C("id").alias("attempt"), delivery.backoff_ms(C("id")).alias("block_ms"), workflow.retry_ms(C("id")).alias("retry_ms"))


@query(sql("ord", body="SELECT partition, ms, seq, CAST((ordinal - 1) % 3 AS INTEGER) AS member FROM ord WHERE event_id % 4 > 0"))
def wq_pending(e, spark, sf_dir):
    got = workqueue.deliver(e.select("partition", "ms", "seq", "event_id"), 3)
    return workqueue.pending(got, e.where("event_id % 4 = 0")).select("partition", "ms", "seq", "member")


@query(sql("entry", body=""", w AS (SELECT partition, ms, seq, event_id, row_number() OVER (PARTITION BY partition ORDER BY ms, seq) AS n FROM entry WHERE event_id % 4 > 0 AND 1706572800000 - ms >= 30000 AND (ms, seq) >= (1704240000000, 0))
  SELECT partition, ms, seq, event_id FROM w WHERE n <= 100"""))
def wq_claim(e, spark, sf_dir):
    waiting = e.where("event_id % 4 > 0").select("partition", "ms", "seq", "event_id", C("ms").alias("delivered_ms"))
    return workqueue.claimable(waiting, 1_706_572_800_000, after=(1_704_240_000_000, 0)).select("partition", "ms", "seq", "event_id")


@query(sql("pos", body=""", b AS (SELECT partition, (ordinal - 1) // 100 AS batch, arg_max(ms, ordinal) AS last_ms, arg_max(seq, ordinal) AS last_seq FROM ord GROUP BY ALL)
  SELECT b.partition, batch, last_ms, last_seq FROM b JOIN pos p ON p.consumer = 'slow' AND p.partition = b.partition WHERE (last_ms, last_seq) <= (p.ms, p.seq)"""))
def wq_ack(e, spark, sf_dir):
    return workqueue.acknowledged(reader.batches(e, 100).select("partition", "batch", "last_ms", "last_seq"), X.positions(spark, sf_dir).where("consumer = 'slow'"))


@query(sql("entry", body="""SELECT partition, ms, seq, 'http://ingress/purchases/user%20' || key || '/run/send' AS url, '{"user":' || user_id || ',"event":' || event_id || '}' AS body FROM entry WHERE type = 'purchase'"""))
def workflow_requests(e, spark, sf_dir):
    body = F.to_json(F.struct(C("user_id").alias("user"), C("event_id").alias("event")))
    return workflow.requests(e, "http://ingress/", F.lit("purchases"), F.concat(F.lit("user "), C("key")), "run", body, C("type") == "purchase")


@query(sql("entry", body="""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'again' WHEN event_id % 10 IN (1, 2) THEN 'accepted' WHEN event_id % 10 = 3 THEN 'already_started' WHEN event_id % 10 IN (4, 5, 6, 7) THEN 'again' ELSE 'failed' END AS outcome FROM entry"""))
def workflow_outcomes(e, spark, sf_dir):
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (None, 200, 202, 409, 408, 425, 429, 503, 400, 404)]), (C("event_id") % 10 + 1).cast("int"))
    return e.select("event_id", workflow.outcome(status, status == 409).alias("outcome"))


# --- discovery, publishing in batches, histories, counters, status ----------------------------------------------------


@query("""SELECT 'n' || n_nationkey % 7 AS topic, 'c' || n_regionkey AS consumer, true AS positions, bool_or(n_nationkey % 2 = 0) AS ownership FROM nation GROUP BY ALL
  UNION ALL SELECT DISTINCT 'n' || n_nationkey % 7, 'o' || n_regionkey, false, true FROM nation WHERE n_nationkey % 3 = 0""")
def consumer_discovery(e, spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), (C("n_nationkey") % 7).cast("string")).alias("topic"), F.concat(F.lit("c"), C("n_regionkey").cast("string")).alias("c"), F.concat(F.lit("o"), C("n_regionkey").cast("string")).alias("o"), "n_nationkey")
    keys = n.select(F.explode(F.array_compact(F.array(
        texts.key("positions", C("topic"), C("c")), texts.key("positions_meta", C("topic"), C("c")), F.when(C("n_nationkey") % 2 == 0, texts.key("ownership", C("topic"), C("c"))),
        F.when(C("n_nationkey") % 3 == 0, texts.key("ownership", C("topic"), C("o"))), texts.key("topic_meta", C("topic")), texts.key("stream", C("topic"), F.lit(0)),
    ))).alias("key"))
    return ownership.discovered(keys)


@query(sql("entry", body=""", b AS (SELECT event_id // 10 AS batch, min((ms, event_id)) AS at FROM entry GROUP BY 1), s AS (SELECT batch, CAST(row_number() OVER (ORDER BY at) % 6 AS INTEGER) AS partition FROM b)
  SELECT event_id, batch, s.partition FROM (SELECT event_id, event_id // 10 AS batch FROM entry) JOIN s USING (batch)"""))
def publish_batch(e, spark, sf_dir):
    rows = e.select("ms", "event_id", F.lit("").alias("key"), F.floor(C("event_id") / 10).alias("batch"))
    return topics.publish_batches(rows, 6, "batch", "ms", "event_id").select("event_id", "batch", "partition")


@query(sql("entry", body=f""", f AS (SELECT event_id // 10 AS batch, arg_min(key, (ms, event_id)) AS key FROM entry GROUP BY 1) SELECT event_id, batch, CAST(r.partition AS INTEGER) AS partition
  FROM (SELECT event_id, event_id // 10 AS batch FROM entry) JOIN f USING (batch) JOIN (VALUES {ROUTED}) r(key, partition) USING (key)"""))
def publish_batch_keyed(e, spark, sf_dir):
    rows = e.select("ms", "event_id", "key", F.floor(C("event_id") / 10).alias("batch"))
    return topics.publish_batches(rows, 6, "batch", "ms", "event_id").select("event_id", "batch", "partition")


@query(sql("entry", body=f""", n AS (SELECT partition, ms, seq FROM entry UNION ALL SELECT CAST(p AS INTEGER), CAST({NOW_MS} AS BIGINT), range FROM range(40), (VALUES (0), (2)) v(p)),
  o AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ms DESC, seq DESC) AS n FROM n) SELECT partition, ms, seq FROM o WHERE partition NOT IN (0, 2) OR n <= 300"""))
def publish_trim(e, spark, sf_dir):
    new = spark.range(80).select((C("id") % 2 * 2).cast("int").alias("partition"), F.lit(NOW_MS).cast("long").alias("ms"), F.floor(C("id") / 2).cast("long").alias("seq"))
    return topics.publish_trimmed(e.select("partition", "ms", "seq"), new, 300)


@query(sql("entry", body="SELECT key, ms, seq, type, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS version FROM entry"))
def history_load(e, spark, sf_dir):
    return aggregates.history(e.select("key", "ms", "seq", "type"))


@query(sql("item", body=""", s AS (SELECT key, count(*) AS version, CAST(sum(CASE type WHEN 'item.checked-in' THEN count WHEN 'item.removed' THEN -count ELSE 0 END) AS BIGINT) AS count FROM item GROUP BY key)
  SELECT key, coalesce(version, 0) AS version, count, version IS NULL AS created FROM (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer) LEFT JOIN s USING (key)"""))
def load_or_create(e, spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(C("c_custkey").cast("string").alias("key"))
    return aggregates.load_or_create(wanted, aggregates.items(X.item_events(e))).select("key", "version", "count", "created")


@query(sql("entry", body=f"""SELECT topic, partition, count(*) AS published, count(*) FILTER (WHERE type IN ('purchase', 'signup')) AS consumed, count(*) FILTER (WHERE type NOT IN ('purchase', 'signup')) AS filtered, count(*) FILTER (WHERE {FAILS}) AS errors,
  count(*) FILTER (WHERE event_id % 100 = 50) AS flush_failures, CAST(coalesce(sum(event_id % 7) FILTER (WHERE event_id % 500 = 0), 0) AS BIGINT) AS clamp_released FROM entry GROUP BY ALL"""))
def metrics_counters(e, spark, sf_dir):
    e = e.select("topic", "partition", "type", "event_id")
    return health.counters(
        e.select("topic", "partition", reader.types(TYPES).alias("kept")), e.where(FAILS), e.where("event_id % 50 = 0").select("topic", "partition", (C("event_id") % 100 == 0).alias("ok")),
        e.where("event_id % 500 = 0").select("topic", "partition", (C("event_id") % 7).alias("entries")), e,
    )


@query(sql("ord", body=""", b AS (SELECT partition, (ordinal - 1) // 100 AS batch, count(*) AS read FROM ord GROUP BY ALL)
  SELECT partition, count(*) AS batches, min(read) AS least, quantile_cont(read, 0.5) AS median, quantile_cont(read, 0.95) AS p95, max(read) AS most FROM b GROUP BY partition"""))
def metrics_batches(e, spark, sf_dir):
    return health.batch_sizes(reader.batches(e.select("partition", "ms", "seq", "type"), 100))


@query(sql("pos", "edge", "parts", body=f""", c AS (SELECT DISTINCT consumer FROM pos), l AS (SELECT c.consumer, g.*, p.ms AS position_ms, p.seq AS position_seq FROM c, edge g LEFT JOIN pos p ON p.consumer = c.consumer AND p.partition = g.partition)
  SELECT 'events' AS topic, consumer, partition, CASE WHEN position_ms IS NULL THEN 'starting' ELSE 'running' END AS state, CASE WHEN partition <> 2 THEN 'i' || partition % 3 END AS owner, partition = 2 AS unowned, length, oldest_ms, oldest_seq, newest_ms, newest_seq,
    position_ms, position_seq, position_ms IS NULL OR (position_ms, position_seq) < (newest_ms, newest_seq) AS behind,
    CASE WHEN position_ms IS NULL THEN length WHEN (position_ms, position_seq) >= (newest_ms, newest_seq) THEN 0 WHEN (position_ms, position_seq) < (oldest_ms, oldest_seq) OR newest_ms <= oldest_ms THEN length
      ELSE greatest(1, least(CAST(trunc(CAST(length AS DOUBLE) * (newest_ms - position_ms) / (newest_ms - oldest_ms)) AS BIGINT), length)) END AS lag_entries,
    CASE WHEN position_ms IS NULL OR (position_ms, position_seq) >= (newest_ms, newest_seq) THEN 0.0::DOUBLE ELSE CAST({NOW_MS} - position_ms AS DOUBLE) END AS lag_ms,
    {NOW_MS} - position_ms - 500 AS idle_ms, {NOW_MS} - position_ms AS unpersisted_ms, coalesce(position_seq, 0) AS errors FROM l"""))
def status_row(e, spark, sf_dir):
    at = X.positions(spark, sf_dir)
    every = at.select("consumer").distinct().select(F.lit("events").alias("topic"), "consumer", F.explode(F.sequence(F.lit(0), F.lit(X.PARTITIONS - 1))).alias("partition"))
    owners = X.partitions(spark).where("partition <> 2").select("partition", F.concat(F.lit("i"), (C("partition") % 3).cast("string")).alias("owner"))
    progress = at.select("consumer", "partition", F.lit("running").alias("state"), (C("ms") + 500).alias("last_handled_ms"), C("ms").alias("last_flush_ms"), C("seq").alias("errors"))
    return health.snapshot(every, topics.bounds(e), at, owners, progress, NOW_MS)


@query("SELECT 'n3' AS topic, 5 AS partitions, 500 AS max_len, true AS known UNION ALL SELECT 'none', 1, 10000, false")
def layout_read(e, spark, sf_dir):
    meta = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("topic"), (4 + C("n_nationkey") % 2).cast("int").alias("partitions"), F.lit(500).alias("max_len"))
    return topics.layout(meta, "n3").unionByName(topics.layout(meta, "none"))


@query(sql("entry", body=f"""SELECT partition, event_id AS arrival, ms, seq, (ms, seq) > coalesce(lag((ms, seq)) OVER (PARTITION BY partition ORDER BY event_id), ({PIVOT[0]}, {PIVOT[1]})) AS in_order FROM entry WHERE event_id < 2000"""))
def reply_check(e, spark, sf_dir):
    sent = X.partitions(spark).select("partition", F.lit(PIVOT[0]).cast("long").alias("ms"), F.lit(PIVOT[1]).cast("long").alias("seq"))
    return reader.checked(e.where("event_id < 2000").select("partition", C("event_id").alias("arrival"), "ms", "seq"), sent)


REQUESTS = [({"from_": "2024-01-15T00:00:00"}, "events", False, True), ({"id": "17-3"}, "events", True, True), ({"to": "End"}, "events", False, False), ({"id": "x"}, "a/b", False, True), ({}, "", False, True), ({"id": "1-2", "to": "start"}, "n" * 129, False, True)]


@query("""SELECT * FROM (VALUES (0, 'date', true, 200), (1, 'id', true, 409), (2, 'end', true, 404), (3, 'error', false, 400), (4, 'error', false, 400), (5, 'error', false, 400)) v(request, target, name_ok, status)""")
def admin_validate(e, spark, sf_dir):
    """Requests (target, topic, running, known) as the administration answers them."""
    rows = []
    for i, (target, topic, running, known) in enumerate(REQUESTS):
        to = config.reset_target(target.get("from_"), target.get("id"), target.get("to"))
        rows.append((i, to[0], config.name_error(topic, "topic") is None, config.reset_status(to, running, False, known)))
    return spark.createDataFrame(rows, "request int, target string, name_ok boolean, status int")


@query("""SELECT 'n' || n_nationkey AS topic, 0 AS partition, 'g' || n_regionkey AS member_group, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 0 END AS BIGINT) AS ms, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS seq, n_nationkey % 2 <> 0 AS made FROM nation""")
def group_create(e, spark, sf_dir):
    n, zero = _groups(spark, sf_dir), F.lit(0).cast("long")
    there = n.where("n % 2 = 0").select("topic", "partition", "member_group", F.lit(7).cast("long").alias("ms"), F.lit(1).cast("long").alias("seq"))
    return workqueue.created(there, n.select("topic", "partition", "member_group", zero.alias("ms"), zero.alias("seq")))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.concat(F.lit("n"), C("n_nationkey").cast("string")).alias("topic"), F.lit(0).alias("partition"), F.concat(F.lit("g"), C("n_regionkey").cast("string")).alias("member_group"), C("n_nationkey").alias("n"))


@query(sql("entry", body=f"""SELECT g AS member_group, CAST(CASE WHEN g % 2 = 0 THEN {PIVOT[0]} ELSE 5 END AS BIGINT) AS ms, count(event_id) AS waiting FROM range(6) r(g) LEFT JOIN entry ON g = event_id % 6 AND event_id % 4 > 0 AND g % 3 > 0 GROUP BY ALL"""))
def group_reset(e, spark, sf_dir):
    """Every second group is set to a date, every third purged of what waits."""
    groups = spark.range(6).select(F.lit("events").alias("topic"), F.lit(0).alias("partition"), C("id").alias("member_group"), F.lit(5).cast("long").alias("ms"), F.lit(0).cast("long").alias("seq"))
    waiting = e.where("event_id % 4 > 0").select("topic", F.lit(0).alias("partition"), (C("event_id") % 6).alias("member_group"), "event_id")
    moved = groups.where("member_group % 2 = 0 or member_group % 3 = 0").select("topic", "partition", "member_group", F.when(C("member_group") % 2 == 0, PIVOT[0]).otherwise(5).cast("long").alias("ms"), "seq", (C("member_group") % 3 == 0).alias("purge"))
    after, left = workqueue.reset(groups, waiting, moved)
    return after.join(left.groupBy("member_group").agg(F.count("*").alias("waiting")), "member_group", "left").select("member_group", "ms", F.coalesce("waiting", F.lit(0)).alias("waiting"))


@query(sql("entry", body="""SELECT event_id, '{"user":' || user_id || ',"kind":"' || type || '","more":[1,2.5,null,true],"body":"' || repeat('ab', CAST(event_id % 60 AS INTEGER)) || '"}' AS body FROM entry"""))
def body_msgpack(e, spark, sf_dir):
    """Bodies packed, longer ones in compressed blocks, and read back."""
    text = F.concat(F.lit('{"user":'), C("user_id").cast("string"), F.lit(',"kind":"'), C("type"), F.lit('","more":[1,2.5,null,true],"body":"'), F.expr("repeat('ab', cast(event_id % 60 as int))"), F.lit('"}'))
    return e.select("event_id", bodies.unpacked(bodies.packed(text)).alias("body"))


@query(sql("entry", body="SELECT partition, count(*) AS entries, max(event_id) AS newest FROM (SELECT partition, event_id FROM entry WHERE event_id % 3 < 2) GROUP BY partition"))
def outbox(e, spark, sf_dir):
    """State and entries written together: a batch that is repeated counts once, one whose condition fails not at all."""
    at = X.folder(spark, "outbox")
    for batch, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        own = e.where(C("event_id") % 3 == part)
        met = spark.createDataFrame([("s", 1, 1 if part < 2 else 9)], "name string, expected int, length int")
        store.outbox(own.groupBy("key").agg(F.max("event_id").alias("value")), own.select("topic", "partition", "ms", "seq", "type", "key", C("event_id").cast("string").alias("correlation_id")), f"{at}/state", f"{at}/topic", batch, met)
    return store.read(spark, f"{at}/topic", "events").groupBy("partition").agg(F.count("*").alias("entries"), F.max(C("correlation_id").cast("long")).alias("newest"))
