"""The driver's tables as topics, state streams, positions and logs, and the same in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.operators.order import numbered
from tideway.operators.topics import assign_ids

PARTITIONS, NOW_MS = 4, 1_706_745_600_000


_folders: dict[str, str] = {}
_topics: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, below spark.checkpoint.dir; a local one, deleted in the end, only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local" not in _folders:
            _folders["local"] = tempfile.mkdtemp(prefix="tideway-")
            atexit.register(shutil.rmtree, _folders["local"], ignore_errors=True)
        root = f"file://{_folders['local']}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic ``events``: partition by user, id by time; value and event_id are carried along.

    Entries are immutable, so the topic is appended to a store once for each session and read from there: by partition, and
    within it in order of ids, so that reads behind a position skip what they need not see. Positions are stored with it.
    """
    return _read(spark, _topic(spark, sf_dir))


def _topic(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _topics:
        path = folder(spark, "events")
        published(spark, sf_dir).repartition("partition", F.expr("ms div 86400000")).sortWithinPartitions("partition", "ms", "seq").write.partitionBy("partition").parquet(path)
        _places(_read(spark, path)).coalesce(1).write.parquet(f"{path}-positions")
        _topics[key] = path
    return _topics[key]


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("topic string, ms long, type string, key string, body binary, event_id long, user_id long, value double, seq long, partition int").parquet(path)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as entries with their ids."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = t.select(
        F.lit("events").alias("topic"), F.pmod("user_id", F.lit(PARTITIONS)).cast("int").alias("partition"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), F.col("props").cast("binary").alias("body"), F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"),
    )
    return assign_ids(rows, ["event_id"])


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(consumer, partition, ms, seq): fast is at the end of each partition, slow in its middle, partial at a quarter but nowhere in 3."""
    return spark.read.schema("consumer string, partition int, ms long, seq long").parquet(f"{_topic(spark, sf_dir)}-positions")


def _places(entries: DataFrame) -> DataFrame:
    rows = numbered(entries.select("partition", "ms", "seq"), ["partition"])
    at = lambda n: F.col("ordinal") == n
    who = F.array_compact(F.array(
        F.when(at(F.col("total")), "fast"), F.when(at(F.greatest(F.lit(1), F.floor(F.col("total") / 2))), "slow"),
        F.when(at(F.greatest(F.lit(1), F.floor(F.col("total") / 4))) & (F.col("partition") != 3), "partial"),
    ))
    return rows.where(F.size(who) > 0).select(F.explode(who).alias("consumer"), "partition", "ms", "seq")


def partitions(spark: SparkSession) -> DataFrame:
    return spark.range(PARTITIONS).select(F.col("id").cast("int").alias("partition"))


def item_events(entries: DataFrame) -> DataFrame:
    """The sample domain out of the topic: (key, ms, seq, type, name, count, event_id)."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "item.created"), ("view", "item.renamed"), ("purchase", "item.checked-in"), ("click", "item.removed"), ("error", "item.deactivated")) for x in p]), F.col("type"))
    return entries.select("key", "ms", "seq", "event_id", kind.alias("type"), F.concat(F.lit("item-"), F.col("event_id").cast("string")).alias("name"), (1 + F.pmod("event_id", F.lit(5))).cast("long").alias("count"))


def statuses(entries: DataFrame) -> DataFrame:
    """A partition status for every entry, its columns made from the entry's number."""
    e = F.col("event_id")
    m = lambda n: F.pmod(e, F.lit(n))
    return entries.select(
        "event_id", (e % 97).alias("process"), F.lit("events").alias("topic"), F.concat(F.lit("c"), m(3).cast("string")).alias("consumer"), F.col("partition"),
        F.element_at(F.array(F.lit("running"), F.lit("blocked"), F.lit("stopped"), F.lit("starting"), F.lit("running"), F.lit("running"), F.lit("running")), (m(7) + 1).cast("int")).alias("state"),
        (m(101) == 0).alias("stood_down_stalled"), (m(2) * 300).alias("stalled_limit"), (m(331) * 1000).alias("stalled_ms"), F.lit(300).cast("long").alias("blocked_limit"), (m(601) * 1000).alias("blocked_ms"),
        F.lit(300).cast("long").alias("stopped_limit"), (m(607) * 1000).alias("stopped_ms"), (m(5) > 0).alias("escalates"), (m(11) - 1).alias("lag_entries"), (m(3) * 100).alias("behind_limit"), (m(13) < 4).alias("behind"),
        (m(211) * 1000).alias("behind_ms"), F.lit(120_000).cast("long").alias("lag_limit_ms"), (m(241) * 1000).alias("lag_ms"), (m(4) * 60).alias("silence_limit"), (m(70) * 1000 - 2000).alias("tail_age_ms"), (m(503) * 1000).alias("unchanged_ms"),
    )


# The same in SQL.
ENTRY = f"""entry AS (
  SELECT 'events' AS topic, CAST(user_id % {PARTITIONS} AS INTEGER) AS partition, epoch_us(ts) // 1000 AS ms,
    CAST(row_number() OVER (PARTITION BY user_id % {PARTITIONS}, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS BIGINT) AS seq,
    event_type AS type, CAST(user_id AS VARCHAR) AS key, props AS body, event_id, user_id, value FROM events)"""
ORD = """ord AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY ms, seq) AS ordinal, count(*) OVER (PARTITION BY partition) AS total FROM entry)"""
POS = """pos AS (
  SELECT 'fast' AS consumer, partition, ms, seq FROM ord WHERE ordinal = total UNION ALL
  SELECT 'slow', partition, ms, seq FROM ord WHERE ordinal = greatest(1, total // 2) UNION ALL
  SELECT 'partial', partition, ms, seq FROM ord WHERE ordinal = greatest(1, total // 4) AND partition <> 3)"""
PARTS = f"parts AS (SELECT CAST(range AS INTEGER) AS partition FROM range({PARTITIONS}))"
EDGE = """edge AS (SELECT partition, min(CASE WHEN ordinal = 1 THEN ms END) AS oldest_ms, min(CASE WHEN ordinal = 1 THEN seq END) AS oldest_seq,
  max(CASE WHEN ordinal = total THEN ms END) AS newest_ms, max(CASE WHEN ordinal = total THEN seq END) AS newest_seq, count(*) AS length FROM ord GROUP BY partition)"""
ITEM = """item AS (SELECT key, ms, seq, event_id, CASE type WHEN 'signup' THEN 'item.created' WHEN 'view' THEN 'item.renamed' WHEN 'purchase' THEN 'item.checked-in'
  WHEN 'click' THEN 'item.removed' WHEN 'error' THEN 'item.deactivated' END AS type, 'item-' || event_id AS name, CAST(1 + event_id % 5 AS BIGINT) AS count FROM entry)"""
STATUS = """status AS (SELECT event_id, event_id % 97 AS process, 'events' AS topic, 'c' || (event_id % 3) AS consumer, partition,
  ['running','blocked','stopped','starting','running','running','running'][event_id % 7 + 1] AS state, event_id % 101 = 0 AS stood_down_stalled, event_id % 2 * 300 AS stalled_limit,
  event_id % 331 * 1000 AS stalled_ms, 300 AS blocked_limit, event_id % 601 * 1000 AS blocked_ms, 300 AS stopped_limit, event_id % 607 * 1000 AS stopped_ms, event_id % 5 > 0 AS escalates,
  event_id % 11 - 1 AS lag_entries, event_id % 3 * 100 AS behind_limit, event_id % 13 < 4 AS behind, event_id % 211 * 1000 AS behind_ms, 120000 AS lag_limit_ms, event_id % 241 * 1000 AS lag_ms,
  event_id % 4 * 60 AS silence_limit, event_id % 70 * 1000 - 2000 AS tail_age_ms, event_id % 503 * 1000 AS unchanged_ms FROM entry)"""
GRADED = """graded AS (SELECT *, CASE WHEN stood_down_stalled OR (stalled_limit > 0 AND stalled_ms >= stalled_limit * 1000) THEN 'Stalled'
  WHEN state = 'blocked' AND blocked_ms > blocked_limit * 1000 THEN 'BlockedTooLong' WHEN state = 'blocked' THEN 'Blocked'
  WHEN state = 'stopped' AND escalates AND lag_entries > 0 AND stopped_ms > stopped_limit * 1000 THEN 'StoppedTooLong' WHEN state = 'stopped' THEN 'Stopped'
  WHEN behind_limit > 0 AND behind AND behind_ms >= behind_limit * 1000 THEN 'BehindTail' WHEN lag_ms > lag_limit_ms AND lag_entries <> 0 THEN 'Lagging' ELSE 'None' END AS rule FROM status)"""
_ALL = {"entry": ENTRY, "ord": ORD, "pos": POS, "parts": PARTS, "edge": EDGE, "item": ITEM, "status": STATUS, "graded": GRADED}
_NEEDS = {"entry": [], "ord": ["entry"], "pos": ["ord"], "parts": [], "edge": ["ord"], "item": ["entry"], "status": ["entry"], "graded": ["status"]}


def sql(*names: str, body: str, recursive: bool = False) -> str:
    """A query over the named relations and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(_ALL[n] for n in order) + ("\n" if not body.lstrip().startswith(",") else "") + body


