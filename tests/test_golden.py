"""Values that any implementation of the formats must give."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideway.functions import bodies, codec, ids, routing, texts

# Hashes, routes, packed headers and texts of the formats.
HASHES = {"a": 16629034431890738719, "order-1": 6900751593513035894, "customer:42": 7446690690941263266, "é": 17839895020865391795, "✓ unicode 🎉": 5320203248086416881}
HEADERS = {
    "k-v": ([("k", "v")], b"1:k1:v"),
    "colons": ([("a:1", "2:ab"), ("12:34", "5:6:7"), ("::", "9")], b"3:a:14:2:ab5:12:345:5:6:72:::1:9"),
    "empty": ([("flag", "")], b"4:flag0:"),
    "unicode": ([("ключ", "значение"), ("emoji🎉", "✓")], "8:ключ16:значение9:emoji🎉3:✓".encode()),
}
MALFORMED = [b"1x:a", b":a", b"12", b"3:ab", b"1:a"]
IDS = {"0-0": (0, 0), "1-0": (1, 0), "1726000000000-42": (1726000000000, 42), "9223372036854775807-9223372036854775807": (2**63 - 1, 2**63 - 1)}
NOT_IDS = ["", "-", "1-", "-1", "1-2-3", "a-1", " 1-2", "+1-2", "1--2", "9223372036854775808-0", "1-2\n"]


def test_hashes_and_routes(spark):
    got = spark.createDataFrame([(k,) for k in HASHES], "key string")
    assert {r.key: int(r.h) for r in got.select("key", routing.hash_of("key").alias("h")).collect()} == HASHES
    for n in (1, 2, 3, 7, 8):
        assert {r.key: r.partition for r in routing.by_key(got, n).collect()} == {k: h % n for k, h in HASHES.items()}


def test_headers(spark):
    for pairs, packed in HEADERS.values():
        row = spark.createDataFrame([(pairs,)], "h array<struct<key:string,value:string>>").select(codec.pack_headers(F.col("h")).alias("p"), codec.unpack_headers(codec.pack_headers(F.col("h"))).alias("u")).first()
        assert bytes(row.p) == packed and [(x.key, x.value) for x in row.u] == pairs
    for bad in MALFORMED:
        with pytest.raises(ValueError):
            codec.unpack_block(bad)
    for many in ([("k", "v")] * 65, [("k", "x" * 8200)]):
        with pytest.raises(Exception, match="header"):
            spark.createDataFrame([(many,)], "h array<struct<key:string,value:string>>").select(codec.pack_headers(F.col("h"))).collect()


def test_entry_fields(spark):
    none = F.lit(None).cast("string")
    row = spark.createDataFrame([(b"hello",)], "b binary").select(codec.encode(F.col("b"), F.lit("order.created"), none, none, none, F.lit(None).cast("array<struct<key:string,value:string>>")).alias("f")).first()
    assert [(x.name, base64.b64encode(bytes(x.value)).decode()) for x in row.f] == [("b", "aGVsbG8="), ("t", "b3JkZXIuY3JlYXRlZA=="), ("k", "")]
    state = spark.range(1).select(codec.encode(F.lit(b"x"), F.lit("t"), None, none, none, F.lit(None).cast("array<struct<key:string,value:string>>")).alias("f")).first()
    assert [x.name for x in state.f] == ["b", "t"]
    twice = spark.createDataFrame([([("t", b"a"), ("zz", b"?"), ("t", b"b")],)], "f array<struct<name:string,value:binary>>").select(codec.decode(F.col("f")).alias("d")).first().d
    assert (twice.type, twice.key, bytes(twice.body), twice.trace_parent) == ("b", "", b"", None)
    with pytest.raises(Exception, match="version"):
        spark.range(1).select(codec.supported(F.lit(2))).collect()


def test_ids(spark):
    rows = spark.createDataFrame([(t,) for t in [*IDS, *NOT_IDS, "007-01"]], "t string").select("t", ids.parse(F.col("t")).alias("id")).collect()
    assert {r.t: tuple(r.id) if r.id else None for r in rows} == IDS | dict.fromkeys(NOT_IDS) | {"007-01": (7, 1)}
    top = 2**63 - 1
    edge = spark.createDataFrame([(0, 0), (5, 0), (5, 3), (5, top), (top, top)], "ms long, seq long")
    got = edge.select(ids.before(F.col("ms"), F.col("seq")).alias("b"), ids.following(F.col("ms"), F.col("seq")).alias("n"), *[x.alias(n) for x, n in zip(ids.unpacked(ids.packed(F.col("ms"), F.col("seq"))), "pq", strict=True)], "ms", "seq").collect()
    assert [tuple(r.b) for r in got] == [(0, 0), (4, top), (5, 2), (5, top - 1), (top, top - 1)]
    assert [tuple(r.n) for r in got][:4] == [(0, 1), (5, 1), (5, 4), (6, 0)]
    assert all((r.p, r.q) == (r.ms, r.seq) for r in got)


def test_texts(spark):
    guid = "3f2b8c1e-9a4d-4e6f-8b21-5c7d9e0a1b2c"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(texts.position(F.lit(f"1726000000000-42|{guid}")))) == (1726000000000, 42, guid)
    assert one(texts.position_text(F.lit(0), F.lit(0), F.lit(texts.ADMIN))) == "0-0|6f72616e-6765-4164-6d69-6e5265736574"
    assert tuple(one(texts.marker(F.lit("1726000000000-42|2026-10-25T14:00:00.5000000+02:00")))) == (1726000000000, 42, "2026-10-25T14:00:00.5000000+02:00")
    assert tuple(one(texts.marker(F.lit("5-0")))) == (5, 0, "0001-01-01T00:00:00.0000000+00:00")
    assert tuple(one(texts.owner(F.lit(f"{guid}|orders-consumer-0")))) == (guid, "orders-consumer-0")
    keys = [texts.key("stream", F.lit("a.b-c"), F.lit(3), tagged=False), texts.key("positions_meta", F.lit("orders"), F.lit("svc")), texts.key("state", F.lit("orders"), F.lit("es:Order:42")), texts.key("dedupe", F.lit("orders"), F.lit("evt-1"))]
    assert [one(k) for k in keys] == ["re:s:a.b-c:3", "re:p:{orders}:svc:meta", "re:{orders}:state:es:Order:42", "re:dedupe:{orders}:evt-1"]
    assert [texts.resolve_prefix({"STREAMS_KEY_PREFIX": v}) for v in (None, "custom:", "   ")] == ["re:", "custom:", "re:"]


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text(max_size=40) | st.binary(max_size=40), lambda c: st.lists(c, max_size=20) | st.dictionaries(st.text(max_size=5), c, max_size=20), max_leaves=60)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.binary(max_size=6000).map(lambda b: b * 3))
def test_bodies_round_trip(value, data):
    assert bodies.decode_body(bodies.encode_body(value)) == value
    assert bodies.lz4_unpack(bodies.lz4_pack(data), len(data)) == data


def test_bodies(spark):
    assert bodies.encode_body([7, "seven"]) == b"\x92\x07\xa5seven" and bodies.encode_body({"id": 8, "name": "eight"}) == b"\x82\xa2id\x08\xa4name\xa5eight"
    lines = [1, [f"line-{i:03d}-the quick brown fox jumps" for i in range(200)]]
    large = bodies.encode_body(lines)
    assert large[:2] == b"\x92\xc7" and len(large) < 2000 and bodies.decode_body(large) == lines
    assert len(bodies.encode_body("x" * 1021)) == 1024 and len(bodies.encode_body("x" * 1022)) < 200  # strictly above the limit
    for bad in (b"", b"\x92\x07", b"\xc1", large[:-3]):
        with pytest.raises(ValueError):
            bodies.decode_body(bad)
    row = spark.createDataFrame([('{"a":[1,2]}',)], "j string").select(bodies.unpacked(bodies.packed("j")).alias("j")).first()
    assert row.j == '{"a":[1,2]}'
