"""Entries as named fields, and headers as one packed field of length-prefixed keys and values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The version that topics record and that is read; limits of a header block.
VERSION, MOST_HEADERS, MOST_HEADER_BYTES = 1, 64, 8192


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("binary").alias("value"))


def encode(body: Column, type: Column, key: Column | None, correlation_id: Column, trace_parent: Column, headers: Column) -> Column:
    """array<struct<name, value binary>>: b, t, k (never left out on topics; None for state entries), then c, p, h if not empty."""
    type = F.coalesce(type, F.raise_error(F.lit("an entry needs a type")).cast("string"))
    packed = pack_headers(headers)
    none = F.expr("cast(array() as array<struct<name:string,value:binary>>)")
    optional = lambda name, v: F.when(F.octet_length(v) > 0, F.array(field(name, v))).otherwise(none)
    fields = [field("b", F.coalesce(body, F.lit("").cast("binary"))), field("t", type)]
    fields += [field("k", F.coalesce(key, F.lit("")))] if key is not None else []
    # Arrays put together are compiled code, a filter with a lambda is not.
    return F.concat(F.array(*fields), optional("c", correlation_id), optional("p", trace_parent), bound(packed, lambda h: optional("h", h)))


def last_field(fields: Column, name: str) -> Column:
    """The value of the last field of that name."""
    return F.try_element_at(F.filter(fields, lambda f: f["name"] == F.lit(name)), F.lit(-1))["value"]


def decode(fields: Column) -> Column:
    """struct<body, type, key, correlation_id, trace_parent, headers>; unknown fields are ignored, missing ones have their default."""
    text = lambda n: last_field(fields, n).cast("string")
    empty = F.lit("")
    return F.struct(
        F.coalesce(last_field(fields, "b"), empty.cast("binary")).alias("body"),
        F.coalesce(text("t"), empty).alias("type"),
        F.coalesce(text("k"), empty).alias("key"),
        F.coalesce(text("c"), empty).alias("correlation_id"),
        text("p").alias("trace_parent"),
        F.coalesce(last_field(fields, "h"), empty.cast("binary")).alias("packed_headers"),
    )


def supported(version: Column) -> Column:
    """The version, or an error for any but the one that is read."""
    return F.when(version == VERSION, version).otherwise(F.raise_error(F.concat(F.lit("codec version is not supported: "), version.cast("string"))).cast("int"))


def pack_headers(headers: Column) -> Column:
    """binary ``len:key len:value ...`` (no blanks) of array<struct<key, value>>; refuses nulls and what is over a limit."""
    piece = lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)
    refuse = lambda why: F.raise_error(F.lit(why)).cast("string")

    def whole(text: Column) -> Column:
        # A null among keys and values makes the whole null.
        return (
            F.when(text.isNull(), refuse("a header needs a key and a value"))
            .when(F.size(headers) > MOST_HEADERS, refuse("too many headers"))
            .when(F.octet_length(text) > MOST_HEADER_BYTES, refuse("headers are too long"))
            .otherwise(text)
        )

    joined = F.aggregate(headers, F.lit(""), lambda s, h: F.concat(s, piece(h["key"]), piece(h["value"])))
    return F.when(headers.isNull() | (F.size(headers) == 0), F.lit("")).otherwise(bound(joined, whole)).cast("binary")


def unpack_block(block: bytes | None) -> list[dict[str, str]]:
    """The headers of a block in order; ValueError if it is malformed."""
    out, at, data = [], 0, block or b""

    def text() -> str:
        nonlocal at
        colon = data.find(b":", at)
        if colon <= at or not data[at:colon].isdigit():
            raise ValueError("malformed header length")
        start, at = colon + 1, colon + 1 + int(data[at:colon])
        if at > len(data):
            raise ValueError("header runs over the end")
        return data[start:at].decode("utf-8", "replace")

    while at < len(data):
        key = text()
        if at >= len(data):
            raise ValueError("header without a value")
        out.append({"key": key, "value": text()})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def unpack_headers(blocks: pd.Series) -> pd.Series:
    """Headers of packed blocks, null where a block is malformed: lengths are in bytes, which no built-in function walks.

    Within a batch equal blocks are walked once, as entries of one kind have the same headers.
    """

    def one(b):
        try:
            return unpack_block(b)
        except ValueError:
            return None

    own = {b: one(b) for b in blocks.unique()}
    return pd.Series([own[b] for b in blocks], dtype=object)


def header(headers: Column, key: str) -> Column:
    """The first value under a key, or null."""
    return F.get(F.filter(headers, lambda h: h["key"] == F.lit(key)), F.lit(0))["value"]


def header_map(headers: Column) -> Column:
    """map<key, value>; of equal keys the last wins."""
    kept = F.filter(headers, lambda h, i: ~F.exists(F.slice(headers, i + F.lit(2), F.greatest(F.size(headers) - i - F.lit(1), F.lit(0))), lambda o: o["key"] == h["key"]))
    return F.map_from_entries(kept)


def same_headers(a: Column, b: Column) -> Column:
    return pack_headers(a) == pack_headers(b)


def dump(topic: Column, partition: Column, id: Column, type: Column, key: Column, body: Column) -> Column:
    """An entry for people: its fields, and hex and printable ASCII of the body's first 48 bytes."""
    shown = F.substring(body, 1, 48)
    more = F.when(F.octet_length(body) > 48, F.lit("…")).otherwise(F.lit(""))
    hexed = F.lower(F.regexp_replace(F.hex(shown), "(..)", "$1 "))
    # Byte by byte: Latin-1 has a character for each.
    ascii_ = F.regexp_replace(F.decode(shown, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    line = lambda label, v: F.when(F.length(v) > 0, F.concat(F.lit(f"  {label:<9}"), v, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("entry "), id, F.lit("  partition "), partition.cast("string"), F.lit("  topic "), topic, F.lit("\n"),
        line("type", type), line("key", key),
        F.lit("  body     "), F.octet_length(body).cast("string"), F.lit(" bytes\n"),
        F.when(F.octet_length(body) > 0, F.concat(F.lit(" " * 12), hexed, more, F.lit("\n" + " " * 12), ascii_, more, F.lit("\n"))).otherwise(F.lit("")),
    )
