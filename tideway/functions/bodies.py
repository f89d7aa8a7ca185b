"""MessagePack bodies, plain or as LZ4 blocks: a small codec, as neither format is a built-in function."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bodies longer than this are compressed, where compression is on. The extension types of compressed bodies.
COMPRESS_ABOVE, ONE_BLOCK, BLOCKS = 1024, 99, 98
BLOCK_BYTES = 32_768


def pack(v) -> bytes:
    """A value of None, bool, int, float, str, bytes, list or dict as MessagePack."""
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if -32 <= v < 128:
            return struct.pack("b", v)
        for code, form, low, high in ((0xCC, "B", 0, 2**8), (0xCD, ">H", 0, 2**16), (0xCE, ">I", 0, 2**32), (0xCF, ">Q", 0, 2**64), (0xD0, "b", -(2**7), 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if low <= v < high:
                return bytes([code]) + struct.pack(form, v)
        raise ValueError("integer is too long")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return _head(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(v, (bytes, bytearray)):
        return _head(len(v), None, 0, (0xC4, 0xC5, 0xC6)) + bytes(v)
    if isinstance(v, (list, tuple)):
        return _head(len(v), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, v))
    if isinstance(v, dict):
        return _head(len(v), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(x) for k, x in v.items())
    raise TypeError(f"no MessagePack form for {type(v).__name__}")


def _head(n: int, fix: int | None, below: int, codes: tuple) -> bytes:
    if fix is not None and n < below:
        return bytes([fix | n])
    for code, form, most in zip(codes, ("B", ">H", ">I"), (2**8, 2**16, 2**32), strict=True):
        if code is not None and n < most:
            return bytes([code]) + struct.pack(form, n)
    raise ValueError("too long")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("body is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def value(self):
        c = self.take(1)[0]
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c < 0x90:
            return self.pairs(c & 15)
        if c < 0xA0:
            return [self.value() for _ in range(c & 15)]
        if c < 0xC0:
            return self.take(c & 31).decode()
        sizes = {0: "B", 1: ">H", 2: ">I"}
        if c == 0xC0:
            return None
        if c in (0xC2, 0xC3):
            return c == 0xC3
        if c in (0xC4, 0xC5, 0xC6):
            return self.take(self.number(sizes[c - 0xC4]))
        if c in (0xC7, 0xC8, 0xC9):
            return self.extension(self.number(sizes[c - 0xC7]))
        if c in (0xCA, 0xCB):
            return self.number(">f" if c == 0xCA else ">d")
        if 0xCC <= c <= 0xD3:
            return self.number(("B", ">H", ">I", ">Q", "b", ">h", ">i", ">q")[c - 0xCC])
        if 0xD4 <= c <= 0xD8:
            return self.extension(1 << (c - 0xD4))
        if c in (0xD9, 0xDA, 0xDB):
            return self.take(self.number(sizes[c - 0xD9])).decode()
        if c in (0xDC, 0xDD):
            return [self.value() for _ in range(self.number(sizes[c - 0xDB]))]
        if c in (0xDE, 0xDF):
            return self.pairs(self.number(sizes[c - 0xDD]))
        raise ValueError("malformed body")

    def pairs(self, n: int) -> dict:
        return {k: v for k, v in ((self.value(), self.value()) for _ in range(n))}

    def extension(self, n: int):
        kind = self.number("b")
        return Extension(kind, self.take(n))


class Extension(tuple):
    """(kind, bytes) of an extension value."""

    def __new__(cls, kind: int, data: bytes):
        return super().__new__(cls, (kind, data))


def lz4_unpack(block: bytes, size: int) -> bytes:
    """One LZ4 block of a known size."""
    out, at = bytearray(), 0

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                b = block[at]
                at += 1
                n += b
                if b < 255:
                    break
        return n

    while at < len(block):
        token = block[at]
        at += 1
        n = more(token >> 4)
        out += block[at : at + n]
        at += n
        if at >= len(block):
            break
        back = block[at] | block[at + 1] << 8
        at += 2
        n = more(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("malformed block")
        while n:  # a match may overlap what it writes
            part = out[len(out) - back : len(out) - back + n]
            out += part
            n -= len(part)
    if len(out) != size:
        raise ValueError("block has another length")
    return bytes(out)


def lz4_pack(data: bytes) -> bytes:
    """One LZ4 block; matches are found by the last place of each four bytes."""
    out, anchor, at, seen, n = bytearray(), 0, 0, {}, len(data)

    def rest(x: int) -> bytes:
        return b"\xff" * ((x - 15) // 255) + bytes([(x - 15) % 255]) if x >= 15 else b""

    def put(literals: bytes, back: int, length: int) -> None:
        a, b = len(literals), length - 4
        out.append(min(a, 15) << 4 | (min(b, 15) if back else 0))
        out.extend(rest(a) + literals)
        if back:
            out.extend(back.to_bytes(2, "little") + rest(b))

    while at + 12 < n:  # the last match starts twelve bytes before the end, at least
        four = data[at : at + 4]
        was = seen.get(four)
        seen[four] = at
        if was is None or at - was > 65_535:
            at += 1
            continue
        end = at + 4
        while end < n - 5 and data[end] == data[was + end - at]:
            end += 1
        put(data[anchor:at], at - was, end - at)
        anchor = at = end
    put(data[anchor:], 0, 4)
    return bytes(out)


def encode_body(value, compress: bool = True) -> bytes:
    """A value as a body: in compressed blocks if it is longer than COMPRESS_ABOVE."""
    raw = pack(value)
    if not compress or len(raw) <= COMPRESS_ABOVE:
        return raw
    parts = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = b"".join(map(pack, map(len, parts)))
    return _head(len(parts) + 1, 0x90, 16, (None, 0xDC, 0xDD)) + _head(len(sizes), None, 0, (0xC7, 0xC8, 0xC9)) + bytes([BLOCKS]) + sizes + b"".join(pack(lz4_pack(p)) for p in parts)


def decode_body(body: bytes):
    """The value of a body, compressed or not; ValueError if it is malformed."""
    try:
        r = _Reader(bytes(body))
        v = r.value()
        if r.at != len(r.data):
            raise ValueError("bytes behind the body")
        if isinstance(v, Extension) and v[0] == ONE_BLOCK:
            inner = _Reader(v[1])
            size = inner.value()
            return decode_body(lz4_unpack(v[1][inner.at :], size))
        if isinstance(v, list) and v and isinstance(v[0], Extension) and v[0][0] == BLOCKS:
            sizes = _Reader(v[0][1])
            return decode_body(b"".join(lz4_unpack(b, sizes.value()) for b in v[1:]))
        return v
    except (IndexError, struct.error, UnicodeDecodeError, TypeError) as e:
        raise ValueError("malformed body") from e


@F.pandas_udf(T.BinaryType())
def packed(json_texts: pd.Series) -> pd.Series:
    """Bodies of JSON texts."""
    return json_texts.map(lambda t: None if t is None else encode_body(json.loads(t)))


@F.pandas_udf(T.StringType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """JSON texts of bodies, null where one is malformed."""

    def one(b):
        try:
            return None if b is None else json.dumps(decode_body(b), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, TypeError):
            return None

    return bodies.map(one)
