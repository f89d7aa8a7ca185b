"""WARC derivative builder: responses become linked metadata records and plain-text conversion records.

A response record is parsed (WARC headers, HTTP headers, transfer and content encodings, charset). From it come

* a ``metadata`` record of ``application/warc-fields`` about the response: its HTTP status, media type, charset, lengths
  and digests, title, description and outgoing links;
* a ``conversion`` record of ``text/plain`` with the visible text of an HTML or text payload. A payload that is neither,
  or has no text, has no conversion.

Both name the response in WARC-Refers-To and WARC-Concurrent-To (metadata), keep its target URI, date, IP address,
payload digest and warcinfo id as source headers, and have block digests of their own. Record ids come from the
response's id and the kind of derivative, so building again gives the same records. Records are written byte for byte
as WARC/1.0 asks, and can be read again with the parser.

A null record, or bytes that are no WARC response, give no derivatives and are reported by ``derive`` with a reason. A
repeated response gives repeated derivatives; extra columns are left out. Responses are handled one by one, so no row
meets another and nothing is shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urljoin

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.0"
CRLF = b"\r\n"
#: Headers of a response that its derivatives keep.
SOURCE_HEADERS = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Payload-Digest", "WARC-Warcinfo-ID")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
SCHEMA = "response_id string, target_uri string, kind string, record_id string, refers_to string, content_type string, block_digest string, payload_digest string, length long, record binary, problem string"

#: Field of a metadata record that says why there is no conversion.
PROBLEM = "problem"

RAW_TEXT = re.compile(r"<!--|<(script|style|noscript|template|svg|iframe|title|textarea)\b[^>]*+>", re.I)
BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*+>", re.I)
TAGS = re.compile(r"<[/!?a-zA-Z][^<>]*+>")
TITLE = re.compile(r"<title\b[^>]*+>([^<]*)", re.I)
DESCRIPTION = re.compile(r"<meta\b(?=[^<>]*\bname\s*=\s*[\"']?description\b)[^<>]*\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
META_CHARSET = re.compile(rb"<meta\b[^<>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.I)


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def header_lines(raw: bytes) -> list[tuple[str, str]]:
    """Name and value of each header; a line that starts with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def split_head(data: bytes) -> tuple[bytes, bytes]:
    """What stands before the first empty line, and what stands behind it."""
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end() :]) if m else (data, b"")


def parse(data: bytes) -> Record:
    """One record from its bytes, plain or as a gzip member."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    data = data.lstrip(b"\r\n")
    head, rest = split_head(data)
    first, _, lines = head.partition(b"\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    r = Record(header_lines(lines), rest)
    length = r.get("Content-Length")
    if length is None or not length.isascii() or not length.isdigit():
        raise ValueError("no content length")
    if len(rest) < int(length):
        raise ValueError("record is cut off")
    r.block = rest[: int(length)]
    return r


HEAD_END = re.compile(rb"\r?\n\r?\n")
#: Bytes that are read from a file at a time.
CHUNK = 1 << 20


def records(source: BinaryIO) -> Iterator[bytes]:
    """The records of a WARC file, plain or gzipped record by record, read as they come: memory holds one record and a chunk."""
    held, chunks = bytearray(), unzipped_chunks(source)
    more = True

    def fill() -> bool:
        nonlocal more
        chunk = next(chunks, None)
        more = chunk is not None
        held.extend(chunk or b"")
        return more

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not fill():
                return
        del held[:at]
        while not (end := HEAD_END.search(held)):
            if not fill():
                return
        length = Record(header_lines(bytes(held[: end.start()])), b"").get("Content-Length")
        stop = end.end() + (int(length) if length and length.isascii() and length.isdigit() else 0)
        while len(held) < stop and fill():
            pass
        yield bytes(held[:stop])
        del held[:stop]


def unzipped_chunks(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file, member after member where it is gzipped."""
    chunk = source.read(CHUNK)
    if chunk[:2] != b"\x1f\x8b":
        while chunk:
            yield chunk
            chunk = source.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while chunk:
        data = member.decompress(chunk, CHUNK)
        if data:
            yield data
        chunk = member.unused_data if member.eof else member.unconsumed_tail
        if member.eof:
            member = zlib.decompressobj(31)
            chunk = chunk.lstrip(b"\0")
        chunk = chunk or source.read(CHUNK)


def build(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of a record."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return VERSION + CRLF + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines).encode() + CRLF + block + CRLF + CRLF


def dechunked(body: bytes) -> bytes:
    """A chunked body put together; a body that is not chunked well stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body[at : at + 2] == CRLF else body[at : at + 1] == b"\n"


def encodings(encoding: str) -> list[str]:
    return [x.strip().lower() for x in encoding.split(",") if x.strip()]


def unsupported(encoding: str) -> str | None:
    """What is wrong with content encodings that cannot be undone here."""
    odd = [e for e in encodings(encoding) if e not in ("gzip", "x-gzip", "deflate", "identity", "none", "utf-8")]
    return f"content encoding {', '.join(odd)} is not supported" if odd else None


def unzipped(body: bytes) -> bytes:
    """All members of a gzip body; what follows the last one is left out."""
    out, rest = [], body
    while rest:
        one = zlib.decompressobj(47)
        try:
            out.append(one.decompress(rest))
        except zlib.error:
            if not out:
                raise
            break
        rest = one.unused_data
    return b"".join(out)


def decoded(body: bytes, encoding: str) -> bytes:
    """The body without its content encodings; what cannot be undone stays."""
    for e in reversed(encodings(encoding)):
        try:
            if e in ("gzip", "x-gzip"):
                body = unzipped(body)
            elif e == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
        except zlib.error:
            return body
    return body


def charset(content_type: str, body: bytes) -> str:
    """The charset that the header, a byte order mark or the page names; UTF-8 if none does or it is unknown."""
    m = re.search(r"charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", content_type, re.I)
    name = "utf-8-sig" if body[:3] == b"\xef\xbb\xbf" else m[1] if m else (x[1].decode("ascii") if (x := META_CHARSET.search(body)) else "utf-8")
    try:
        "".encode(name)
        return name if name.lower().replace("-", "").replace("_", "") not in ("utf16", "utf32") or m else "utf-8"
    except LookupError:
        return "utf-8"


def visible(page: str) -> str:
    """The text of a page: a line for each block, no markup, scripts or comments, references decoded."""
    parts, at = [], 0
    gone: set[str] = set()
    while m := RAW_TEXT.search(page, at):
        parts.append(page[at : m.start()])
        tag = (m[1] or "").lower()
        end = re.compile(f"</{tag}\\s*>" if tag else "-->", re.I).search(page, m.end()) if tag not in gone else None
        if end is None:
            gone.add(tag)
            at = m.end() if tag not in ("script", "style", "") else len(page)
        else:
            parts.append(" " if tag not in ("title",) else "\n")
            at = end.end()
    parts.append(page[at:])
    text = TAGS.sub("", BREAKS.sub("\n", "".join(parts)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derivatives(data: bytes) -> tuple[Record, list[tuple[str, str, str, str, bytes, bytes]]]:
    """The response, and (kind, record id, content type, payload digest, block, record) of what is derived from it."""
    r = parse(data)
    if (r.get("WARC-Type") or "").lower() != "response":
        raise ValueError("no response")
    source, uri = r.get("WARC-Record-ID") or "", r.get("WARC-Target-URI") or ""
    if not source:
        raise ValueError("no record id")
    head, body = split_head(r.block)
    status, _, lines = head.partition(b"\n")
    if not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    http = Record(header_lines(lines), body)
    if "chunked" in (http.get("Transfer-Encoding") or "").lower():
        body = dechunked(body)
    coded = unsupported(http.get("Content-Encoding") or "")
    payload = body if coded else decoded(body, http.get("Content-Encoding") or "")
    media, name = (http.get("Content-Type") or "").partition(";")[0].strip().lower(), charset(http.get("Content-Type") or "", payload)
    is_html = not coded and (media in ("text/html", "application/xhtml+xml") or not media and payload.lstrip()[:1] == b"<")
    page = payload.decode(name, "replace") if is_html or not coded and media.startswith("text/") else ""
    digest = r.get("WARC-Payload-Digest") or sha1(body)
    kept = [(h, v) for h in SOURCE_HEADERS if (v := r.get(h) or (digest if h == "WARC-Payload-Digest" else None))]

    def made(kind: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> tuple[str, str, str, str, bytes, bytes]:
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{source} {kind}')}>"
        return kind, own, content_type, digest, block, build(kind, [("WARC-Record-ID", own), *kept, ("WARC-Refers-To", source), *more, ("Content-Type", content_type)], block)

    fields = [("http-status", status.decode("latin-1").strip().split(" ")[1] if b" " in status else ""), ("media-type", media), ("charset", name if page else ""), ("payload-length", str(len(payload))), ("payload-digest", sha1(payload))]
    if coded:
        fields.append((PROBLEM, coded))
    fields += [("source-block-digest", r.get("WARC-Block-Digest") or sha1(r.block))]
    if is_html:
        if m := TITLE.search(page):
            fields.append(("title", html.unescape(m[1])))
        if m := DESCRIPTION.search(page):
            fields.append(("description", html.unescape(m[1] or m[2] or "")))
        for m in LINK.finditer(page):
            target = html.unescape(m[1] or m[2] or m[3] or "").strip()
            if target and not target.lower().startswith(("javascript:", "#", "data:")):
                try:
                    fields.append(("outlink", urljoin(uri, target)))
                except ValueError:
                    continue
    block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = [made("metadata", "application/warc-fields", block, [("WARC-Concurrent-To", source)])]
    text = visible(page) if is_html else page
    if text.strip():
        out.append(made("conversion", "text/plain; charset=utf-8", text.encode(), []))
    return r, out


def problem_of(block: bytes) -> str | None:
    """The problem that a metadata block names."""
    return next((v for k, v in header_lines(block) if k == PROBLEM), None)


def derive(responses: DataFrame, column: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """The derivatives of every response record in a binary column, by SCHEMA, behind the columns to keep; what is no
    response has one row with a problem, and what has an unsupported content encoding has it with its metadata."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.string() for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            of: list[int] = []
            for i, data in enumerate(b.column(len(keep)).to_pylist()):
                try:
                    r, made = derivatives(data or b"")
                    new = [(r.get("WARC-Record-ID"), r.get("WARC-Target-URI"), kind, own, r.get("WARC-Record-ID"), content_type, sha1(block), digest, len(block), record, problem_of(block) if kind == "metadata" else None) for kind, own, content_type, digest, block, record in made]
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    new = [(None,) * 10 + (str(e) or type(e).__name__,)]
                rows += new
                of += [i] * len(new)
            own = [b.column(k).take(pa.array(of, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(own + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=[*keep, *names])

    if clash := set(keep) & set(names):
        raise ValueError(f"columns to keep are called like derived ones: {', '.join(sorted(clash))}")
    own = "".join(f"`{k}` {responses.schema[k].dataType.simpleString()}, " for k in keep)
    return responses.select(*keep, column).mapInArrow(run, own + SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, record binary) of every record of WARC files. Files are listed by Spark and streamed by the workers, so that their size
    does not matter; on a store that Arrow does not know they come as whole rows of Spark's reader."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                source = io.BytesIO(b.column(1)[i].as_py()) if b.num_columns > 1 else opened(p)
                with source:
                    for r in records(source):
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([r], pa.binary())], names=["path", "record"])

    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        if first:
            opened(first["path"]).close()
        files = files.select("path")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        files = files.select("path", "content")
    return files.mapInArrow(run, "path string, record binary")


def opened(path: str) -> BinaryIO:
    """A file by the path that Spark lists."""
    path = re.sub(r"^file:/+", "file:///", path)
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(unquote(at) if path.startswith("file:") else at)


def responses_of(pages: DataFrame) -> DataFrame:
    """(page_id, record binary): a response record for every page (page_id, url, html), by built-in functions only."""
    url, body = F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20"), F.coalesce("html", F.lit("")).cast("binary")
    text = lambda c: c.cast("binary")
    http = F.concat(text(F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.octet_length(body))), body)
    h = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url), 256)
    own = F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(h, a, n),)], F.lit(">"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(text(head), http, text(F.lit("\r\n\r\n"))).alias("record"))
