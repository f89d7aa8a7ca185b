"""Personal data in text: regular expressions propose spans, checks confirm them, context words adjust their score.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of fixed patterns, kept or dropped by
their check alone. Added kinds need more: an IBAN its mod-97, an IPv6 address its parse, a card number in another
notation Luhn, a phone number its digits, a national number its check letter, key or rules, an access token in
hexadecimal the entropy of a random one, *and* a score of at least THRESHOLD, which words close to the span raise or lower.

Every scan is linear: a match of the e-mail pattern is found from its @, and runs of digits are entered at their start
only, which gives the same matches as the plain patterns without their quadratic retries on long runs.

Null text is the empty text. Spans are code points, end exclusive. Repeated rows are judged each; in ``detect`` and
``mask`` other columns pass unchanged, and a column that is called like a new one is replaced by it.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideway.llm.common import texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ipv6", "card_other", "phone_other", "national_id", "secret")
THRESHOLD = 0.6
#: Characters before and after a span in which context words count.
REACH = 48

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:(?<=::)|(?<!:))(?![0-9A-Za-z]|:[0-9A-Za-z:]|\.[0-9])")
CARD_OTHER = re.compile(r"(?<![0-9A-Za-z./])[0-9]{4}([./_]|--| - )[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])")
PHONE_OTHER = re.compile(r"(?<![0-9A-Za-z+.,/-])(?:00[1-9]|\(?0?[1-9])[0-9]{1,5}\)?(?:[ ./-]?[0-9]{2,5}){2,4}(?![0-9A-Za-z]|[.,][0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9XYZ][0-9]{7}-?[A-Z]|[12](?: ?[0-9]){14})(?![0-9A-Za-z-])")

# Words that speak for a kind and words that speak for some other number.
CONTEXT = {
    "iban": "iban bank account konto kontonummer compte cuenta banco banque transfer überweisung virement",
    "ipv6": "ip ipv6 host address server adresse dirección",
    "card_other": "card credit visa mastercard amex karte kreditkarte carte tarjeta cvv payment",
    "phone_other": "phone call tel telephone mobile cell fax sms whatsapp contact telefon handy anrufen rufen téléphone appelez portable teléfono llame móvil",
    "national_id": "ssn social security id identity tax",
    "secret": "token key secret password passwd api auth bearer credential passwort schlüssel clé contraseña clave",
}
AGAINST = "order invoice isbn issn version page seite total price amount serial item part article artikel number§ eur usd kg km"
#: Score of a confirmed span without context; each context word moves it by STEP, at most three times.
PRIOR = {"iban": 0.8, "ipv6": 0.7, "card_other": 0.6, "phone_other": 0.4, "national_id": 0.4, "secret": 0.4}
STEP = 0.2
WORD = re.compile(r"[^\W\d_]+")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
_for = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_against = frozenset(AGAINST.split())


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces passes ISO 7064 mod 97-10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at - (len(run) - len(run.rstrip(LOCAL))) if (run := text[end:at]) else at
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, at)
        at = text.find("@", at + 1 if end <= at else end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the base kinds, by start, then kind as listed."""
    found = [("email", *s) for s in emails(text)]
    if HAS_DIGIT(text):
        found += [(k, *s) for k, f in (("ip", ips), ("card", cards), ("phone", phones)) for s in f(text)]
    return sorted(found, key=lambda x: (x[1], BASE.index(x[0])))


HAS_DIGIT = re.compile(r"[0-9]").search


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, moved by the context words around the span; 0 to 1."""
    near = [w.lower() for w in WORD.findall(text[max(0, start - REACH) : start]) + WORD.findall(text[end : end + REACH // 2])]
    votes = sum(w in _for[kind] for w in near) - sum(w in _against for w in near)
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * max(-3, min(3, votes)))), 4)


def _ipv6(s: str) -> bool:
    try:
        return not ipaddress.IPv6Address(s).is_unspecified
    except ValueError:
        return False


def national_id(s: str) -> bool:
    """Rules of the three notations: numbers never given out (US), check letter modulo 23 (ES), key modulo 97 (FR)."""
    if s[3:4] == "-":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" and s not in NEVER_GIVEN
    if s[-1].isalpha():
        return LETTERS[int(s[:8].translate(FOREIGN)) % 23] == s[-1]
    d = digits(s)
    return 97 - int(d[:13]) % 97 == int(d[13:])


# Numbers printed in advertisements; the check letters by remainder; what X, Y and Z stand for.
NEVER_GIVEN = ("078-05-1120", "219-09-9999")
LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
FOREIGN = str.maketrans("XYZ", "012")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


CONFIRM = {
    "iban": lambda s: 15 <= len(t := s.replace(" ", "")) <= 34 and mod97(t),
    "ipv6": _ipv6,
    "card_other": lambda s: 13 <= len(d := digits(s)) <= 19 and luhn(d),
    "phone_other": lambda s: 7 <= len(digits(s)) <= 15,
    "national_id": national_id,
    "secret": lambda s: entropy(s) >= 3,
}
PROPOSE = {"iban": IBAN, "ipv6": IPV6, "card_other": CARD_OTHER, "phone_other": PHONE_OTHER, "national_id": NATIONAL_ID, "secret": SECRET}


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans of the added kinds with their score; none overlaps a base span or an earlier kind's span."""
    out: list[tuple[str, int, int, float]] = []
    if not HAS_DIGIT(text):
        return out
    taken = united([(s, e) for _, s, e in base])
    for kind, pattern in PROPOSE.items():
        if kind == "ipv6" and text.count(":") < 2:
            continue
        new, i = [], 0
        for m in pattern.finditer(text):
            s, e = m.span()
            while i < len(taken) and taken[i][1] <= s:  # matches and what is taken are both in order
                i += 1
            if (i == len(taken) or taken[i][0] >= e) and CONFIRM[kind](m[0]) and (p := score(kind, text, s, e)) >= THRESHOLD:
                new.append((kind, s, e, p))
        if new:
            out += new
            taken = united(taken + [(s, e) for _, s, e, _ in new])
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same characters, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of a text, by start, then kind as listed; base spans score 1."""
    base = base_spans(text or "")
    return sorted([(*b, 1.0) for b in base] + added_spans(text or "", base), key=lambda x: (x[1], KINDS.index(x[0])))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    out, at, run = [], 0, None
    for kind, s, e, _ in [*spans, ("", len(text) + 1, 0, 0.0)]:
        if run and s < run[2]:
            run = (run[0], run[1], max(run[2], e))
            continue
        if run:
            out += [text[at : run[1]], f"<{run[0].upper()}>"]
            at = run[2]
        run = (kind, s, e)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t) for t in texts_of(batch.column(1))]
            base = [[s for s in r if s[0] in BASE] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base]),
                    pa.array([joined(r) for r in rows], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _mapped(docs: DataFrame, fields: list[T.StructField], change, text_column: str) -> DataFrame:
    """All columns of docs, those in ``fields`` put in place or added; change(texts) gives their Arrow arrays."""
    named = {f.name for f in fields}
    schema = T.StructType([next((g for g in fields if g.name == f.name), f) for f in docs.schema] + [f for f in fields if f.name not in docs.columns])
    assert len(set(docs.columns)) == len(docs.columns), "two columns have one name"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = change(batch.column(batch.schema.get_field_index(text_column)))
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in named} | new
            yield pa.RecordBatch.from_arrays([cols[f] for f in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def detect(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with pii array<struct<kind, start, end, score>>."""
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return _mapped(docs, [T.StructField("pii", T.ArrayType(kind))], lambda c: {"pii": pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in texts_of(c)], arrow)}, text_column)


def mask(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with every span masked in the text and, where that column is there, the new length; null text stays null."""
    length = [f for f in docs.schema if f.name == length_column]

    def change(c: pa.Array) -> dict[str, pa.Array]:
        new = [None if t is None else masked(t, spans) if (spans := find(t)) else t for t in c.to_pylist()]
        out = {text_column: pa.array(new, pa.string())}
        if length:
            out[length_column] = pa.array([None if t is None else len(t) for t in new], pa.int64())
        return out

    return _mapped(docs, [T.StructField(text_column, T.StringType()), *(T.StructField(f.name, T.LongType()) for f in length)], change, text_column)
