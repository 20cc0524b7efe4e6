"""Operator 4: personal data.

Regular expressions propose spans; validators (ranges, digit counts, Luhn,
mod 97) confirm them; words near a span adjust its score. The four base kinds
are kept whatever the score, further kinds only from a score on.

Spans count code points, ends exclusive; matches of one kind do not overlap.
A match that fails its check is dropped and the search goes on behind it. Null
text counts as empty: no spans. Repeated rows get equal results. Texts are
searched whole, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import append, small_batches, with_columns

#: The base patterns.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: From the beginning of a run of digits only: where that fails, its other digits would too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Proposed beyond the base kinds.
IBAN = re.compile(r"[A-Z][A-Z][0-9][0-9](?<![A-Za-z0-9]....)")
#: How long a country's numbers are; others are tried at each end of a word, the longest first.
LENGTHS = {c[:2]: int(c[2:]) for c in "AL28 AD24 AT20 AZ28 BH22 BY28 BE16 BA20 BR29 BG22 BI27 CR22 HR21 CY28 CZ24 DK18 DJ27 DO28 EG29 SV28 EE20 FK18 FO18 FI18 FR27 GE22 DE22 GI23 GR27 GL18 GT28 VA22 HN28 HU28 IS26 IQ23 IE22 IL23 IT27 JO30 KZ20 XK20 KW30 LV21 LB28 LY25 LI21 LT20 LU20 MT31 MR27 MU30 MC27 MD24 MN20 ME22 NL18 NI28 MK19 NO15 OM23 PK24 PS29 PL28 PT25 QA29 RO24 RU33 LC32 SM27 ST25 SA24 RS22 SC31 SK24 SI19 SO23 ES24 SD18 SE24 CH21 TN24 TR26 TL23 UA29 AE23 GB22 VG24 YE30".split()}
BODY = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*LENGTHS.values()}}
ANY_BODY = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9][0-9][0-9]-(?<![0-9-]....)(?<!000-)(?<!666-)(?<!9..-)(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words that speak for a kind when they stand near.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Score of a confirmed proposal, and what a word within ``NEAR`` characters adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR, BOOST, LEAST = 40, 0.3, 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of an IBAN: country and check digits go to the end, letters count from 10, the rest by 97 is 1."""
    moved = iban[4:] + iban[:4]
    rest = 0
    for c in moved:
        rest = (rest * 100 + ord(c) - 55 if c.isalpha() else rest * 10 + ord(c) - 48) % 97
    return rest == 1


def _emails(text: str):
    """Matches of EMAIL, found from their @: a run of local characters before it, from its beginning or the last match's end."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _card(s: str) -> bool:
    return 13 <= len(d := _digits(s)) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _iban(s: str) -> bool:
    return 15 <= len(s := s.replace(" ", "")) <= 34 and mod97(s)


def _ibans(text: str):
    """(start, end) of confirmed numbers; upper-case words behind a number don't belong to it."""
    end = 0
    for m in IBAN.finditer(text):
        if m.start() < end:
            continue
        if n := LENGTHS.get(m[0][:2]):
            ends = [b.end()] if (b := BODY[n].match(text, m.end())) else []
        else:
            b = ANY_BODY.match(text, m.end())
            ends = [e for e in range(b.end(), m.end(), -1) if text[e - 1] != " " and not re.match("[A-Za-z0-9]", text[e : e + 1])] if b else []
        for e in ends:
            if _iban(text[m.start() : e]):
                yield m.start(), e
                end = e
                break


def proposals(text: str):
    """Confirmed (kind, start, end), by kind as listed, then by start."""
    if "@" in text:
        yield from (("email", m.start(), m.end()) for m in _emails(text))
    for kind, pattern, confirm in (("ip", IP, _ip), ("card", CARD, _card), ("phone", PHONE, _phone)):
        for m in pattern.finditer(text):
            if confirm(m[0]):
                yield kind, m.start(), m.end()
    yield from (("iban", *span) for span in _ibans(text))
    yield from (("ssn", m.start(), m.end()) for m in SSN.finditer(text))


def scan(text: str | None) -> list[Span]:
    """All spans of a text by kind, then start."""
    found = []
    for kind, start, end in proposals(text or ""):
        near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
        score = min(1.0, PRIOR[kind] + BOOST * any(w in near for w in CONTEXT[kind]))
        if kind in BASE or score >= LEAST:
            found.append(Span(kind, start, end, score))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each run of overlapping spans replaced by the name of the one that begins it."""
    if not spans:
        return text
    parts, end = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= end:
            parts += [text[end : s.start], f"[{s.kind.upper()}]"]
        end = max(end, s.end)
    return "".join(parts) + text[end:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``pii``, the spans with their scores."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [[s.__dict__ for s in scan(t)] for t in batch.column(text).to_pylist()]
            yield append(batch, {"pii": pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))})

    return docs.mapInArrow(run, with_columns(docs.schema, pii=SPANS))


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The columns of ``docs`` with spans replaced in the text, and ``chars``, where there is such a column, counted anew."""
    schema = docs.schema
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            new = [redacted(t, scan(t)) for t in texts]
            at = batch.schema.get_field_index(text)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if (c := batch.schema.get_field_index(chars)) >= 0:
                old = batch.column(c).to_pylist()
                counts = [o if a == b or b is None else len(b) for a, b, o in zip(texts, new, old, strict=True)]
                batch = batch.set_column(c, batch.schema.field(c), pa.array(counts, batch.schema.field(c).type))
            yield batch

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of their spans, and all spans."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(text).to_pylist()]
            base = [[s for s in spans if s.kind in BASE] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            hashes = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), *counts, hashes, pa.array([joined(s) for s in found], pa.string())], names=[key, *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    fields = [docs.schema[key], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
