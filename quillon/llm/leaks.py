"""Operator 5: secret scans.

Base patterns run over the text; then a worklist of layers: percent escapes,
Unicode escapes, base64, and zlib or gzip data inside base64 are unwrapped,
and each new layer is searched by the same patterns and unwrapped in turn until
no layer is new. Escapes are unwrapped in place, so that what stands around
them is part of the layer. Base64 is read from lines and over wrapped lines,
as a whole or, where other characters are joined to it, from each alignment. A layer
that was seen before at its place in the text (by its hash) is not opened again, nor is compressed
data that holds itself, so cycles end; all other layers are shorter than what they come from. What is found inside a layer is mapped to the span of the outermost
encoded run in the text.

Spans count code points, ends exclusive. Found inside a layer, a span's kind
tells the way, e.g. ``base64/assign``. Null text counts as empty: no spans.
Repeated rows get equal results. Texts are searched whole, and so are layers,
whatever their depth and size: compressed data (all gzip members) is unpacked in a
stream and searched in windows that end at a space, so what a worker holds is a
window and the longest run without a space.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import append, small_batches, with_columns

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f][0-9a-f]{23,}")
#: The words that ASSIGN begins with.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")
#: Encoded runs.
#: An escaped percent sign before an escape, %2577, however often: unwrapped at once, as a chain of them would be a layer each.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
#: 16 characters hold the shortest base match, token=abcdef; wrapped lines end in a shorter one.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)?={0,2}")
#: Where compressed data may begin behind a path.
PACKED = re.compile(r"(?<=[/_+-])(?:H4sI|e[AFJN])")
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: Bytes that are unpacked at once, and characters that stay from a window to the next: more than a base match needs before its value.
CHUNK, OVERLAP = 1 << 20, 64


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def matches(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(n in low for n in NAMES):
            found += [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [Span("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(s: Span):
    return s.start, KINDS.index(s.kind.rpartition("/")[2]), s.end, s.kind


def _readable(data: bytes) -> str | None:
    """Decoded data as text, if it is text."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    plain = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if text and plain >= 0.95 * len(text) else None


def _is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0)


def _inflated(chunks):
    """zlib or gzip data in chunks, all members; ends where the data does, or is broken."""
    chunks = iter(chunks)
    inflater, rest = zlib.decompressobj(47), b""
    while True:
        if not rest and not (rest := next(chunks, b"")):
            return
        try:
            out = inflater.decompress(rest, CHUNK)
        except zlib.error:
            return
        if out:
            yield out
        rest = inflater.unconsumed_tail
        if not inflater.eof:
            while not rest and out:  # what the inflater still holds
                try:
                    out = inflater.decompress(b"", CHUNK)
                except zlib.error:
                    return
                if out:
                    yield out
            if not inflater.eof:
                continue
        rest = inflater.unused_data
        while len(rest.lstrip(b"\0")) < 3 and (more := next(chunks, b"")):
            rest += more
        rest = rest.lstrip(b"\0")
        if not _is_packed(rest):
            return
        inflater = zlib.decompressobj(47)


def _in_parts(bare: str, start: int, end: int):
    """Decoded base64 in parts that grow, so that what turns out to be no packed data costs little."""
    size = 256
    while start < end:
        if (data := _decoded(bare[start : min(start + size, end)])) is None:
            return
        yield data
        start, size = start + size, min(4 * size, CHUNK)


def _level(data, n: int):
    """The chunks of data, bytes or a function that gives them in parts, that is unpacked n times."""
    chunks = data() if callable(data) else iter((data,))
    for _ in range(n):
        chunks = _inflated(chunks)
    return chunks


def _unpacked(data):
    """(n, text windows) of data that is packed n times; nothing if it is not packed, holds no text, or holds itself."""
    n, seen, head = 0, set(), next(_level(data, 0), b"")[:3]
    while _is_packed(head):
        head = b""
        for chunk in _level(data, n + 1):
            head += chunk[:3]
            if len(head) > 2:
                break
        if not head:  # it only looked packed
            break
        mark = hashlib.blake2b(digest_size=12)
        for chunk in _level(data, n):
            mark.update(chunk)
        if mark.digest() in seen:
            return None
        seen.add(mark.digest())
        n += 1
    if not n or not _is_text(_level(data, n)):
        return None
    return n, _windows(_level(data, n))


def _is_text(chunks) -> bool:
    """As _readable, of a stream; a character that the end cuts off does not count."""
    decoder, plain, total = codecs.getincrementaldecoder("utf-8")(), 0, 0
    try:
        for chunk in chunks:
            text = decoder.decode(chunk)
            total += len(text)
            plain += len(text) if text.isprintable() else sum(n for c, n in Counter(text).items() if c.isprintable() or c in "\t\n\r")
    except UnicodeDecodeError:
        return False
    return total > 0 and plain >= 0.95 * total


def _windows(chunks):
    """Texts of a stream that together hold each base match and each encoded run as a whole: they end behind a space, the next begins OVERLAP before. Spaces in a row, of which base patterns allow any number, are one."""
    decoder, parts = codecs.getincrementaldecoder("utf-8")(), []
    for chunk in chunks:
        text = decoder.decode(chunk)
        if parts and parts[-1].endswith(" "):
            text = text.lstrip(" ")
        text = re.sub("\x20{2,}", " ", text)
        cut = text.rfind(" ") + 1
        if not cut:
            parts += [text] * bool(text)
            continue
        window = "".join(parts) + text[:cut]
        yield window
        parts = [window[-OVERLAP:], text[cut:]] if text[cut:] else [window[-OVERLAP:]]
    if parts:
        yield "".join(parts)


def _in_place(text: str, runs: re.Pattern, decode):
    """The text with decoded runs in place, and each piece of it as (start inside, end inside, start, end, whether it was decoded)."""
    parts, pieces, at, new = [], [], 0, 0
    for m in runs.finditer(text):
        inner = decode(m[0])
        for piece, start, end, decoded in ((text[at : m.start()], at, m.start(), False), (inner, m.start(), m.end(), True)):
            if piece:
                parts.append(piece)
                pieces.append((new, new + len(piece), start, end, decoded))
                new += len(piece)
        at = m.end()
    if at < len(text):
        parts.append(text[at:])
        pieces.append((new, new + len(text) - at, at, len(text), False))
    return "".join(parts), pieces


def _percent(run: str) -> str:
    return unquote_to_bytes(re.sub("%(?:25)+(?=[0-9A-Fa-f]{2})", "%", run)).decode("utf-8", "replace")


def _unicode(run: str) -> str:
    return re.sub(r"\\u([0-9A-Fa-f]{4})", lambda x: chr(int(x[1], 16)), run).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Map:
    """Spans of a layer in the text: one span for all, or pieces that lie side by side."""

    def __init__(self, pieces=None, place=None, outer=None):
        self.pieces, self.place, self.outer = pieces, place, outer
        self.starts = [p[0] for p in pieces] if pieces else []

    def span(self, start: int, end: int) -> tuple[int, int]:
        level = self
        while level:
            if level.place:
                return level.place
            if level.pieces:
                a, b = (level.pieces[bisect_right(level.starts, x) - 1] for x in (start, max(start, end - 1)))
                start, end = a[2] if a[4] else a[2] + start - a[0], b[3] if b[4] else b[2] + end - b[0]
            level = level.outer
        return start, end

    def touches(self, start: int, end: int) -> bool:
        """Whether a span has decoded characters, here: what has none was found before."""
        if not self.pieces:
            return True
        k = bisect_right(self.starts, start) - 1
        return any(p[4] for p in self.pieces[k : bisect_right(self.starts, end - 1)])


def _decoded(bare: str) -> bytes | None:
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4))
    except (binascii.Error, ValueError):
        return None


def _contents(run: str):
    """(way, inner text) of a run of base64: as a whole, else what can be read from any alignment and behind a path."""
    bare = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 != 1 and (data := _decoded(bare)) is not None:
        if unpacked := _unpacked(data):  # compressed data may hold compressed data
            for inner in unpacked[1]:
                yield "base64" + "/zip" * unpacked[0], inner
            return
        if inner := _readable(data):
            yield "base64", inner
            return
    for k in range(4):
        if data := _decoded(bare[k:][: (len(bare) - k) // 4 * 4]):
            for m in PRINTABLE.finditer(data):
                yield "base64", m[0].decode()
    for m in PACKED.finditer(bare):
        start, end = m.start(), len(bare) - ((len(bare) - m.start()) % 4 == 1)
        if unpacked := _unpacked(lambda: _in_parts(bare, start, end)):  # noqa: B023  used before the next one
            for inner in unpacked[1]:
                yield "base64" + "/zip" * unpacked[0], inner


def _opened(text: str, outer: Map):
    """(way, map, inner text) of the text with its escapes in place, and of each run of base64."""
    for step, mark, runs, decode in (("url", "%", PERCENT, _percent), ("unicode", "\\u", ESCAPED, _unicode)):
        if mark in text:
            inner, pieces = _in_place(text, runs, decode)
            if any(p[4] for p in pieces):
                yield step, Map(pieces=pieces, outer=outer), inner
    for m in BASE64.finditer(text):
        if outer.touches(m.start(), m.end()):
            for way, inner in _contents(m[0]):
                yield way, Map(place=outer.span(m.start(), m.end())), inner
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            if "\n" in m[0] and outer.touches(m.start(), m.end()):
                lines = m[0].count("\n")
                for run in (m[0], m[0][: m[0].rindex("\n")])[: 2 if lines > 1 else 1]:  # the last line may be a word of the text
                    for way, inner in _contents(run):
                        yield way, Map(place=outer.span(m.start(), m.start() + len(run.rstrip()))), inner


def scan(text: str | None) -> list[Span]:
    """Base spans and those found in layers, by start, then kind."""
    text = text or ""
    found = matches(text)
    seen = set()
    inside = set()
    work = [(_opened(text, Map()), "")]  # depth first, so that one window of each layer is held
    while work:
        opened, way = work[-1]
        if (run := next(opened, None)) is None:
            work.pop()
            continue
        step, place, inner = run
        if (mark := hashlib.blake2b(inner.encode("utf-8", "replace"), digest_size=12).digest() + f"{place.span(0, len(inner))}".encode()) in seen:
            continue
        seen.add(mark)
        inside.update(Span(f"{way}{step}/{s.kind}", *place.span(s.start, s.end)) for s in matches(inner) if place.touches(s.start, s.end))
        work.append((_opened(inner, place), f"{way}{step}/"))
    return sorted([*found, *inside], key=_order) if inside else found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secrets``, the spans."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [[s.__dict__ for s in scan(t)] for t in batch.column(text).to_pylist()]
            yield append(batch, {"secrets": pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))})

    return docs.mapInArrow(run, with_columns(docs.schema, secrets=SPANS))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, the digest of their spans, and all spans."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column(text).to_pylist()]
            base = [[s for s in spans if "/" not in s.kind] for spans in found]
            counts = [pa.array([sum(s.kind == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
            hashes = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), *counts, hashes, pa.array([joined(s) for s in found], pa.string())], names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    fields = [docs.schema[key], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))
