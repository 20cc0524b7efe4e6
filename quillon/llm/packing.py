"""Operator 7: packing token sequences by cutting-stock column generation.

1. Every document is tokenized once; each full stretch of ``capacity`` ids is a
   sequence of its own, so what is left to pack is one remainder a document,
   shorter than ``capacity``.
2. The histogram of remainder lengths (below ``capacity`` rows, whatever the
   corpus) goes to the driver. A linear program over patterns, multisets of
   lengths that fit one sequence, covers it: columns are generated by a knapsack
   dynamic program on the master's dual prices.
3. Patterns are rounded down, then up where the rest allows it; what remains
   goes best-fit into further sequences. The result is a table of slots: for a
   length, ranks from..to go to sequences from..on, at an offset.
4. Where lengths do not match well (one of them may be that of a third of all
   rows), sequences keep gaps. The emptiest sequences are then dissolved: their
   documents follow each other in one stream that is cut at the gaps of the others.
5. Documents are ranked among those of their length and take the slot of their
   rank. Lengths that many documents share are ranked in salted parts, so no
   task holds all documents of one length.

Padding: a sequence is filled up to ``capacity`` unless its length is a power
of two. Null text counts as empty (one id, the end mark). Repeated rows are
documents of their own, null ids included. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import groups_by_size, materialize, small_batches
from .pretokens import Memory, splitter

#: Rows of one length that are ranked in one part.
RANKED_TOGETHER = 1_000
#: Bytes of pre-tokens and ids that a worker remembers in each of two generations.
REMEMBERED = 80 << 20
#: Gaps below it are padded: cutting a document for them would leave crumbs.
LEAST_GAP = 16
MAX_TOKENIZER_BYTES = 64 << 20
#: Above all numbers of packed sequences: full stretches are numbered from here, by task.
FULL = 1 << 61


@dataclass
class Tokenizer:
    """Ids of texts by a byte-level ``tokenizers`` file whose pre-tokens are those of ``pattern``, as the library gives them without special tokens around a text: an added token's name in a text is that token."""

    definition: str
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Tokenizer:
        data = open(path, encoding="utf-8").read()
        if len(data) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
        _added(data)  # what is not supported is refused here, not in a task
        return cls(data, pattern)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids. The library's model never merges across pre-tokens, so it is asked once for each distinct one."""
        model, letters, added, names, memory = _loaded(self.definition)
        plain = splitter(self.pattern)

        def pieces(text: str) -> list:
            if names is None or names.search(text) is None:
                return plain(text)
            parts = names.split(text)  # what stands between names, and the names
            return [x for i, part in enumerate(parts) for x in ([added[part]] if i % 2 else plain(part))]

        split = [pieces(t) for t in texts]
        for p in memory.missing(set().union(*split)):
            if isinstance(p, int):
                ids = [p]
            else:
                written = p.replace(" ", letters[32]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters)
                ids = [t.id for t in model.tokenize(written)]
            memory.keep(p, struct.pack(f"<{len(ids)}I", *ids))
        get = memory.young.__getitem__
        return [b"".join(map(get, s)) for s in split]


def _added(definition: str) -> dict[str, int]:
    """Names of added tokens and their ids. ValueError for kinds that would depend on what stands around them."""
    found = json.loads(definition)
    tokens = found.get("added_tokens") or []
    if found.get("normalizer") is not None or any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("tokenizers with a normalizer, or with added tokens that strip or need word ends, are not supported")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


@lru_cache(maxsize=1)
def _loaded(definition: str):
    """Once in each worker: the library's model, the letter that its vocabulary has for each byte, added tokens and what finds them (the longest name first), and the ids of pre-tokens seen lately.

    A byte-level vocabulary writes printable bytes as themselves and the others as the letters from U+0100 on.
    """
    import tokenizers

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    added = _added(definition)
    names = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    return tokenizers.Tokenizer.from_str(definition).model, {b: chr(256 + i) for i, b in enumerate(others)}, added, names, Memory(REMEMBERED)


def stretches(docs: DataFrame, tokenizer: Tokenizer, capacity: int, end: int, key: str, text: str) -> DataFrame:
    """A row for each document: its ids counted, the CRC-32 of every stretch of ``capacity`` ids, the last one shorter, and that one's ids."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    mark, step = np.array([end], "<u4").tobytes(), 4 * capacity
    key_field = docs.schema[key]

    def run(batches):
        own, task = sent.value, TaskContext.get().partitionId()
        rows = full = 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            for part in groups_by_size([len(t) for t in texts]):
                packed = [ids + mark for ids in own.encode(texts[part])]
                counts = [len(ids) // 4 for ids in packed]
                firsts = []
                for n in counts:
                    firsts.append((task << 40) + full)
                    full += n // capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).slice(part.start, part.stop - part.start),
                        pa.array(range((task << 40) + rows, (task << 40) + rows + len(packed)), pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(firsts, pa.int64()),
                        pa.array([[zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)] for ids in packed], pa.list_(pa.int64())),
                        pa.array([ids[len(ids) // step * step :] for ids in packed], pa.binary()),
                    ],
                    names=[key, "row", "doc_tokens", "first_full", "crcs", "tail"],
                )
                rows += len(packed)

    schema = T.StructType([key_field, *(T.StructField(n, T.LongType()) for n in ("row", "doc_tokens", "first_full")), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType())])
    return docs.select(key, text).mapInArrow(run, schema)


def _priced(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of lengths that fits. ``value[l]`` is the price of length ``l`` (0: not asked for)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, len(value) - 1)
        total = best[c - 1 :: -1][:n] + value[1 : n + 1] if c > n else best[c - 1 :: -1] + value[1 : c + 1]
        i = int(np.argmax(total))
        if total[i] > best[c - 1]:
            best[c], last[c] = total[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(value)), capacity
    while c > 0:
        if last[c]:
            counts[last[c]] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def _start(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its values. Each pattern takes the longest length that is left, fills up with what
    is left, longest first, and is used until one of its lengths runs out; that one is in no later pattern, so
    the basis is triangular but for the order of its columns."""
    m = len(lengths)
    basis, x, left = np.zeros((m, m)), np.zeros(m), demand.astype(float).copy()
    alive = np.ones(m, bool)
    for j in range(m):
        if not (left > 0).any():  # these ran out together with another one
            out = int(np.argmax(alive))
            basis[out, j], alive[out] = capacity // lengths[out], False
            continue
        column, room, i = basis[:, j], capacity, 0
        while room > 0:
            i = max(i, int(np.searchsorted(-lengths, -room)))
            there = np.flatnonzero(left[i:] > 0)
            if not len(there):
                break
            i += int(there[0])
            column[i] = max(1, min(room // lengths[i], np.floor(left[i])))
            room -= column[i] * lengths[i]
            i += 1
        own = np.flatnonzero(column)
        uses = left[own] / column[own]
        out = own[int(np.argmin(uses))]
        x[j] = uses.min()
        left[own] = np.maximum(left[own] - x[j] * column[own], 0)
        left[out], alive[out] = 0, False
    return basis, x


def linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, from the revised simplex with generated columns.

    Ends when the value is within ``gap`` of the bound that the prices prove, or
    after ``most`` columns; it is feasible at any time, so an early end costs
    padding, not correctness.
    """
    basis, x = _start(lengths, demand, capacity)
    inverse = np.linalg.inv(basis)
    y = inverse.sum(axis=0)  # every pattern costs one sequence
    least = (lengths * demand).sum() / capacity
    price = np.zeros(capacity + 1)
    for _ in range(most):
        price[:] = 0
        price[lengths] = np.maximum(y, 0)
        total = x.sum()
        if total - least <= gap * total:
            break
        worth, counts = _priced(price[: lengths.max() + 1], capacity)
        least = max(least, float((price[lengths] * demand).sum()) / max(worth, 1e-12))
        if worth <= 1 + 1e-9 or total - least <= gap * total:
            break
        column = counts[lengths]
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(len(x), np.inf)
        ratio[up] = x[up] / way[up]
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        y = y + (1 - way.sum()) * row
        rows, cols = np.flatnonzero(np.abs(way) > 1e-12), np.flatnonzero(np.abs(row) > 1e-12)
        inverse[np.ix_(rows, cols)] -= np.outer(way[rows], row[cols])
        inverse[out] = row
        basis[:, out] = column
    return basis, x


@dataclass
class Plan:
    """Where remainders go.

    A slot (length, a, b, each, seq, off, fill): the documents of that length
    with ranks a <= r < b, ``each`` of them to a copy of the pattern. Copy c has
    them at ``off`` in sequence ``seq`` + c; with seq < 0 the copy is dissolved
    and they stand in the stream at ``off`` + c * ``fill``.
    A gap (seq, count, off, room): ``room`` free places from ``off`` on in each of
    the ``count`` sequences from ``seq`` on. The stream runs through the gaps in turn.
    """

    slots: list[tuple[int, ...]]
    gaps: list[tuple[int, int, int, int]]
    sequences: int


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """From the number of remainders of each length; lengths from 1 to ``capacity`` - 1."""
    if not histogram:
        return Plan([], [], 0)
    lengths = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[int(n)] for n in lengths], np.int64)
    patterns, x = linear_program(lengths, demand, capacity)
    rest, used = demand.copy(), []
    for up in (0, 1):  # rounded down, then the largest fractions once more where they still fit the rest
        for j in np.argsort(-(x - np.floor(x)), kind="stable"):
            p = np.rint(patterns[:, j]).astype(np.int64)
            wanted = int(x[j] + 1e-9) if not up else int(x[j] - np.floor(x[j]) > 1e-6)
            own = p > 0
            copies = min(wanted, int((rest[own] // p[own]).min())) if own.any() else 0
            if copies:
                rest -= copies * p
                used.append((copies, [(i, int(p[i])) for i in np.flatnonzero(own)]))
    used += _best_fit(lengths, rest, capacity)

    full = [sum(each * int(lengths[i]) for i, each in items) for _, items in used]
    gap = [0 if capacity - n < LEAST_GAP or n & (n - 1) == 0 else capacity - n for n in full]
    dissolve = sum(g * copies for g, (copies, _) in zip(gap, used, strict=True)) // capacity
    taken, slots, gaps, sequences, stream = [0] * len(lengths), [], [], 0, 0
    for k in sorted(range(len(used)), key=lambda k: (-gap[k], k)):
        copies, items = used[k]
        gone = min(dissolve, copies) if gap[k] else 0
        dissolve -= gone
        for n, seq, first in ((gone, -1, stream), (copies - gone, sequences, 0)):
            off = first
            for i, each in items if n else ():
                slots.append((int(lengths[i]), taken[i], taken[i] + n * each, each, seq, off, full[k]))
                taken[i] += n * each
                off += each * int(lengths[i])
        stream += gone * full[k]
        if gap[k] and copies > gone:
            gaps.append((sequences, copies - gone, full[k], gap[k]))
        sequences += copies - gone
    return Plan(slots, gaps, sequences)


def _best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, of what rounding left: runs of equal sequences are filled together."""
    room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for i, (n, left) in enumerate(zip(lengths.tolist(), rest.tolist(), strict=True)):
        while left:
            free = min((r for r in room if r >= n), default=None)
            copies, items = (room[free].pop()) if free is not None else (left, ())
            if free is not None and not room[free]:
                del room[free]
            free = capacity if free is None else free
            each = max(1, min(left, free // n)) if not items else 1
            used = min(copies, left // each)
            if items and copies > used:
                room.setdefault(free, []).append((copies - used, items))
            left -= used * each
            room.setdefault(free - each * n, []).append((used, items + ((i, each),)))
    return [(copies, list(items)) for found in room.values() for copies, items in found if items]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(rows: DataFrame, gaps: list[tuple[int, int, int, int]], key: str) -> DataFrame:
    """Pieces of documents in the stream. rows: key, start, doc_tokens, ``place`` in the stream, ``tail`` with the ids."""
    seq, count, off, room = (np.array(c, np.int64) for c in zip(*gaps, strict=True))
    ends = np.cumsum(count * room)
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(PIECE).fields])

    def run(batches):
        for batch in batches:
            found = []
            for k, (start, total, place, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "doc_tokens", "place", "tail")), strict=True)):
                at, n = 0, len(tail) // 4
                while at < n:
                    g = int(np.searchsorted(ends, place + at, side="right"))
                    into = place + at - int(ends[g] - count[g] * room[g])
                    copy, inside = divmod(into, int(room[g]))
                    most = min(n - at, int(room[g]) - inside)
                    found.append((k, start + at, most, zlib.crc32(tail[4 * at : 4 * (at + most)]), total, int(seq[g]) + copy, int(off[g]) + inside))
                    at += most
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

    return rows.select(key, "start", "doc_tokens", "place", "tail").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: Tokenizer, capacity: int = 1024, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(stretches(docs, tokenizer, capacity, end, key, text), "stretches")
    rest = (F.col("doc_tokens") % capacity).cast("int")
    histogram = {r["rest"]: r["n"] for r in rows.groupBy(rest.alias("rest")).agg(F.count("*").alias("n")).where("rest > 0").collect()}  # below capacity rows
    found = plan(histogram, capacity)

    start = F.col("at").cast("long") * capacity
    full = rows.where(F.col("doc_tokens") >= capacity).select(key, "doc_tokens", "first_full", F.posexplode("crcs").alias("at", "ids_crc32")).where(start + capacity <= F.col("doc_tokens"))
    full = full.select(key, start.alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(FULL) + F.col("first_full") + F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not histogram:
        return full

    # Bounded: an entry for each length that more than RANKED_TOGETHER documents share.
    parts = {n: -(-count // RANKED_TOGETHER) for n, count in histogram.items() if count > RANKED_TOGETHER}
    of = F.coalesce(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))[F.col("rest")], F.lit(1)) if parts else F.lit(1)
    short = rows.select(key, "doc_tokens", rest.alias("rest"), "row", F.element_at("crcs", -1).alias("ids_crc32")).where("rest > 0").withColumn("part", F.pmod(F.xxhash64("row"), of))
    short = short.withColumn("rank", (F.row_number().over(Window.partitionBy("rest", "part").orderBy("row")) - 1).cast("long"))
    if parts:
        before = short.groupBy("rest", "part").agg(F.count("*").alias("n"))
        before = before.select("rest", "part", (F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).alias("before"))
        short = short.join(before, ["rest", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    # Bounded by the histogram, not by the corpus: a few slots for each length.
    of_length: dict[int, list] = {}
    for n, *slot in found.slots:
        of_length.setdefault(n, []).append(tuple(slot))
    places = spark.createDataFrame(list(of_length.items()), "rest int, slots array<struct<a: long, b: long, each: long, seq: long, off: long, fill: long>>")
    short = short.join(F.broadcast(places), "rest").withColumn("slot", F.expr("filter(slots, s -> rank >= s.a and rank < s.b)[0]"))
    copy, nth = F.floor((F.col("rank") - F.col("slot.a")) / F.col("slot.each")), (F.col("rank") - F.col("slot.a")) % F.col("slot.each")
    short = short.select(key, "row", (F.col("doc_tokens") - F.col("rest")).alias("start"), "rest", "ids_crc32", "doc_tokens", F.col("slot.seq").alias("seq"), copy.alias("copy"), (F.col("slot.off") + F.col("rest") * nth).alias("off"), F.col("slot.fill").alias("fill"))
    whole = short.where("seq >= 0").select(key, "start", F.col("rest").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("seq") + F.col("copy")).alias("sequence_id"), F.col("off").alias("offset"))
    out = full.unionByName(whole)
    dissolved = sorted({n for n, _, _, _, seq, _, _ in found.slots if seq < 0})
    if dissolved:
        stream = short.where(F.col("rest").isin(dissolved) & (F.col("seq") < 0)).select(key, "row", "start", "doc_tokens", (F.col("off") + F.col("copy") * F.col("fill")).alias("place"))
        tails = rows.where(rest.isin(dissolved)).select("row", "tail")
        out = out.unionByName(cut(stream.join(tails, "row"), found.gaps, key))
    return out
