"""Operator 10: byte-level BPE, encoding and decoding, by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary's byte strings resolves a
pre-token that is itself in the vocabulary. Tier 2: for the others a heap of
mergeable neighbours over a doubly linked list of bytes, lowest rank first and
leftmost among equals, as the usual encoder merges.

Nulls count as empty text; an empty text has no ids. Repeated rows each give
their row. An empty table gives an empty result. Ids are exact for any text:
the hash's answers are compared with the key's bytes.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from xxhash import xxh64_intdigest

from .common import append, groups_by_size, small_batches, with_columns
from .pretokens import Memory, splitter

#: Bound of what is broadcast: a vocabulary file above it is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of pre-tokens and ids that a worker remembers in each of two generations.
REMEMBERED = 80 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines ``base64 rank``; the rank is the id."""
    data = open(path, "rb").read()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes, more than {MAX_VOCABULARY_BYTES}")
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()) if token)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots.

    Keys fall into small buckets by one half of a 64-bit hash. Buckets, largest
    first, get the first displacement that puts their keys into free slots.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        self.seed = 0
        while True:
            h = np.fromiter((xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
            if len(np.unique(h)) == len(keys) and self._place(h):
                return
            self.seed += 1

    def _place(self, h: np.ndarray) -> bool:
        shift = np.zeros(self.buckets, np.uint32)
        slots = np.full(self.n, -1, np.int64)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        for b in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            for first in range(0, 1 << 20, 256):  # 256 displacements at a time
                tried = np.arange(first, first + 256, dtype=np.uint64)
                at = np.sort(self._slot(h[own][None, :], tried[:, None]), axis=1)
                good = (slots[at] < 0).all(axis=1)
                if len(own) > 1:
                    good &= (at[:, 1:] != at[:, :-1]).all(axis=1)
                if good.any():
                    shift[b] = first + int(np.argmax(good))
                    slots[self._slot(h[own], shift[b : b + 1].astype(np.uint64))] = own
                    break
            else:
                return False
        self.shift, self.slots = shift, slots
        return True

    def _slot(self, h, shift):
        mixed = (h ^ (shift * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, asked: list[bytes]) -> np.ndarray:
        """For each string the only key's index that it can equal."""
        h = np.fromiter((xxh64_intdigest(k, self.seed) for k in asked), np.uint64, len(asked))
        shift = self.shift[(h >> np.uint64(32)) % np.uint64(self.buckets)].astype(np.uint64)
        return self.slots[self._slot(h, shift)]


class Codec:
    """Encodes and decodes; small enough to be broadcast (the vocabulary and its hash)."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)

    def ready(self) -> Codec:
        """Once in each worker: what need not be sent."""
        if not hasattr(self, "memory"):
            self.rank = {t: i for i, t in enumerate(self.tokens)}
            self.split = splitter(self.pattern)
            self.memory = Memory(REMEMBERED)
        return self

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "hash")}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is not in the vocabulary."""
        rank, n = self.rank, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue  # one of the two has been merged since
            merged = part[i] = left + part[j]
            part[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(merged + part[k])) is not None:
                    heappush(heap, (r, i, size + len(part[k])))
            if (p := before[i]) >= 0 and (r := rank.get(part[p] + merged)) is not None:
                heappush(heap, (r, p, size + len(part[p])))
        return [rank[x] for x in part if x is not None]

    def learn(self, asked: list[str]) -> None:
        """Remember the packed ids of pre-tokens: both tiers, in one pass."""
        raw = [p.encode() for p in asked]
        for piece, b, at in zip(asked, raw, self.hash.find(raw).tolist(), strict=True):
            ids = [at] if at >= 0 and self.tokens[at] == b else self.merge(b)
            self.memory.keep(piece, np.array(ids, "<u4").tobytes())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if unknown := self.memory.missing(set().union(*split)):
            self.learn(unknown)
        get = self.memory.young.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _batches(batch: pa.RecordBatch, column: str):
    texts = ["" if t is None else t for t in batch.column(column).to_pylist()]
    for part in groups_by_size([len(t) for t in texts]):
        yield batch.slice(part.start, part.stop - part.start), texts[part]


def encode(docs: DataFrame, model: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``, binary: little-endian unsigned 32-bit ids of the whole text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value.ready()
        for whole in batches:
            for batch, texts in _batches(whole, text):
                yield append(batch, {ids: pa.array(own.encode_batch(texts), pa.binary())})

    return docs.mapInArrow(run, with_columns(docs.schema, **{ids: T.BinaryType()}))


def decode(rows: DataFrame, model: Codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``out``, the bytes that the ids stand for (null ids: none)."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value.ready()
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            yield append(batch, {out: pa.array(found, pa.binary())})

    return rows.mapInArrow(run, with_columns(rows.schema, **{out: T.BinaryType()}))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, model: Codec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids; of both only digests leave the worker, so that no ids are moved."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key_field = docs.schema[key]

    def run(batches):
        own = sent.value.ready()
        for whole in batches:
            for batch, texts in _batches(whole, text):
                packed = own.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                        pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType([key_field, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(key, text).mapInArrow(run, schema)
