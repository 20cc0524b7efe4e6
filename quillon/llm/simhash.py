"""Operator 6: SimHash near-duplicates by vantage-point trees.

1. Fingerprints: words of the A-Z lower-cased text, three-word shingles, the
   majority of each bit of their XXH64. Written once to the shared folder.
2. Documents with equal fingerprints collapse into one class before anything is
   compared, so a group of exact copies costs one point.
3. A vantage-point tree over a bounded sample of distinct fingerprints deals all
   of them to shards by Hamming distance. A point within the radius of a boundary
   also visits the shard beyond it (from the inner side only: one visit a pair is
   enough), which makes the pairs exact.
4. Each shard goes on with trees of its own: branches that the triangle bound
   excludes are pruned, small leaves are compared in blocks. What leaves a shard
   is a spanning forest of its links, at most one row a point, never all pairs.
5. Components of the forests, distributed.

Null or empty text, or text without a word: fingerprint zero, linked like any
other. Repeated rows share a fingerprint and a component. A null key never
names a component; rows linked with null keys only have a null component. Very
long texts are hashed in slices. An empty table gives an empty result. A shard task
holds the distinct fingerprints of its shard and its visitors, about 30 bytes
each. Shards are planned for ``SHARD_POINTS``; as the sample that plans them ends
at ``MAX_SAMPLE`` points, shards grow beyond that from about 1.6 billion distinct
fingerprints on. Points too close to be parted stay together, but there are at
most 43,745 fingerprints within the radius of one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh64_intdigest

from .common import append, fresh, hash_part, join_hot, materialize, small_batches, with_columns
from .components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
#: Points that a shard is planned for; the sample that plans the shards, 32 points for each, and its bounds.
SHARD_POINTS, SAMPLE, MAX_SAMPLE = 50_000, 4_096, 1 << 20
LEAF = 256


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    total, left = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    n = left
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    while left:
        size = min(left, SHINGLES_AT_ONCE)
        h = np.fromiter(islice(hashes, size), np.uint64, size)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
        left -= size
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(text).to_pylist()], np.uint64)
            yield append(batch, {out: pa.array(found.view(np.int64))})

    return docs.mapInArrow(run, with_columns(docs.schema, **{out: T.LongType()}))


def distances(x: np.ndarray, y: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the largest distance of the inner side, the most even of a few; nothing if none parts the points."""
    best = None
    for at in {0, len(points) // 2, len(points) - 1}:
        counts = np.bincount(distances(points, points[at]), minlength=65).cumsum()
        split = int(np.searchsorted(counts, (len(points) + 1) // 2))
        for m in (split, split - 1):
            if 0 <= m < 64 and 0 < counts[m] < len(points):
                worse = abs(2 * int(counts[m]) - len(points))
                if best is None or worse < best[0]:
                    best = (worse, points[at], m)
    return best and best[1:]


@dataclass
class Node:
    """Inner side: within ``most`` of ``point``. A leaf has a shard's number."""

    point: np.uint64 = np.uint64(0)
    most: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def shard_tree(points: np.ndarray, shards: int) -> Node:
    """A tree over a sample that deals points to about ``shards`` shards of equal size."""
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray, shards: int) -> Node:
        found = vantage(points) if shards > 1 and len(points) > 8 else None
        if found is None:
            return Node(shard=next(numbers))
        near = distances(points, found[0]) <= found[1]
        return Node(found[0], found[1], grow(points[near], -(-shards // 2)), grow(points[~near], -(-shards // 2)))

    return grow(np.unique(points), shards)


def deal(points: np.ndarray, tree: Node, radius: int = RADIUS):
    """(shard, indices, whether they are members): each point is a member of one shard, and visits those where it may have a partner that does not visit it."""
    work = [(tree, np.arange(len(points)), np.zeros(0, np.int64))]
    while work:
        node, members, visitors = work.pop()
        if node.shard >= 0:
            for at, own in ((members, True), (visitors, False)):
                if len(at):
                    yield node.shard, at, own
            continue
        d, v = distances(points[members], node.point), distances(points[visitors], node.point).astype(np.int64)
        work.append((node.inner, members[d <= node.most], visitors[v - radius <= node.most]))
        over = (d <= node.most) & (d.astype(np.int64) + radius > node.most)
        work.append((node.outer, members[d > node.most], np.concatenate([visitors[v + radius > node.most], members[over]])))


class Forest:
    """Union-find over the points of one shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        n, up = len(self.up), self.flat() if len(a) > 1000 else self.up
        a, b = up[a], up[b]
        apart = a != b
        for x, y in zip(*(k.tolist() for k in np.divmod(np.unique(a[apart] * n + b[apart]), n)), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def flat(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def link_shard(points: np.ndarray, own: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each point the first point of its component, by links of members with members and visitors."""
    forest = Forest(len(points))
    work = [(np.flatnonzero(own), np.flatnonzero(~own))]
    while work:
        members, visitors = work.pop()
        if not len(members):
            continue
        found = vantage(points[members]) if len(members) > LEAF else None
        if found is None:
            asking = np.concatenate([members, visitors])
            for start in range(0, len(asking), 512):  # blocks bound the memory, however close the points are
                part = asking[start : start + 512]
                for first in range(0, len(members), 2048):
                    block = members[first : first + 2048]
                    i, j = np.nonzero(distances(points[part][:, None], points[block][None, :]) <= radius)
                    i, j = part[i], block[j]
                    apart = i != j
                    forest.link(i[apart], j[apart])
            continue
        point, most = found
        d, v = distances(points[members], point).astype(np.int64), distances(points[visitors], point).astype(np.int64)
        work.append((members[d <= most], visitors[v - radius <= most]))
        work.append((members[d > most], np.concatenate([visitors[v + radius > most], members[(d <= most) & (d + radius > most)]])))
    return forest.flat()


def links(points: DataFrame) -> DataFrame:
    """points: fp, distinct. Returns a spanning forest (a, b) of the pairs within the radius; exact."""
    spark = points.sparkSession
    n = points.count()
    shards = -(-n // SHARD_POINTS)
    sample = []
    if shards > 1:  # a bounded, repeatable sample
        parts, wanted = 1 << 40, min(MAX_SAMPLE, max(SAMPLE, 32 * shards))
        sample = [r["fp"] for r in points.where(hash_part("fp", F.lit("tree"), parts=parts) < max(1, parts * wanted // n)).limit(2 * wanted).collect()]
    tree = spark.sparkContext.broadcast(shard_tree(np.array(sample, np.int64).view(np.uint64), shards))

    def route(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at, member in deal(own, tree.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(own[at].view(np.int64)), pa.array(np.full(len(at), member))], names=["shard", "fp", "own"])

    def join(group: pa.Table) -> pa.Table:
        own = group.column("fp").to_numpy().view(np.uint64)
        root = link_shard(own, group.column("own").to_numpy())
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": own[at].view(np.int64), "b": own[root[at]].view(np.int64)})

    return points.select("fp").mapInArrow(route, "shard int, fp long, own boolean").groupBy("shard").applyInArrow(join, "a long, b long")


def classes(rows: DataFrame, key: str) -> DataFrame:
    """rows: fp and the key. Returns (fp, n, best): how many rows have the fingerprint, and the smallest key of its component."""
    own = materialize(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "fingerprints")
    found = components(links(own))
    # Each linked fingerprint with its root; roots stand for themselves. Minima are taken before anything is dealt out by root.
    stars = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    linked = materialize(own.join(stars, own["fp"] == stars["node"]).select("fp", "root", "least"), "linked")
    total = linked.count()
    best = linked.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("members"))
    known = join_hot(linked, best, ["root"], "members", total).select("fp", "best")
    return own.join(known, "fp", "left").select("fp", "n", F.coalesce("best", "least").alias("best"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the key, fingerprint (16 hexadecimal digits), component_id."""
    rows = materialize(fingerprints(docs.select(key, text), text).select(key, "fp"), "simhash")
    found = materialize(classes(rows, key), "components")
    return join_hot(rows, found, ["fp"], "n", rows.count()).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs``; of each component one row stays: the one with the smallest key, of repeated rows any one."""
    schema = docs.schema
    fp, row = fresh(docs.columns, "fp", "row")
    kept = materialize(fingerprints(docs, text, fp).withColumn(row, F.monotonically_increasing_id()), "simhash")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    found = classes(kept.select(F.col(fp).alias("fp"), order.alias("order")), "order")
    stay = found.select(F.col("best.row").alias(row)).distinct()
    return kept.join(stay, row, "left_semi").select(*(F.col(f"`{c}`") for c in schema.names))
