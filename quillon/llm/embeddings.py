"""Operator 9: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors x, y have |x - y|^2 = 2 - 2 cos. They are rotated and split into
blocks of ``BLOCK`` dimensions; if cos >= t, in some block the squared distance
is at most that block's share of 2 - 2t, in proportion to its dimensions. So a
range join in each block, with that block's radius, finds every pair. It runs on
a tree of axis cuts through the block, planned on a bounded sample: a vector is
member of one leaf, and one within the radius of a cut also visits the leaf
beyond, from the lower side only. Candidates are verified on whole vectors in
double precision. A pair that is near in several blocks counts in the first.

A tree is cut for each label only as deep as its vectors need: a label with at most
``LEAF_POINTS`` distinct vectors is one leaf, for which the whole vector is the only
block, so its vectors move once. Deeper labels' vectors move once for each
block and visit; as the radius is about 1.5 standard deviations of a coordinate,
most vectors visit both sides of a cut: of random ones each moves 9 times at 4
leaves and 157 times at 128.

Equal vectors of a label collapse into one class before the join and count by
the class's size; a class is known by a 128-bit hash of label and vector from then on. What
leaves a task is a count for each vector and a spanning forest of its links,
never all pairs. Leaves with more than ``TILE`` members or visitors are cut into
tiles, so that no task holds all vectors that lie close together.

Vectors that are null, zero, or hold null or non-finite components, and those
with a null label, link with nothing and stand for themselves. Vectors of
different length don't link. Repeated rows are linked like other copies; a null
id never names a component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import hash_part, join_hot, materialize
from .components import components
from .simhash import Forest

BLOCK = 16
#: Members that a leaf is planned for, and members or visitors from which on leaves are tiled.
LEAF_POINTS, TILE = 6_000, 8_192
#: Rows of labels or leaves that are broadcast at most; beyond it they are joined by key.
BROADCAST_ROWS = 500_000
#: The sample that plans the leaves, 32 vectors for each, and its bounds.
SAMPLE, MAX_SAMPLE = 4_096, 65_536
SLACK = 1e-9
WHOLE = -1


@dataclass
class Cut:
    """A cut of one block: x[axis] <= at goes low. ``leaf`` is its number, as any cut is a leaf for labels that need no deeper ones."""

    leaf: int
    axis: int = 0
    at: float = 0.0
    low: Cut | None = None
    high: Cut | None = None


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation: spreads what a vector has over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def cuts(sample: np.ndarray, depth: int) -> Cut:
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray, depth: int) -> Cut:
        own = next(numbers)
        if depth <= 0 or len(points) < 8:
            return Cut(own)
        axis = int(points.std(axis=0).argmax())
        at = float(np.median(points[:, axis]))
        low = points[:, axis] <= at
        if low.all() or not low.any():
            return Cut(own)
        return Cut(own, axis, at, grow(points[low], depth - 1), grow(points[~low], depth - 1))

    return grow(sample, depth)


def deal(points: np.ndarray, tree: Cut, radius: float, depth: int):
    """(leaf, indices, whether they are members), no deeper than ``depth``."""
    work = [(tree, depth, np.arange(len(points)), np.zeros(0, np.int64))]
    while work:
        node, depth, members, visitors = work.pop()
        if node.low is None or not depth:
            for at, own in ((members, True), (visitors, False)):
                if len(at):
                    yield node.leaf, at, own
            continue
        m, v = points[members, node.axis], points[visitors, node.axis]
        work.append((node.low, depth - 1, members[m <= node.at], visitors[v - radius <= node.at]))
        work.append((node.high, depth - 1, members[m > node.at], np.concatenate([visitors[v + radius > node.at], members[(m <= node.at) & (m + radius > node.at)]])))


def _unit(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of packed numbers as unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of very large or small ones would not be numbers
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def join_leaf(x: np.ndarray, weight: np.ndarray, asks: np.ndarray, own: np.ndarray, block: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an asking row with an owned one, near in ``block`` (WHOLE: the whole vector) and in no earlier one, with cos >= least.

    Returns for each row the weight of its partners, and the first row of its component. A pair of two rows that
    both ask and are owned counts once.
    """
    dims = x.shape[1]
    rotated, parts = (x, [slice(0, dims)]) if block == WHOLE else (x @ rotation(dims), blocks(dims))
    block = max(block, 0)
    share = [(2 - 2 * least) * (b.stop - b.start) / dims + SLACK for b in parts]
    here = np.ascontiguousarray(rotated[:, parts[block]])
    square = (here * here).sum(axis=1)
    total, forest = np.zeros(len(x), np.int64), Forest(len(x))
    rows, cols = np.flatnonzero(asks), np.flatnonzero(own)
    for a in range(0, len(rows), 512):
        i0 = rows[a : a + 512]
        for b in range(0, len(cols), 2048):
            j0 = cols[b : b + 2048]
            i, j = np.nonzero(square[i0][:, None] + square[j0][None, :] - 2 * here[i0] @ here[j0].T <= share[block])
            i, j = i0[i], j0[j]
            once = (i != j) & ~((j < i) & own[i] & asks[j])
            i, j = i[once], j[once]
            for c in range(0, len(i), 1 << 15):
                p, q = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                near = np.einsum("nd,nd->n", x[p], x[q]) >= least
                p, q = p[near], q[near]
                if block and len(p):
                    apart = (rotated[p] - rotated[q]) ** 2
                    first = np.ones(len(p), bool)
                    for k in range(block):
                        first &= apart[:, parts[k]].sum(axis=1) > share[k]
                    p, q = p[first], q[first]
                if len(p):
                    total += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
                    forest.link(p, q)
    return total, forest.flat()


def _rows(vectors: DataFrame, key: str, vector: str, label: str, kind: str) -> DataFrame:
    """row (a number), id, label, class (16 bytes; null: links with nothing), dims, x (packed): each vector is looked at once."""

    def run(batches):
        task, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            column, labels = batch.column("x"), batch.column("label")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # null components become not a number
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            packed = [v.tobytes() for v in np.split(flat, np.cumsum(lengths)[:-1])] if len(column) else []
            names = labels.cast(pa.string()).to_pylist()
            known = []
            for name, v in zip(names, packed, strict=True):
                x = np.frombuffer(v, kind)
                good = name is not None and len(x) and np.isfinite(x).all() and x.any()
                known.append(hashlib.blake2b(v, digest_size=16, key=hashlib.blake2b(name.encode(), digest_size=16).digest()).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(task + n, task + n + len(packed)), pa.int64()), batch.column("id"), labels, pa.array(known, pa.binary()), pa.array(lengths, pa.int32()), pa.array(packed, pa.binary())],
                names=["row", "id", "label", "class", "dims", "x"],
            )
            n += len(packed)

    asked = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    id_type, label_type = (asked.schema[c].dataType.simpleString() for c in ("id", "label"))
    return asked.mapInArrow(run, f"row long, id {id_type}, label {label_type}, class binary, dims int, x binary")


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each vector: the key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.elementType == T.FloatType()
    if not single:
        vectors = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    kind = "<f4" if single else "<f8"  # vectors move in the precision that they came in
    rows = materialize(_rows(vectors, key, vector, label, kind), "rows")
    good = F.col("class").isNotNull()
    # One row of each class goes on; copies meet before anything is dealt out, in each task.
    facts = rows.where(good).groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("x").alias("x"))
    facts = materialize(facts.withColumn("node", F.monotonically_increasing_id()), "classes")

    sizes = materialize(facts.groupBy("dims", "label").agg(F.count("*").alias("n")).where(F.col("n") > LEAF_POINTS), "sizes")  # a row for at least LEAF_POINTS vectors
    most = {r["dims"]: (r["most"], r["all"]) for r in sizes.groupBy("dims").agg(F.max("n").alias("most"), F.sum("n").alias("all")).collect()}  # a row for each length that vectors have
    trees = {}
    for dims, (largest, all_) in most.items():  # a tree for each block of each length of vectors
        depth = int(np.ceil(np.log2(largest / LEAF_POINTS)))
        parts, wanted = 1 << 40, min(MAX_SAMPLE, max(SAMPLE, 32 << depth))
        drawn = facts.where((F.col("dims") == dims) & (hash_part("node", F.lit("cuts"), parts=parts) < max(1, parts * wanted // all_))).select("x").limit(2 * wanted).collect()
        unit = _unit(pa.array([bytes(r["x"]) for r in drawn], pa.binary()), kind) @ rotation(dims) if drawn else np.zeros((0, dims))
        trees[dims] = [cuts(unit[:, b], depth) for b in blocks(dims)]
    sent = spark.sparkContext.broadcast(trees)
    depths = sizes.select("dims", "label", F.ceil(F.log2(F.col("n") / LEAF_POINTS)).cast("int").alias("depth"))
    asked = facts.select("label", "dims", "x", "node", "n")
    if most:
        asked = asked.join(F.broadcast(depths) if sizes.count() <= BROADCAST_ROWS else depths, ["dims", "label"], "left")
    asked = asked.select("label", "dims", "x", "node", "n", (F.coalesce("depth", F.lit(0)) if most else F.lit(0)).cast("int").alias("depth"))

    def places(batch: pa.RecordBatch):
        """(dims, block, leaf, indices, whether they are members)."""
        lengths, depth = batch.column("dims").to_numpy(), batch.column("depth").to_numpy()
        for dims in np.unique(lengths).tolist():
            alone = np.flatnonzero((lengths == dims) & (depth == 0))
            if len(alone):
                yield dims, WHOLE, 0, alone, True
            for d in np.unique(depth[(lengths == dims) & (depth > 0)]).tolist():
                at = np.flatnonzero((lengths == dims) & (depth == d))
                rotated = _unit(batch.column("x").take(pa.array(at)), kind) @ rotation(dims)
                for k, (b, tree) in enumerate(zip(blocks(dims), sent.value[dims], strict=True)):
                    radius = np.sqrt((2 - 2 * least) * (b.stop - b.start) / dims + SLACK)
                    for leaf, some, own in deal(rotated[:, b], tree, radius, d):
                        yield dims, k, leaf, at[some], own

    def route(batches):
        for batch in batches:
            for dims, k, leaf, some, own in places(batch):
                n, pick = len(some), pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").take(pick), *(pa.array(np.full(n, v), pa.int32()) for v in (dims, k, leaf)), pa.array(np.full(n, own)), batch.column("node").take(pick), batch.column("n").take(pick), batch.column("x").take(pick)],
                    names=["label", "dims", "block", "leaf", "own", "node", "n", "x"],
                )

    def count(batches):
        """How many rows ``route`` deals to each leaf."""
        for batch in batches:
            for dims, k, leaf, some, own in places(batch):
                found = batch.column("label").take(pa.array(some)).value_counts()
                n = len(found)
                yield pa.RecordBatch.from_arrays([found.field("values"), *(pa.array(np.full(n, v), pa.int32()) for v in (dims, k, leaf)), pa.array(np.full(n, own)), found.field("counts").cast(pa.int64())], names=["label", "dims", "block", "leaf", "own", "rows"])

    place = ["label", "dims", "block", "leaf"]
    label_type = facts.schema["label"].dataType.simpleString()
    dealt = asked.mapInArrow(route, f"label {label_type}, dims int, block int, leaf int, own boolean, node long, n long, x binary")
    crowded = asked.where("depth > 0").mapInArrow(count, f"label {label_type}, dims int, block int, leaf int, own boolean, rows long")
    parts = lambda own: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(F.col("own") == own, F.col("rows"))), F.lit(0)) / TILE)).cast("int")
    crowded = materialize(crowded.groupBy(*place).agg(parts(True).alias("tiles"), parts(False).alias("guests")).where("tiles > 1 or guests > 1"), "crowded")  # a row for at least TILE rows
    n_crowded = crowded.count() if most else 0
    if n_crowded:
        dealt = dealt.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, place, "left")
    tiles, guests = ((F.coalesce(c, F.lit(1)) if n_crowded else F.lit(1)) for c in ("tiles", "guests"))
    # Of t tiles of members, tile i asks and is owned in (i, i), asks in (i, j > i), is owned in (j < i, i). Visitors ask once in each
    # tile: the first part of them in (i, i), the others in tasks (i, -part) of their own, which the tile's members visit.
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    task = lambda i, j, asks, owned: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), owned.alias("owned"))
    yes, no = F.lit(True), F.lit(False)
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    of_member = F.concat(
        upto(tiles, lambda t: task(F.least(t, mine(tiles)), F.greatest(t, mine(tiles)), t >= mine(tiles), t <= mine(tiles))),
        F.filter(upto(guests, lambda g: task(mine(tiles), -g, no, yes)), lambda x: x["j"] < 0),
    )
    of_visitor = upto(tiles, lambda t: task(t, F.when(mine(guests) > 0, -mine(guests)).otherwise(t), yes, no))
    split = dealt.select(*place, "node", "n", "x", F.explode(F.when(F.col("own"), of_member).otherwise(of_visitor)).alias("t")).select(*place, "t.*", "node", "n", "x")

    def join(group: pa.Table) -> pa.Table:
        x, n, ids = _unit(group.column("x"), kind), group.column("n").to_numpy(), group.column("node").to_numpy()
        total, root = join_leaf(x, n, group.column("asks").to_numpy(), group.column("owned").to_numpy(), group.column("block")[0].as_py(), least)
        some = np.flatnonzero((total > 0) | (root != np.arange(len(ids))))
        return pa.table({"node": ids[some], "links": total[some], "root": ids[root[some]]})

    found = materialize(split.groupBy(*place, "i", "j").applyInArrow(join, "node long, links long, root long"), "pairs")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    slim = facts.select("node", "class", "least", "n")
    linked = materialize(slim.join(stars, "node").select("node", "root", "least"), "linked")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    known = join_hot(linked, best, ["root"], "members", linked.count()).select("node", "component_id")
    done = slim.join(known, "node", "left").join(counts, "node", "left")
    done = materialize(done.select("class", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "facts")

    some = rows.select("id", "class")
    linked = join_hot(some.where(good), done, ["class"], "n", rows.count()).select("id", "n_links", "component_id")
    alone = some.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
