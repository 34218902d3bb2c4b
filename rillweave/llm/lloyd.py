"""Centroid clustering of integer vectors: Lloyd's rounds by two trees, exact in every step.

Vectors lie in blocks of a bounded size, each with a cover tree that is built
once and written beside it. Each round the driver builds a cover tree over the
centroids, which is broadcast (as many rows as there are centroids). A task
goes down both trees of a block together: a pair of nodes is dropped as soon as
its least possible distance is above what some centroid guarantees for every
vector of the node. Leaf pairs that are left are compared exactly, in integers.
Blocks send a count and a sum for each centroid and component; Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small, unused

#: Components beyond this make squared distances that a long can't hold.
_LARGEST = 1 << 27
_PAIRS = 1 << 15
#: What rounding may do to a distance, as a share of it.
_SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes breadth first. A node covers order[first:last] and lies at the point `center`; no point of it is farther than radius. Its children are nodes child:child + n_children, none for a leaf."""

    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    n_children: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = 1) -> CoverTree:
        """Children of a node are centers more than half its scale apart (a power of two), the first the node's own; each takes the points within that half which no earlier one took. Nodes of at most `leaf` points or of equal ones are leaves."""
        x = points.astype(np.float64)
        away = lambda rows, at: np.sqrt(((x[rows] - x[at]) ** 2).sum(axis=1))
        order, nodes = np.arange(len(x)), []
        far = away(order, 0)
        waiting = [(0, 0, len(x), far)]  # center, first, last, distances of order[first:last] from the center
        for center, first, last, far in waiting:
            radius = float(far.max())
            node = [center, radius, first, last, 0, 0]
            nodes.append(node)
            if radius == 0 or last - first <= leaf:
                continue
            half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
            node[4], at, rest = len(waiting), first, order[first:last].copy()
            while len(rest):
                near = far <= half
                own, own_far = rest[near], far[near]
                order[at : at + len(own)] = own
                waiting.append((center, at, at + len(own), own_far))
                node[5] += 1
                at += len(own)
                rest = rest[~near]
                if len(rest):
                    center, far = rest[0], away(rest, rest[0])
        c = list(zip(*nodes, strict=True))
        return cls(np.array(c[0], np.int32), np.array(c[1], np.float64), *(np.array(v, np.int32) for v in c[2:]), order.astype(np.int32))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i n[i] times: i, and 0, 1, ... n[i] - 1."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def _below(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node, of a leaf itself, and which entry of nodes each belongs to."""
    i, k = _spread(np.maximum(tree.n_children[nodes], 1))
    own = nodes[i]
    return np.where(tree.n_children[own] > 0, tree.child[own] + k, own), i


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centroid, the smaller number at equal distances, and its squared distance."""
    x, y = points.astype(np.float64), centroids.astype(np.float64)
    bound = np.full(len(tree.center), np.inf)  # no point below a node is farther from its nearest centroid
    q, r, leaves = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(q):
        far = np.concatenate([np.sqrt(((x[tree.center[q[a : a + _PAIRS]]] - y[over.center[r[a : a + _PAIRS]]]) ** 2).sum(axis=1)) for a in range(0, len(q), _PAIRS)])
        np.minimum.at(bound, q, far + tree.radius[q])
        left = far - tree.radius[q] - over.radius[r] <= bound[q] * (1 + _SLACK) + far * _SLACK
        q, r = q[left], r[left]
        done = (tree.n_children[q] == 0) & (over.n_children[r] == 0)
        leaves.append((q[done], r[done]))
        q, r = q[~done], r[~done]
        q_below, i = _below(tree, q)
        np.minimum.at(bound, q_below, bound[q[i]])
        r_below, k = _below(over, r[i])
        q, r = q_below[k], r_below
    q, r = (np.concatenate(side) for side in zip(*leaves, strict=True))
    best = np.full(len(x), np.iinfo(np.int64).max)
    cluster = np.full(len(x), len(centroids), np.int64)
    for a in range(0, len(q), _PAIRS):
        rows, cents = _leaf_pairs(tree, over, q[a : a + _PAIRS], r[a : a + _PAIRS])
        for b in range(0, len(rows), _PAIRS):
            row, cent = rows[b : b + _PAIRS], cents[b : b + _PAIRS]
            exact = ((points[row] - centroids[cent]) ** 2).sum(axis=1)
            before = best[row]
            np.minimum.at(best, row, exact)
            cluster[row[best[row] < before]] = len(centroids)  # those found before are farther
            hit = exact == best[row]
            np.minimum.at(cluster, row[hit], cent[hit])
    return cluster, best


def _leaf_pairs(tree: CoverTree, over: CoverTree, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (point, centroid) of pairs of leaves."""
    i, k = _spread(tree.last[q] - tree.first[q])
    rows, r = tree.order[tree.first[q[i]] + k], r[i]
    i, k = _spread(over.last[r] - over.first[r])
    return rows[i], over.order[over.first[r[i]] + k]


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, x) of vectors with exactly dim components, none null or non-finite: floor(scale * component) as a long. A component too large for a long distance is an error."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fits = F.coalesce((F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    largest = F.abs(F.lit(float(scale))) * F.array_max(F.transform(v, F.abs))
    exact = F.when(largest <= _LARGEST, F.transform(v, lambda c: F.floor(c * scale).cast("long"))).otherwise(F.raise_error(F.lit("a component is too large: its squared distance would not fit a long")))
    return vectors.where(fits).select(F.col(f"`{id_col}`").alias("id"), exact.alias("x"))


_TREE = ["center", "radius", "first", "last", "child", "n_children", "order"]


def blocks_of(rows: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """(ids, points, the tree's arrays): blocks of at most block_rows vectors, written once."""
    kind = rows.schema["id"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _slices(batches, dim, block_rows):
            tree = CoverTree.of(x)
            parts = [pa.array([ids], pa.list_(ids.type)), pa.array([x.astype("<i4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*parts, *(pa.array([getattr(tree, c).tobytes()], pa.binary()) for c in _TREE)], ["ids", "points", *_TREE])

    return cut(rows.mapInArrow(build, f"ids array<{kind.simpleString()}>, points binary, " + ", ".join(f"`{c}` binary" for c in _TREE)), "blocks")


def _slices(batches: Iterator[pa.RecordBatch], dim: int, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and vectors of a task's rows in blocks of `most`, the last smaller."""
    held, n = [], 0
    for batch in small(batches):
        held.append(batch)
        n += batch.num_rows
        while n >= most:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield _block(whole.slice(0, most), dim)
            held, n = whole.slice(most).to_batches(), n - most
    if n:
        yield _block(pa.Table.from_batches(held), dim)


def _block(table: pa.Table, dim: int) -> tuple[pa.Array, np.ndarray]:
    table = table.combine_chunks()
    ids, x = (table.column(c).chunk(0) for c in ("id", "x"))
    return ids, x.flatten().to_numpy().reshape(-1, dim)


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for i in range(batch.num_rows):
        get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)  # noqa: E731, B023
        tree = CoverTree(*(get(c, np.float64 if c == "radius" else np.int32) for c in _TREE))
        yield batch.column("ids")[i].values, get("points", "<i4").astype(np.int64).reshape(-1, dim), tree


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id` (null id: `seed:`), in that order; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    got = rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64)


def _moved(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Each centroid as the floor of the mean of its vectors; one without vectors stays."""
    shared = blocks.sparkSession.sparkContext.broadcast((centroids, CoverTree.of(centroids)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents, over = shared.value
        sums = np.zeros((len(cents), dim + 1), np.int64)
        for batch in small(batches, 8):
            for _, x, tree in _read(batch, dim):
                cluster, _ = nearest(x, tree, cents, over)
                order = np.argsort(cluster, kind="stable")
                found, starts = np.unique(cluster[order], return_index=True)
                sums[found, :dim] += np.add.reduceat(x[order], starts)
                sums[found, dim] += np.diff([*starts, len(x)])
        used = np.flatnonzero(sums[:, dim])
        columns = [np.repeat(used, dim + 1), np.tile(np.arange(dim + 1), len(used)), sums[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2])], ["cluster", "j", "s"])

    parts = blocks.mapInArrow(add, "cluster int, j int, s long")
    # At most a row for each centroid and component.
    total = {(r.cluster, r.j): int(r.s) for r in parts.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := total.get((c, dim)):
            out[c] = [total[c, j] // n for j in range(dim)]
    return out


def _assigned(blocks: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((centroids, CoverTree.of(centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 8):
            for ids, x, tree in _read(batch, dim):
                cluster, distance = nearest(x, tree, *shared.value)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(assign, f"id {kind}, cluster int, distance long")


def lloyd_clusters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, block_rows: int = 1024) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 for each vector that takes part.

    Vectors take part if they have exactly dim components, none null or not
    finite; others have no row, and an empty table gives none. Centroids start
    as the k vectors whose id has the smallest hash (a null id hashes as empty;
    rows that repeat an id come in order of their components), fewer if there
    are fewer vectors. Ties go to the smaller number; an empty centroid stays.
    Repeated rows count each. Other columns are not carried. Broadcast: k
    centroids and their tree.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, dim, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).where(F.lit(False))
    blocks = blocks_of(rows, dim, block_rows)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, dim)
    found = cut(_assigned(blocks, centroids, dim), "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    about = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    key = unused(found, "of")
    table = spark.createDataFrame(about, f"{key} int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(table), F.col("cluster") == F.col(key))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
