"""Nearest neighbours by inner product: stable projections, a kd-tree over them, a chi-square test that says when to stop.

With M the largest length and q of any length, |q/|q| - x'|^2 = 2 - 2 q.x / (|q| M)
for x' = (x / M, sqrt(1 - |x|^2 / M^2)): the nearest x' has the largest inner
product. A Gaussian projection of a difference to m numbers has a squared length
of d^2 times a chi-square variable with m degrees of freedom. Neighbours
are verified in the order of their projected distance g; a search stops once
g^2 > d_k^2 times the quantile at `confidence`, d_k being the distance of the
k-th best so far: a nearer vector would have been seen with that probability.

1. The upper kd-tree is fitted on a bounded sample and has at most `max_cells`
   cells. Every vector is put into its cell; cells with more than `block_rows`
   are dealt into blocks by hash, so no task holds more, whatever repeats.
2. Rounds visit a query's cells by the distance of their boxes: the nearest, the
   next `step`, step times as many, and so on, those only that the test
   doesn't rule out with what is known by then. In a round the queries of a block
   go through it as a stream.
3. In a block, a kd-tree over its vectors gives leaves in the order of their
   distance, and the test holds the same way. Vectors that can't be among the
   k best, by what earlier rounds found, are not sent on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

_QUERIES = 512
#: Distances below this count as none: what rounding leaves of equal vectors.
_NOTHING = 1e-12


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile for an even number m of degrees of freedom, whose distribution is a finite sum."""
    if m % 2 or m <= 0:
        raise ValueError("the number of projections must be even")

    def share(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1.0
    while share(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """m directions for vectors of up to dim components and the one beyond; the longest vector has length `longest`."""

    directions: np.ndarray
    longest: float

    @classmethod
    def of(cls, dim: int, m: int, longest: float, seed: int) -> Projection:
        return cls(np.random.default_rng(seed).normal(size=(dim + 1, m)), longest)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        beyond = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1, keepdims=True), 0))
        return np.hstack([scaled, beyond]) @ self.directions

    def queries(self, q: np.ndarray) -> np.ndarray:
        largest = np.abs(q).max(axis=1, keepdims=True)
        unit = q / largest
        return unit / np.linalg.norm(unit, axis=1, keepdims=True) @ self.directions[:-1]


def kd_split(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Halves by the median of the widest direction until a part has at most `leaf` points or equal ones only.

    Gives the order of the points, the half-open ranges of the parts and the
    splits (direction, value, left, right): a child of -1 - i is part i.
    """
    order, parts, splits = np.arange(len(points)), [], []

    def halve(first: int, last: int) -> int:
        own = points[order[first:last]]
        width = np.ptp(own, axis=0) if last - first > leaf else np.zeros(1)
        if not width.max():
            parts.append((first, last))
            return -len(parts)
        d = int(width.argmax())
        ranked = own[:, d].argsort(kind="stable")
        order[first:last] = order[first:last][ranked]
        value = points[order[(first + last) // 2], d]
        if value == points[order[first], d]:  # the left side must not be empty
            value = points[order[first:last], d][points[order[first:last], d] > value].min()
        middle = first + int(np.searchsorted(points[order[first:last], d], value))
        me = len(splits)
        splits.append((d, float(value), 0, 0))
        left = halve(first, middle)
        splits[me] = (d, float(value), left, halve(middle, last))
        return me

    if len(points):
        halve(0, len(points))
    return order, parts, np.array(splits, dtype=[("d", "i4"), ("value", "f8"), ("left", "i4"), ("right", "i4")])


def part_of(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The part that each point is in."""
    at = np.zeros(len(points), np.int64) if len(splits) else np.full(len(points), -1)
    while len(inner := np.flatnonzero(at >= 0)):
        node = splits[at[inner]]
        at[inner] = np.where(points[inner, node["d"]] < node["value"], node["left"], node["right"])
    return -1 - at


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
    return out


@dataclass
class Cells:
    """The upper tree: splits, and for each cell that has vectors its number, box and number of blocks."""

    splits: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n_blocks: np.ndarray


def limit_of(worst: np.ndarray, length: np.ndarray, longest: float, quantile: float) -> np.ndarray:
    """The squared projected distance beyond which a search stops; worst: the k-th best inner product, -inf if there are fewer."""
    return quantile * np.maximum(2 - 2 * worst / (length * longest), _NOTHING)


class Block:
    """Vectors of a block in the order of its tree's leaves."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, null: np.ndarray, x: np.ndarray, near: np.ndarray, leaf: int):
        order, self.parts, _ = kd_split(near, leaf)
        self.row, self.ids, self.null, self.x = row[order], ids[order], null[order], np.ascontiguousarray(x[order])
        self.low, self.high = (np.array([f(near[order[a:b]], axis=0) for a, b in self.parts]) for f in (np.min, np.max))
        self.reach = float(np.sqrt((self.x**2).sum(axis=1)).max())

    def search(self, row: np.ndarray, q: np.ndarray, near: np.ndarray, worst: np.ndarray, k: int, longest: float, quantile: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query that finds any: its number, and places and inner products of its at most k best of this block that reach `worst`."""
        gaps = box_gaps(near, self.low, self.high)
        order = gaps.argsort(axis=1, kind="stable")
        length = np.sqrt((q**2).sum(axis=1))
        slack = 1e-12 * length * self.reach
        floor, active = worst.copy(), np.arange(len(q))
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
        held = np.zeros(len(q), np.int64)
        for step in range(len(self.parts)):
            part = order[active, step]
            going = gaps[active, part] <= limit_of(floor[active], length[active], longest, quantile)
            active, part = active[going], part[going]
            if not len(active):
                break
            ranked = part.argsort(kind="stable")
            starts = np.flatnonzero(np.diff(part[ranked], prepend=-1))
            for own in np.split(active[ranked], starts[1:]):
                p = order[own[0], step]
                a, b = self.parts[p]
                products = q[own] @ self.x[a:b].T
                products[row[own][:, None] == self.row[a:b]] = -np.inf
                i, j = np.nonzero((products >= (floor - slack)[own, None]) & (products > -np.inf))
                cuts = np.flatnonzero(np.diff(i, prepend=-1))
                for s, e in zip(cuts, [*cuts, len(i)][1:], strict=True):
                    at = own[i[s]]
                    found[at].append((a + j[s:e], products[i[s], j[s:e]]))
                    held[at] += e - s
                    if held[at] >= 2 * k:
                        floor[at] = max(floor[at], self._tighten(found, held, at, k, slack[at]))
        for at, parts in enumerate(found):
            if parts:
                places = np.concatenate([p for p, _ in parts])
                exact = (self.x[places] * q[at]).sum(axis=1)  # the same sum for equal vectors, wherever they lie
                best = np.lexsort((self.ids[places], self.null[places], -exact))[:k]
                yield at, places[best], exact[best]

    @staticmethod
    def _tighten(found: list, held: np.ndarray, at: int, k: int, slack: float) -> float:
        """Drop what can't be among the k best; the k-th best so far."""
        places, products = (np.concatenate(side) for side in zip(*found[at], strict=True))
        kth = np.partition(products, len(products) - k)[len(products) - k]
        left = products >= kth - slack
        found[at] = [(places[left], products[left])]
        held[at] = left.sum() if left.sum() < 2 * k else k  # copies beyond count as k, so that they aren't sorted at each step
        return kth


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows, shorter ones with zeros at the end."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(column.value_lengths().to_numpy())
    if len(flat) == dim * len(column):
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, x, length) of vectors that aren't null or zero and have no null or non-finite component, written once so that row numbers stay."""
    v = F.col(f"`{vec_col}`")
    as_double = v.cast("array<double>")
    fits = F.forall(as_double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(as_double, lambda c: c != 0)
    # Of a row's number the upper bits are its partition's.
    rows = vectors.where(F.coalesce(fits, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("x"))
    squares = F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c)
    return cut(rows.withColumn("length", F.least(F.sqrt(squares), F.lit(1e300))), "vectors")


def _indexed(rows: DataFrame, projection: Projection, dim: int, splits: np.ndarray) -> DataFrame:
    """rows with near (their projections) and cell."""
    shared = rows.sparkSession.sparkContext.broadcast((projection, splits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapping, tree = shared.value
        m = mapping.directions.shape[1]
        for batch in small(batches, 4096):
            near = mapping.candidates(_matrix(batch.column("x"), dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(near) + 1, m, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("x"), lists, pa.array(part_of(near, tree).astype(np.int32))], ["row", "id", "x", "near", "cell"])

    kind = rows.schema["x"].dataType.simpleString()
    return cut(rows.select("row", "id", "x").mapInArrow(place, f"row long, id long, x {kind}, near array<double>, cell int"), "indexed")


def _cells(indexed: DataFrame, splits: np.ndarray, m: int, block_rows: int) -> Cells:
    """At most as many rows as the upper tree has cells come to the driver."""
    bounds = [f(F.col("near")[d]).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(m)]
    got = indexed.groupBy("cell").agg(F.count("*").alias("n"), *bounds).orderBy("cell").collect()
    box = lambda n: np.array([[r[f"{n}{d}"] for d in range(m)] for r in got])
    return Cells(splits, np.array([r.cell for r in got]), box("low"), box("high"), np.array([-(-r.n // block_rows) for r in got]))


def _visits(asking: DataFrame, projection: Projection, dim: int, cells: Cells, first: int, last: int, quantile: float) -> DataFrame:
    """A row (cell, block, row, x, worst) for each block that a query visits in a round: of the cells with ranks first to last by distance those that the test doesn't rule out."""
    shared = asking.sparkSession.sparkContext.broadcast((projection, cells))
    names = ["cell", "block", "row", "x", "worst"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapping, upper = shared.value
        for batch in small(batches):
            q = _matrix(batch.column("x"), dim)
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            gaps = box_gaps(mapping.queries(q), upper.low, upper.high)
            order = gaps.argsort(axis=1, kind="stable")[:, first:last]
            limits = limit_of(worst, np.sqrt((q**2).sum(axis=1)), mapping.longest, quantile)
            i, j = np.nonzero(np.take_along_axis(gaps, order, axis=1) <= limits[:, None])
            to = order[i, j]
            blocks = upper.n_blocks[to]
            each = np.repeat(np.arange(len(i)), blocks)
            number = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            for a in range(0, len(each), 8192):
                own, rows = each[a : a + 8192], pa.array(i[each[a : a + 8192]])
                yield pa.RecordBatch.from_arrays([pa.array(upper.cell[to[own]].astype(np.int32)), pa.array(number[a : a + 8192].astype(np.int32)), *(batch.column(c).take(rows) for c in names[2:])], names)

    kind = asking.schema["x"].dataType.simpleString()
    return asking.select("row", "x", "worst").mapInArrow(visit, f"cell int, block int, row long, x {kind}, worst double")


def _search(indexed: DataFrame, visits: DataFrame, projection: Projection, dim: int, cells: Cells, k: int, leaf: int, quantile: float) -> DataFrame:
    """(row, near_row, vec_id, score) of what the visits find."""
    shared = indexed.sparkSession.sparkContext.broadcast(projection)
    blocks = np.ones(int(cells.cell.max()) + 1, np.int64)
    blocks[cells.cell] = cells.n_blocks
    n_blocks = F.get(F.array(*map(F.lit, blocks.tolist())), F.col("cell"))  # a constant with an entry for each cell
    held = indexed.select("cell", F.pmod(F.xxhash64("row"), n_blocks).cast("int").alias("block"), "row", "id", "x", "near", F.lit(False).alias("asks"), F.lit(None).cast("double").alias("worst"))
    asked = visits.withColumns({"asks": F.lit(True), "id": F.lit(None).cast("long"), "near": F.lit(None).cast("array<double>")})
    both = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """(cell, block, asks) and neighbouring rows that have them."""
        for batch in small(batches, _QUERIES):
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "block", "asks")])
            starts = np.flatnonzero(np.concatenate([[batch.num_rows > 0], (np.diff(marks) != 0).any(axis=0)]))
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield tuple(marks[:, a].tolist()), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapping = shared.value
        for _, parts in groupby(slices(batches), key=lambda s: s[0][:2]):
            block, own = None, []
            for (*_, asks), part in parts:
                if not asks:
                    own.append(part)
                    continue
                if own:
                    block, own = _block(own, dim, mapping.directions.shape[1], leaf), []
                if block is None:  # its cell's vectors happen to be in other blocks
                    continue
                q, row = _matrix(part.column("x"), dim), part.column("row").to_numpy()
                out = list(block.search(row, q, mapping.queries(q), part.column("worst").to_numpy(zero_copy_only=False), k, mapping.longest, quantile))
                if out:
                    places = np.concatenate([p for _, p, _ in out])
                    by = np.repeat([row[at] for at, _, _ in out], [len(p) for _, p, _ in out])
                    columns = [pa.array(by), pa.array(block.row[places]), pa.array(block.ids[places], mask=block.null[places]), pa.array(np.concatenate([e for *_, e in out]))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "near_row", "vec_id", "score"])

    return both.mapInArrow(run, "row long, near_row long, vec_id long, score double")


def _block(parts: list[pa.RecordBatch], dim: int, m: int, leaf: int) -> Block:
    t = pa.Table.from_batches(parts).combine_chunks()
    get = lambda c: t.column(c).chunk(0)
    null = get("id").is_null().to_numpy(zero_copy_only=False)
    return Block(get("row").to_numpy(), get("id").fill_null(0).to_numpy(), null, _matrix(get("x"), dim), get("near").flatten().to_numpy().reshape(-1, m), leaf)


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, queries: str | None = None, every: int = 20, k: int = 20, projections: int = 8, confidence: float = 0.96, sample_rows: int = 1 << 15, cell_rows: int = 4096, max_cells: int = 2048, block_rows: int = 8192, leaf: int = 128, step: int = 16, seed: int = 23) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product) of each query's k nearest found; ties to the smaller id, null ids last.

    Queries are the rows whose id is divisible by `every`, or those for which
    `queries`, an SQL condition on `id`, holds; candidates all other rows, also
    those that repeat the query's id or vector. Each row is a query of its own
    if ids repeat. Vectors that are null, empty or zero, or that hold a null or
    non-finite component take no part; shorter ones count as filled up with
    zeros. With fewer than k candidates all are found; an empty table gives no rows. Other
    columns are not carried. sample_rows bounds what the upper tree is fitted
    on and max_cells what is broadcast; every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vec_col)
    asking = rows.where(queries or f"id % {every} = 0").select("row", F.col("id").alias("query_id"), "x")
    n, dim, longest = rows.agg(F.count("*"), F.max(F.size("x")), F.max("length")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    projection, quantile = Projection.of(dim, projections, longest, seed), chi_square_quantile(confidence, projections)
    sample = rows.orderBy(F.xxhash64("row")).limit(sample_rows).select("x").toArrow().combine_chunks()  # a bounded number of rows
    near = projection.candidates(_matrix(sample.column("x").chunk(0), dim))
    wanted = min(max_cells, -(-n // cell_rows))
    _, _, splits = kd_split(near, max(1, -(-len(near) // wanted)))
    indexed = _indexed(rows, projection, dim, splits)
    cells = _cells(indexed, splits, projections, block_rows)
    best = None
    first, last = 0, 1
    while first < len(cells.cell):
        if best is None:
            now = asking.withColumn("worst", F.lit(float("-inf")))
        else:
            known = best.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
            now = asking.join(known, "row", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
        found = _search(indexed, _visits(now, projection, dim, cells, first, last, quantile), projection, dim, cells, k, leaf, quantile)
        both = found if best is None else best.unionByName(found)
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "near_row")
        ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = cut(ranked.select("row", "near_row", "vec_id", "score") if last < len(cells.cell) else ranked, "nearest")
        first, last = last, last + (last - first) * step
    named = best.join(asking.select("row", "query_id"), "row")
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
