"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected on M Gaussian directions; a projected squared distance over the true one follows a
chi-square law of M degrees of freedom. A kd-tree over the projected points yields a query's neighbours in
growing projected distance, and each is verified with its full vector. The search stops when the law
leaves a chance under 1 - SURE that a vector nearer than the tenth found is still to come.

The top of the tree is cut from a bounded sample and deals all rows out to cells; a cell (or a part of one, if
more rows crowd it) is one kd-tree in one task. A query first searches the cell it lies in; the distance
found there bounds which other cells the stopping test leaves open, and it is sent to those only. Rows of the
index are never copied: a task holds one part and lets all its queries stream past.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from addrforge.llm.runtime import cut, join_spread, small_batches
from addrforge.llm.vectors import matrix, usable

#: Directions and the chance of the stopping test. Measured on the 51,282 vectors of 64 dimensions of check_l, whose tenth
#: neighbour lies at 0.57 of the median squared distance (share of rows verified, recall): 16 directions 0.20, 0.76 at 0.6;
#: 0.35, 0.89 at 0.8; 0.48, 0.96 at 0.9; 0.59, 0.98 at 0.95. 8 directions 0.55, 0.93 at 0.8; 0.69, 0.97 at 0.9; 0.90, 1.00 at 0.99.
M, SURE, K = 16, 0.9, 10
#: Rows of a cell; cells at most (beyond, cells grow); rows of the sample for each cell, which the upper tree is cut from.
CELL, CELLS, SAMPLED = 8192, 16384, 16
LEAF = 64
#: Points that are verified before the test is first tried again; doubled each time, up to what stays in a processor's cache.
STEP, MOST = 64, 512


def chi_square_quantile(p: float, m: int) -> float:
    """Value that a chi-square variable of m degrees of freedom stays under with probability p, by bisection."""

    def below(x: float) -> float:  # series of the regularised lower incomplete gamma function
        a, half = m / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= half / k
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if half > 0 else 0.0

    low, high = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dimensions: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(7 + dimensions).standard_normal((dimensions, m))


class Tree:
    """kd-tree over projected points: median cuts along the widest side, leaves with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        todo = [(0, len(points))] if len(points) else []
        while todo:
            a, b = todo.pop()
            some = points[self.order[a:b]]
            if b - a > leaf:
                axis = int(np.argmax(some.max(0) - some.min(0)))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(some[:, axis], mid)]
                todo += [(a + mid, b), (a, a + mid)]
            else:
                self.leaves.append((a, b))
        held = points[self.order]
        self.points = held
        self.low = np.array([held[a:b].min(0) for a, b in self.leaves])
        self.high = np.array([held[a:b].max(0) for a, b in self.leaves])


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of queries to boxes."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(-1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, q: np.ndarray, projected: np.ndarray, own: int, limit: float, k: int, factor: float):
    """Nearest k of one part: points in growing projected distance are verified until the chi-square test holds.

    limit is a squared distance within which k neighbours are known already (infinite at first). Gives squared distances and ids.
    """
    to_leaf = box_distance(projected, tree.low, tree.high)
    by_leaf = np.argsort(to_leaf, kind="stable")
    reach = np.append(to_leaf[by_leaf], np.inf)
    distance, near = np.zeros(0), np.zeros(0, np.int64)
    waiting, rows = np.zeros(0), np.zeros(0, np.int64)  # points of opened leaves, by projected distance
    bound, opened, opening, step = limit * (1 + 1e-12), 0, 2, STEP
    while True:
        # what is left lies at least this far in projection
        if min(reach[opened], waiting[0] if len(waiting) else np.inf) > bound * factor or (opened == len(by_leaf) and not len(waiting)):
            break
        if not len(waiting) or (opened < len(by_leaf) and reach[opened] < waiting[min(step, len(waiting)) - 1]):
            leaves = by_leaf[opened : opened + opening]
            leaves = leaves[to_leaf[leaves] <= bound * factor]
            at = np.concatenate([np.arange(*tree.leaves[x]) for x in leaves]) if len(leaves) else np.zeros(0, np.int64)
            opened = opened + opening if len(leaves) == opening else len(by_leaf)
            opening = min(2 * opening, MOST // LEAF)
            opened = min(opened, len(by_leaf))
            gap = tree.points[at] - projected
            waiting, rows = np.append(waiting, (gap * gap).sum(1)), np.append(rows, tree.order[at])
            order = np.argsort(waiting, kind="stable")
            waiting, rows = waiting[order], rows[order]
        # those nearer than any unopened leaf come next in projected distance
        n = min(int(np.searchsorted(waiting, reach[opened], side="right")), step)
        n = min(n, int(np.searchsorted(waiting, bound * factor, side="right")))
        if n:
            now = rows[:n][ids[rows[:n]] != own]
            waiting, rows, step = waiting[n:], rows[n:], min(2 * step, MOST)
            diff = vectors[now] - q
            distance, near = np.append(distance, np.einsum("ij,ij->i", diff, diff)), np.append(near, now)
            if len(near) > k:
                best = np.lexsort((ids[near], distance))[:k]
                distance, near = distance[best], near[best]
            if len(near) == k:
                bound = min(bound, float(distance.max()) * (1 + 1e-12))
    diff = vectors[near] - q
    return (diff * diff).cumsum(1)[:, -1] if len(near) else distance, ids[near]  # summed from left to right, as SQL does


class Cuts:
    """Upper tree: cut planes from a sample, whose leaves are cells that tile the projected space."""

    def __init__(self, sample: np.ndarray, cells: int):
        m = sample.shape[1]
        self.axis, self.at, self.below, self.cell, low, high = [], [], [], [], [], []
        self.cells = 0

        def node(lo, hi) -> int:
            self.axis.append(-1)
            self.at.append(0.0)
            self.below.append(-1)
            self.cell.append(-1)
            low.append(lo)
            high.append(hi)
            return len(self.axis) - 1

        todo = [(node(np.full(m, -np.inf), np.full(m, np.inf)), sample, cells)]
        while todo:
            i, some, n = todo.pop()
            axis = int(np.argmax(some.max(0) - some.min(0))) if len(some) else 0
            at = float(np.quantile(some[:, axis], (n // 2) / n)) if n > 1 and len(some) > 1 else 0.0
            left = some[:, axis] < at if n > 1 else np.zeros(len(some), bool)
            if n <= 1 or not left.any() or left.all():
                self.cell[i] = self.cells
                self.cells += 1
                continue
            upper, lower = high[i].copy(), low[i].copy()
            upper[axis] = lower[axis] = at
            self.axis[i], self.at[i], self.below[i] = axis, at, node(low[i], upper)
            node(lower, high[i])  # the other child follows the first
            todo += [(self.below[i], some[left], n // 2), (self.below[i] + 1, some[~left], n - n // 2)]
        self.axis, self.at, self.below, self.cell = map(np.array, (self.axis, self.at, self.below, self.cell))
        self.low, self.high = np.array(low), np.array(high)

    def home(self, p: np.ndarray) -> np.ndarray:
        """The cell of each point, by descent."""
        at = np.zeros(len(p), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[at] >= 0)
            if not len(inner):
                return self.cell[at]
            i = at[inner]
            at[inner] = self.below[i] + (p[inner, self.axis[i]] >= self.at[i])

    def open(self, p: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells within each point's squared radius, by descent."""
        point, at, found = np.arange(len(p)), np.zeros(len(p), np.int64), []
        while len(point):
            near = box_distance(p[point], self.low[at], self.high[at]) <= radius[point]
            point, at = point[near], at[near]
            leaf = self.axis[at] < 0
            found.append((point[leaf], self.cell[at[leaf]]))
            point, at = np.repeat(point[~leaf], 2), (self.below[at[~leaf]][:, None] + np.array([0, 1])).ravel()
        return np.concatenate([f[0] for f in found] or [point]), np.concatenate([f[1] for f in found] or [at])


def _assign(cuts: Cuts, m: int):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            cell = cuts.home(x @ directions(x.shape[1], m)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v")), pa.array(cell)], ["vec_id", "v", "cell"])

    return run


def _route(cuts: Cuts, m: int, factor: float):
    """Queries with their bound -> the cells that the stopping test leaves open, without the home cell."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                x = matrix(batch.column("v"))
                point, cell = cuts.open(x @ directions(x.shape[1], m), batch.column("bound").to_numpy() * (1 + 1e-12) * factor)
                away = cell != batch.column("cell").to_numpy()[point]
                at = pa.array(point[away])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("vec_id", "v", "bound")), pa.array(cell[away])], ["vec_id", "v", "bound", "cell"])

    return run


def _answer(k: int, factor: float, m: int):
    """Rows sorted by part, the index before the queries -> neighbours of each query found in each part."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        part, index = None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")], 1)
            starts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
                some = batch.slice(a, b - a)
                if part != tuple(key[a, :2]):
                    part, held, index = tuple(key[a, :2]), [], None
                if key[a, 2] == 0:
                    held.append(some)
                    continue
                if not held and index is None:
                    continue
                if index is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    x = matrix(table["v"].combine_chunks())
                    along = directions(x.shape[1], m)
                    index, held = (Tree(x @ along), x, table["vec_id"].to_numpy(), along), []
                tree, x, ids, along = index
                y = matrix(some.column("v"))
                p = y @ along
                columns: tuple[list, list, list] = ([], [], [])
                for i, (own, bound) in enumerate(zip(some.column("vec_id").to_pylist(), some.column("bound").to_pylist(), strict=True)):
                    squared, near = search(tree, x, ids, y[i], p[i], own, bound, k, factor)
                    for column, values in zip(columns, ([own] * len(near), near.tolist(), squared.tolist()), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "squared"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, sure: float = SURE, m: int = M) -> DataFrame:
    """(vec_id long, embedding array<float>, ...) twice -> query_id, rank, vec_id, score (Euclidean distance).

    Each query's k nearest of the other vec_ids that were found, nearest first, ties to the smaller id; all of them, if there are
    fewer. Null, zero or non-finite vectors and null ids take no part; a repeated vec_id counts once (its smallest vector). Only
    vectors of the most frequent length (of several, the smallest) are searched; queries of another length get no row. Empty
    tables give an empty one.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda df: usable(df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))).filter("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("v"))
    rows = cut(clean(vectors))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n = sizes[0]
    rows, asked = rows.filter(F.size("v") == d), clean(queries).filter(F.size("v") == d)
    cells = min(CELLS, max(1, -(-n // CELL)))
    per_cell = -(-n // cells)
    along = directions(d, m)

    def project(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((matrix(batch.column("v")) @ along).tolist(), pa.list_(pa.float64()))], ["p"])

    # about SAMPLED rows a cell, by hash: at most some SAMPLED * CELLS short projections
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // (SAMPLED * cells)))) == 0).select("v").mapInArrow(project, "p array<double>").toArrow()
    sample = matrix(drawn["p"].combine_chunks()) if drawn.num_rows else np.zeros((0, m))
    cuts = Cuts(sample.reshape(-1, m), cells)
    factor = chi_square_quantile(sure, m)
    placed = cut(rows.mapInArrow(_assign(cuts, m), "vec_id long, v array<double>, cell long"))
    homes = cut(asked.mapInArrow(_assign(cuts, m), "vec_id long, v array<double>, cell long"))
    # a cell that equal vectors crowd is searched in parts
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * per_cell)).alias("parts"))
    index = join_spread(placed, parts, ["cell"], F.col("vec_id")).select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("bound")
    )
    keys = ["cell", "part"]

    def ask(q: DataFrame) -> DataFrame:
        spread = q.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*keys, F.lit(1).alias("kind"), "vec_id", "v", "bound")
        dealt = index.unionByName(spread).repartition(*keys).sortWithinPartitions(*keys, "kind")
        return dealt.mapInArrow(_answer(k, factor, m), "query_id long, vec_id long, squared double")

    first = cut(ask(homes.withColumn("bound", F.lit(float("inf")))))
    order = W.partitionBy("query_id").orderBy("squared", "vec_id")
    kth = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("squared").alias("bound"))
    bounded = homes.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = ask(bounded.mapInArrow(_route(cuts, m, factor), "vec_id long, v array<double>, bound double, cell long"))
    best = first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("squared").alias("score"))


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
