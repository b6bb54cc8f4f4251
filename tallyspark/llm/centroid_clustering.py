"""Lloyd's k-means on integers with two trees.

Vectors become integers once. Each task's vectors, in shards of at most ``shard_rows``, get a
cover tree: every node has one of its vectors as centre, its children's centres lie further
apart than half its scale, and all its vectors lie within its radius. The trees are written;
every round reads them, builds the same kind of tree over the centroids, and walks both
together. A pair of nodes goes when the least distance that its radii allow exceeds the
greatest distance to the best centroid. A vector node with one centroid left is counted
whole, by its sum; where both nodes are leaves the distances are compared exactly.

Bounds are doubles with a slack far above their error and only ever drop what is certainly
further away; distances, sums and means that decide are exact integers, so neither the
shards nor the trees change a result. Between rounds only the centroids (``k`` vectors)
pass through the driver.

Defined results: vectors that are null, of another length, or that hold a null or non-finite
component are left out, and so are those with a component beyond 2^17 in magnitude, whose
squared distances would not fit a long. Repeated rows and ids count one by one; a null id
is never preferred as a first centroid; fewer than ``k`` vectors give fewer clusters; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Pairs whose distances are computed at once.
CHUNK = 1 << 14


@dataclass
class CoverTree:
    points: np.ndarray  # in the order of the nodes' ranges
    order: np.ndarray  # the rows that they were
    centre: np.ndarray  # a vector's place in points
    radius: np.ndarray
    first: np.ndarray  # the range of points
    last: np.ndarray
    child: np.ndarray  # the first child and the one after the last; none in leaves
    child_end: np.ndarray


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        d = x[at : at + CHUNK] - y[at : at + CHUNK]
        out[at : at + CHUNK] = np.einsum("ij,ij->i", d, d)
    return out


def cover_tree(x: np.ndarray, leaf: int = 16, wide: int = 64) -> CoverTree:
    """A node beyond ``leaf`` vectors gets children about half as wide.

    A node takes at most ``wide`` children that way, so that building stays near linear where
    no vectors are close; its other vectors become one more child with a radius of its own.
    """
    order = np.arange(len(x))
    nodes = [[0, 0, len(x), 0, 0]]  # centre (a row), range, children
    radii = [0.0]
    at = 0
    while at < len(nodes):
        centre, a, b, _, _ = nodes[at]
        mine = order[a:b]
        away = np.sqrt(apart(x[mine], np.broadcast_to(x[centre], (len(mine), x.shape[1]))).astype(np.float64))
        radii[at] = float(away.max())
        if b - a > leaf and radii[at] > 0:
            half = 2.0 ** (np.ceil(np.log2(radii[at])) - 1)
            groups, left, near = [], mine, away <= half
            while True:
                groups.append((centre, left[near]))
                left = left[~near]
                if not len(left) or len(groups) == wide:
                    break
                centre = left[0]
                near = apart(x[left], np.broadcast_to(x[centre], (len(left), x.shape[1]))) <= half * half
            if len(left):
                groups.append((left[0], left))
            if len(groups) > 1:
                nodes[at][3], nodes[at][4] = len(nodes), len(nodes) + len(groups)
                order[a:b] = np.concatenate([g for _, g in groups])
                for centre, g in groups:
                    nodes.append([centre, a, a + len(g), 0, 0])
                    radii.append(0.0)
                    a += len(g)
        at += 1
    found = np.array(nodes, np.int64)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return CoverTree(x[order], order, place[found[:, 0]], np.array(radii), *found[:, 1:].T)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for every value of the ranges [low, high)."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]


def nearest(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of points and their centroid's number: (first, last, centroid).

    Walks both trees level by level; ties go to the smaller number.
    """
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(q):
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        group = np.cumsum(np.r_[False, q[1:] != q[:-1]])
        d = np.sqrt(apart(tree.points[tree.centre[q]], centroids.points[centroids.centre[r]]).astype(np.float64))
        most = np.minimum.reduceat(d + tree.radius[q], begin)[group]  # each centre is a centroid itself
        stays = d - tree.radius[q] - centroids.radius[r] <= most * (1 + 1e-9) + 1e-6
        q, r = q[stays], r[stays]
        inner = centroids.child_end[r] > centroids.child[r]
        begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        group = np.cumsum(np.r_[False, q[1:] != q[:-1]])
        waits = np.logical_or.reduceat(inner, begin)[group]  # some centroid node is still to be opened
        owner, opened = spread(centroids.child[r[inner]], centroids.child_end[r[inner]])
        next_q, next_r = [q[inner][owner], q[waits & ~inner]], [opened, r[waits & ~inner]]
        q, r, begin = q[~waits], r[~waits], None
        if len(q):
            begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            group = np.cumsum(np.r_[False, q[1:] != q[:-1]])
            left = np.add.reduceat(centroids.last[r] - centroids.first[r], begin)[group]
            whole = left == 1
            done.append((tree.first[q[whole]], tree.last[q[whole]], centroids.order[centroids.first[r[whole]]]))
            down = ~whole & (tree.child_end[q] > tree.child[q])
            owner, opened = spread(tree.child[q[down]], tree.child_end[q[down]])
            next_q.append(opened)
            next_r.append(r[down][owner])
            ends = ~whole & ~down
            done.append(_compared(tree, centroids, q[ends], r[ends]))
        q, r = np.concatenate(next_q), np.concatenate(next_r)
    return tuple(np.concatenate(x) for x in zip(*done))


def _compared(tree: CoverTree, centroids: CoverTree, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf pairs: every point with every centroid left, exactly."""
    owner, point = spread(tree.first[q], tree.last[q])
    owner, which = spread(centroids.first[r[owner]], centroids.last[r[owner]])
    point, number = point[owner], centroids.order[which]
    d = np.empty(len(point), np.int64)
    for at in range(0, len(point), CHUNK):
        part = slice(at, at + CHUNK)
        d[part] = apart(tree.points[point[part]], centroids.points[which[part]])
    order = np.lexsort((number, d, point))
    point, number = point[order], number[order]
    best = np.flatnonzero(np.r_[True, point[1:] != point[:-1]]) if len(point) else np.zeros(0, np.int64)
    return point[best], point[best] + 1, number[best]


NODES = ("centre", "first", "last", "child", "child_end")
TREE = "points binary, radius binary, " + ", ".join(f"{c} binary" for c in NODES)


def _trees(size: int, shard_rows: int, leaf: int) -> Callable:
    def shard(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        t = cover_tree(x, leaf)
        held = ids.take(pa.array(t.order))
        cells = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), *(pa.array([v.tobytes()], pa.binary()) for v in (t.points.astype("<i4"), t.radius.astype("<f8"), *(getattr(t, c).astype("<i4") for c in NODES)))]
        return pa.RecordBatch.from_arrays(cells, names=["ids", "points", "radius", *NODES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                if held and rows + part.num_rows > shard_rows:
                    yield joined(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size).astype(np.int64)
        return shard(table.column("_id").combine_chunks(), x)

    return run


def _opened(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    for k in range(batch.num_rows):
        cell = {c: batch.column(c)[k].as_py() for c in ("points", "radius", *NODES)}
        points = np.frombuffer(cell["points"], "<i4").reshape(-1, size).astype(np.int64)
        yield batch.column("ids")[k].values, CoverTree(points, np.arange(len(points)), radius=np.frombuffer(cell["radius"], "<f8"), **{c: np.frombuffer(cell[c], "<i4").astype(np.int64) for c in NODES})


def _sums(centroids: list[list[int]], size: int) -> Callable:
    """A round: (cluster, place, count, sum) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(np.array(centroids, np.int64), leaf=1)
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), np.int64)
        for batch in batches:
            for _, tree in _opened(batch, size):
                first, last, number = nearest(tree, over)
                running = np.vstack([np.zeros((1, size), np.int64), np.cumsum(tree.points, axis=0)])
                np.add.at(count, number, last - first)
                np.add.at(total, number, running[last] - running[first])
        which, place = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(place, pa.int32()), pa.array(count[which]), pa.array(total.ravel())], names=["cluster", "place", "n", "total"])

    return run


def _assigned(centroids: list[list[int]], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.array(centroids, np.int64)
        over = cover_tree(x, leaf=1)
        for batch in batches:
            for ids, tree in _opened(batch, size):
                first, last, number = nearest(tree, over)
                owner, point = spread(first, last)
                cluster = np.empty(len(tree.points), np.int32)
                cluster[point] = number[owner]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(apart(tree.points, x[cluster]))], names=["_id", "cluster", "distance"])

    return run


def integers(vectors: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(_id, v): the vectors that take part, as integers."""
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 2**17))
    x = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return x.filter((F.size("x") == size) & fits).select("_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("v"))


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, leaf: int = 16) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    x = integers(vectors, size, scale, id_col, vector_col)
    id_type = x.schema["_id"].dataType.simpleString()
    trees = saved(x.mapInArrow(_trees(size, shard_rows, leaf), f"ids array<{id_type}>, {TREE}"), "trees")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    centroids = [list(r.v) for r in x.orderBy(F.asc_nulls_last(by_hash), "v").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        sums = trees.mapInArrow(_sums(centroids, size), "cluster int, place int, n long, total long")
        for r in sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0").collect():
            centroids[r.cluster][r.place] = r.total // r.n
    found = saved(trees.mapInArrow(_assigned(centroids, size), f"_id {id_type}, cluster int, distance long"), "assigned") if centroids else spark.createDataFrame([], f"_id {id_type}, cluster int, distance long")
    discard(trees)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    of = [(n, s, sum(inertia.values()), sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for n, s in sorted(inertia.items())]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
