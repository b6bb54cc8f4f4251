"""Near-duplicate embeddings by NN-descent.

Equal vectors are one class with a weight from the start. Every class has a list of
neighbours, first from buckets of random hyperplanes, then refined: around each
class its neighbours, and those that have it as a neighbour, are compared with each
other, and each keeps its best. Groups that are too large (a bucket, or the reverse
neighbours of a hub) are split by a hash into groups of bounded size, so nothing is
left out and no task holds an unbounded group. The hash takes in the group, the round
and the attempt: no two splits have the same borders.

Pairs at or above the threshold link classes: those in the lists, and those that a
list had no room for, of which each group keeps a star for each of its components.
A group passes on only pairs that can still enter a list: those above the ``floor`` of
the list as it was before the round. A list all of whose entries pass the threshold is saturated and is enlarged to up to
``most`` entries that do. The numbers of links within a component are then made exact
by comparing its vectors in blocks. An audit compares a bounded sample of vectors, half
of it linked or nearly linked ones, with all vectors and runs further rounds with longer
lists while the share of links found is below ``recall``. If it still is after the last
attempt, the vectors of different components are compared with each other, all of
them, in blocks. The audited shares are logged and appended to ``audits``.

Ids are integers. Defined results: null, zero or empty vectors and vectors with null or
non-finite components have no links and form their own component; vectors of different
lengths are not compared, and each length has its own links; rows that repeat a vector, even under the same
id, count as further vectors; a null id has no component; an empty table gives an
empty table.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved
from .components import components
from .ngram_join import joined_groups

LOG = logging.getLogger(__name__)
EDGE = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("cosine", pa.float64()), ("star", pa.bool_())])
EDGE_SQL = "id long, near long, cosine double, star boolean"
#: Stands for the cosine of two members of a component that may not be near themselves.
NOT_COMPARED = -3.0
#: A floor under every cosine.
ANY_COSINE = -2.0


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys``, one at a time."""
    held: list[pa.RecordBatch] = []
    mark = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:]):
            now = tuple(c[x] for c in columns)
            if mark is not None and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _first_linked(hit: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    label = np.arange(len(hit))
    while True:
        low = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _best_within(size: int, threshold: float) -> Callable:
    """For each group: every member's best ``size`` fellow members, twice as many where
    they all pass the threshold, of these the ones above the member's floor, and a star
    for each of the group's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for group in runs(batches, ["group", "part", "length"]):
            ids, at = np.unique(group.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            vectors = group.column("vector").to_pylist()
            m = unit_rows([vectors[k] for k in at])
            s = m @ m.T
            np.fill_diagonal(s, -2)
            k = min(2 * size, len(ids) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            cosine = np.take_along_axis(s, best, axis=1)
            order = np.argsort(-cosine, axis=1, kind="stable")
            best, cosine = np.take_along_axis(best, order, axis=1), np.take_along_axis(cosine, order, axis=1)
            floor = group.column("floor").to_numpy()[at]
            x, y = np.nonzero(((np.arange(k) < size)[None, :] | (cosine >= threshold)) & (cosine > floor[:, None]))
            out.append((ids[x], ids[best[x, y]], cosine[x, y], np.zeros(len(x), dtype=bool)))
            rows += len(x)
            hit = s >= threshold
            if hit.any():
                first = _first_linked(hit)
                arms = np.flatnonzero(first != np.arange(len(ids)))
                out.append((ids[arms], ids[first[arms]], np.full(len(arms), NOT_COMPARED), np.ones(len(arms), dtype=bool)))
                rows += len(arms)
            if rows > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=EDGE)
                out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=EDGE)

    return run


def _split(members: DataFrame, most: int, salt: int) -> DataFrame:
    """Adds ``part``: groups with more than ``most`` members are cut by a hash of the
    member, the group and ``salt``."""
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / most).cast("long").alias("_parts"))
    return members.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("id", "group", F.lit(salt)), F.col("_parts"))).drop("_parts")


def _compared(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """Edges from groups (``group``, ``part``, ``id``, ``vector``, ``floor``)."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("group", "part", "id", "vector", "floor", F.length("vector").alias("length")).repartition(parts, "group", "part").sortWithinPartitions("group", "part", "length")
    return dealt.mapInArrow(_best_within(size, threshold), EDGE_SQL)


def _lists(edges: DataFrame, size: int, threshold: float, most: int) -> DataFrame:
    """Each class's list of neighbours (``listed``), and its stars.

    A list has the best ``size`` neighbours; one whose entries all pass the threshold
    grows to up to ``most`` that do. Both halves read all columns, so that Spark makes
    the edges once for both.
    """
    once = edges.groupBy("id", "near").agg(F.max("cosine").alias("cosine"), F.max("star").alias("star"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near"))
    ranked = once.filter(F.col("cosine") > NOT_COMPARED).withColumn("rank", rank).filter(F.col("rank") <= max(size, most))
    listed = ranked.filter((F.col("rank") <= size) | (F.col("cosine") >= threshold)).select("id", "near", "cosine", "star", F.lit(True).alias("listed"))
    return listed.unionByName(once.filter("star").select("id", "near", "cosine", "star", F.lit(False).alias("listed")))


def _floors(edges: DataFrame, size: int, threshold: float, most: int) -> DataFrame:
    """(id, floor): a pair must be above it to enter the list of ``id``.

    A list that is not full takes any pair, a full one what beats its worst entry, a
    saturated one with room also whatever passes the threshold.
    """
    lists = edges.filter("listed").groupBy("id").agg(F.count("*").alias("n"), F.min("cosine").alias("worst"))
    room = F.when(F.col("n") < size, F.lit(ANY_COSINE)).when(F.col("n") < most, F.least("worst", F.lit(threshold - 1e-9))).otherwise(F.col("worst"))
    return lists.select("id", room.alias("floor"))


def by_length(vectors: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of each length."""
    sizes = np.array([len(v) for v in vectors])
    return [(at, unit_rows([vectors[k] for k in at])) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]


def _hyperplane_buckets(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in by_length(b.column("vector").to_pylist()):
                planes = np.random.default_rng(11).standard_normal((m.shape[1], bits * tables))
                sides = (m @ planes > 0).reshape(len(m), tables, bits)
                bucket = (sides << np.arange(bits)).sum(axis=2) + (np.arange(tables)[None, :] << 40)
                rows = pa.array(np.repeat(at, tables))
                yield pa.RecordBatch.from_arrays([b.column("id").take(rows), pa.array(bucket.ravel().astype(np.int64))], names=["id", "group"])

    return run


def _block_counts(threshold: float):
    """For each pair of blocks of one component: the weight linked to each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "x", "y"]):
            ids, weight, own = (group.column(c).to_numpy() for c in ("id", "weight", "block"))
            m = unit_rows(group.column("vector").to_pylist())
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            hit = m[left] @ m[right].T >= threshold
            if x == y:
                np.fill_diagonal(hit, False)
            sums = [(ids[left], hit @ weight[right])]
            if x != y:
                sums.append((ids[right], hit.T @ weight[left]))
            for i, n in sums:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n.astype(np.int64))], names=["id", "n"])

    return run


def _links_across(threshold: float):
    """For each pair of blocks: the pairs of components that a link joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["x", "y", "length"]):
            component, own = (group.column(c).to_numpy() for c in ("component", "block"))
            m = unit_rows(group.column("vector").to_pylist())
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            hit = (m[left] @ m[right].T >= threshold) & (component[left][:, None] < component[right][None, :] if x == y else component[left][:, None] != component[right][None, :])
            i, j = np.nonzero(hit)
            if len(i):
                pairs = np.unique(np.stack([component[left][i], component[right][j]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _true_links(sample, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {m.shape[1]: (at, m) for at, m in sample.value}
        total = np.zeros(sum(len(at) for at, _ in asked.values()), dtype=np.int64)
        for b in batches:
            for first in range(0, b.num_rows, 4096):
                part = b.slice(first, 4096)
                weight = part.column("weight").to_numpy()
                for rows, m in by_length(part.column("vector").to_pylist()):
                    if m.shape[1] in asked:
                        at, mine = asked[m.shape[1]]
                        total[at] += (mine @ m.T >= threshold) @ weight[rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    return run


def near_duplicate_vectors(
    embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 8, rounds: int = 2, tables: int = 6, most: int = 64, block: int = 1024, audit: int = 256, recall: float = 0.98, tries: int = 3, audits: list[float] | None = None
) -> DataFrame:
    """One row per vector: the id, ``n_links``, ``component_id`` and ``kept``."""
    source = embeddings.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("_id").isNotNull() & (F.size("_vector") > 0) & finite & F.exists("_vector", lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("_vector")
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype="<f8")
            sizes = np.asarray(column.value_lengths())
            begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                m = flat[begin[at][:, None] + np.arange(n)[None, :]]
                # the largest component becomes one power of two or another: the same direction, no overflow
                m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None]) + 0.0
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at)), pa.array([r.tobytes() for r in m], pa.binary())], names=["_id", "_key"])

    rows = saved(source.filter(usable).mapInArrow(pack, "_id long, _key binary"), "vectors")
    # an id that repeats with different vectors keeps one number for each vector
    equal = rows.groupBy(F.col("_key").alias("vector")).agg(F.min("_id").alias("first_id"), F.count("*").alias("weight"))
    classes = saved(equal.select("first_id", F.xxhash64("vector").alias("id"), "vector", "weight"), "vector-classes")
    count = classes.count()
    bits = max(1, int(np.log2(max(count, 2) / 16)))
    vectors = classes.select("id", "vector")
    links = groups = numbers = edges = None
    for attempt in range(tries):
        size = neighbours << attempt
        buckets = saved(vectors.mapInArrow(_hyperplane_buckets(bits, tables << attempt), "id long, group long"), "buckets")
        placed = _split(buckets, most, attempt * (rounds + 1)).join(vectors, "id").withColumn("floor", F.lit(ANY_COSINE))
        start = _compared(placed, size, threshold)
        last, edges = edges, saved(_lists(start if edges is None else start.unionByName(edges.drop("listed")), size, threshold, most), "neighbours")
        discard(buckets, last)
        for turn in range(rounds):
            near = edges.filter("listed")
            ends = F.array(F.struct(F.col("id").alias("group"), F.col("near").alias("id")), F.struct(F.col("near").alias("group"), F.col("id")), F.struct(F.col("id").alias("group"), F.col("id")))
            around = near.select(F.explode(ends).alias("m")).select("m.group", "m.id").distinct()
            with_floor = vectors.join(_floors(edges, size, threshold, most), "id", "left").fillna(ANY_COSINE, ["floor"])
            members = _split(around, most, attempt * (rounds + 1) + 1 + turn).join(with_floor, "id")
            last, edges = edges, saved(_lists(_compared(members, size, threshold).unionByName(edges.drop("listed")), size, threshold, most), "neighbours")
            discard(last)
        links = edges.filter((F.col("cosine") >= threshold) | F.col("star"))
        groups = components(links, "id", "near")
        numbers = _exact_numbers(groups, classes, threshold, block)
        share = _recall(classes, numbers, edges, threshold, audit)
        LOG.info("attempt %d: %.4f of the audited links found", attempt + 1, share)
        if audits is not None:
            audits.append(share)
        if share >= recall:
            break
    else:
        groups = _groups_of_all(groups, classes, threshold, block)
        numbers = _exact_numbers(groups, classes, threshold, block)
    labelled = classes.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = labelled.join(least, "component").join(numbers, "id", "left").select(F.col("vector").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.join(found, rows["_key"] == found["_v"]).select("_id", "n_links", "component_id")
    alone = source.filter(~F.coalesce(usable, F.lit(False))).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


def _groups_of_all(groups: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """The components after comparing all vectors of different components, in blocks."""
    spark = classes.sparkSession
    blocks = max(1, -(-classes.count() // block))
    placed = classes.join(groups, "id", "left").select(F.coalesce("component", "id").alias("component"), "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.length("vector").alias("length"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component", "vector", "length")
    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "y").sortWithinPartitions("x", "y", "length")
    more = saved(dealt.mapInArrow(_links_across(threshold), "a long, b long").distinct(), "links")
    return groups if more.isEmpty() else joined_groups(groups, more)


def _exact_numbers(groups: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, n): weight linked to each class within its component, all pairs of blocks compared."""
    spark = classes.sparkSession
    held = groups.join(classes, "id").select("id", "component", "vector", "weight")
    blocks = held.groupBy("component").agg(F.ceil(F.count("*") / block).cast("long").alias("_blocks"))
    placed = held.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "weight", "vector")
    dealt = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component", "x", "y").sortWithinPartitions("component", "x", "y")
    return saved(dealt.mapInArrow(_block_counts(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "link-numbers")


def _recall(classes: DataFrame, numbers: DataFrame, edges: DataFrame, threshold: float, audit: int) -> float:
    """Share of the links of a bounded sample of vectors that was found: half any vectors,
    half vectors whose best listed neighbour is linked or nearly so."""
    spark = classes.sparkSession
    near = edges.filter(F.col("listed") & (F.col("cosine") >= threshold - 0.05)).select("id").distinct()
    mixed = F.xxhash64("id", F.lit(1))
    half = audit // 2
    chosen = classes.select("id").orderBy(mixed).limit(audit - half).union(near.orderBy(mixed).limit(half)).distinct()
    rows = classes.join(chosen, "id").join(numbers, "id", "left").select("vector", "weight", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if not rows:
        return 1.0
    sample = spark.sparkContext.broadcast(by_length([bytes(r["vector"]) for r in rows]))
    counted = classes.select("vector", "weight").mapInArrow(_true_links(sample, threshold), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    true = {r["k"]: r["n"] for r in counted}
    # a class always meets itself
    there = sum(true.get(k, 0) - r["weight"] for k, r in enumerate(rows))
    return 1.0 if there <= 0 else sum(r["n"] for r in rows) / there
