"""Lloyd's rounds against brute force in Python integers."""

import math
from hashlib import sha256

import numpy as np
import pytest

from tallyspark.llm.centroid_clustering import apart, clustered, cover_tree, nearest


def brute(rows, k=8, rounds=10, size=64, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1]))
    centroids = [list(v) for _, v in order[:k]]
    choose = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds if kept else 0):
        found = choose()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = choose() if kept else []
    return sorted(((i, c, d, sum(e for e, o in found if o == c), sum(e for e, _ in found), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found)), key=repr)


def test_rounds_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((5, 6))
    vectors = [(centres[k % 5] + 0.1 * rng.standard_normal(6)).tolist() for k in range(300)] + [centres[0].tolist()] * 80 + [[0.0] * 6] * 3
    rows = [(k, v) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [float("-inf")] + [0.0] * 5), (904, [None] * 6), (905, []), (3, vectors[9]), (3, vectors[9]), (None, vectors[4]), (906, [-1000.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(4)
    for options in ({"k": 8}, {"k": 3, "rounds": 2}, {"k": 8, "seed": "7", "rounds": 0}):
        want = brute(rows, size=6, **options)
        for shard_rows, leaf in ((4096, 16), (30, 2)):
            assert sorted(map(tuple, clustered(table, size=6, shard_rows=shard_rows, leaf=leaf, **options).collect()), key=repr) == want


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, 0.0]), (4, [2.0**18, 0.0])]
    got = sorted(map(tuple, clustered(spark.createDataFrame(rows, schema), size=2).collect()))
    assert got == brute(rows[:3], size=2)  # the last one's components are too large
    empty = clustered(spark.createDataFrame([], schema), size=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_the_nearest(seed):
    rng = np.random.default_rng(seed)
    n, k, d = int(rng.integers(1, 700)), int(rng.integers(1, 40)), int(rng.integers(1, 9))
    x = rng.integers(-30, 30, (n, d)) * int(rng.integers(1, 1000))
    c = np.vstack([x[rng.integers(0, n, k)], x[:1]])  # copies among centroids too
    tree, over = cover_tree(x, leaf=int(rng.integers(1, 9)), wide=int(rng.integers(2, 20))), cover_tree(c, leaf=1)
    for t in (tree, over):
        for q in range(len(t.centre)):
            away = apart(t.points[t.first[q] : t.last[q]], np.broadcast_to(t.points[t.centre[q]], (t.last[q] - t.first[q], d)))
            assert t.first[q] <= t.centre[q] < t.last[q] and away.max() <= t.radius[q] ** 2 * (1 + 1e-12)
    got = np.full(n, -1)
    for first, last, number in zip(*nearest(tree, over)):
        assert (got[tree.order[first:last]] == -1).all()
        got[tree.order[first:last]] = number
    assert (got == ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()


def test_close_vectors_are_counted_whole():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (500, 8)) + 10_000 * k for k in range(4)])
    first, last, number = nearest(cover_tree(x), cover_tree(x[[0, 500, 1000, 1500]], leaf=1))
    assert len(first) < 40 and (last - first).sum() == 2000
