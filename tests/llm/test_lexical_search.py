"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np

from tallyspark.llm.lexical_search import best_first, max_tree, ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(documents, items, k=20):
    split = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(i, Counter(w := split(t)), len(w)) for i, t in documents]
    docs = [d for d in docs if d[2]]
    n, length, df = len(docs), sum(d[2] for d in docs), Counter(w for d in docs for w in d[1])
    out = []
    for item, text in items:
        scores = []
        for i, tf, size in docs:
            m = 75 + 25 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in split(text) if w in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Ärger", "naïve", "ÉTÉ", "x1", "zebra", "42", "ſ", "K"] + [f"w{k}" for k in range(60)]
    text = lambda size: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(size))
    return [(k, text(rng.randint(0, 40))) for k in range(n)], rng, text


def test_ranks_against_brute_force(spark):
    documents, rng, text = corpus(1, 400)
    same = text(25)
    documents += [(1000 + k, same) for k in range(60)]  # ties beyond the limit
    documents += [(5000, "zebra " * 3000), (None, same), (None, None), (6000, ""), (6001, "!?"), (7, same), (7, same)]
    items = [(k, text(12)) for k in range(12)] + [(50, same), (51, None), (52, "unknown!"), (53, "ZEBRA zebra"), (None, "the the x1"), (54, ".")]
    rng.shuffle(documents)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in documents], "doc_id long, text string, rank int, item_id int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    want = brute(documents, items)
    for options in ({}, {"shard_postings": 50, "leaf": 2, "fan": 2}, {"block_bytes": 200, "shard_postings": 300, "leaf": 4}):
        assert sorted(map(tuple, ranked(docs, asked, **options).collect()), key=repr) == want
    assert sorted(map(tuple, ranked(docs, asked, k=3, shard_postings=40, leaf=2, fan=3).collect()), key=repr) == brute(documents, items, 3)


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "One")], "item_id string, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(ranked(docs, items).collect(), key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]
    assert ranked(docs.limit(0), items).count() == 0 and ranked(docs, items.limit(0)).count() == 0


def test_tree_opens_only_what_may_win():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 9, 500)
    starts = np.r_[0, np.cumsum(size)]
    term = np.concatenate([np.sort(rng.choice(30, s, replace=False)) for s in size]).astype(np.int32)
    best = rng.integers(1, 6, len(term))
    levels = max_tree(starts, term, best, 4, 3)
    assert len(levels[-1][0]) == 2
    for _ in range(30):
        weight = np.zeros(30, np.int64)
        weight[rng.choice(30, 5, replace=False)] = rng.integers(1, 4, 5)
        scores = np.add.reduceat(best * weight[term], starts[:-1])
        want = sorted(((int(s), k) for k, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:7]
        assert sorted(best_first(levels, weight, 7, 1, 4, 3), key=lambda x: (-x[0], x[1])) == want
