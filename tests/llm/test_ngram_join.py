import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import ngram_join
from tallyspark.llm.components import components
from tallyspark.llm.ngram_join import near_duplicates, one_of_each_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"Word{k}" for k in range(300)]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared = line(30)
    texts = []
    for size in (3, 12, 25, 60, 120):
        base = line(size)
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, size // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    texts += [" ".join(line(10) + shared + line(rnd.randint(0, 8))) for _ in range(60)]
    texts += ["same words here", "SAME  words here", "one", "one", "", None, " \n", "é è", "é  è"]
    rnd.shuffle(texts)
    return texts


def test_against_brute_force(docs):
    for seed, reach, hot in ((1, 16, ngram_join.HOT), (2, 2, 5), (3, 1, 20)):
        texts = corpus(seed)
        got = sorted(tuple(r) for r in near_duplicates(docs(texts), shingle=4, similarity=(85, 100), reach=reach, hot=hot).collect())
        assert got == brute(texts, 4, 85, 100), (seed, reach, hot)


def copies_of_one(size):
    rnd = random.Random(size)
    base = [f"w{rnd.randrange(5000)}" for _ in range(148)]
    texts = []
    for k in range(size):
        w = list(base)
        for at in rnd.sample(range(148), k % 7):  # from 4 on mostly strangers
            w[at] = f"e{rnd.randrange(100_000)}"
        texts.append(" ".join(w))
    return texts


def test_large_group_of_near_copies_does_not_grow_with_its_square(docs, monkeypatch):
    written = []
    saved = ngram_join.saved

    def kept(df, name):
        written.append((name, saved(df, name)))
        return written[-1][1]

    monkeypatch.setattr(ngram_join, "saved", kept)
    monkeypatch.setattr(ngram_join, "discard", lambda *tables: None)
    asked = {}
    for size in (300, 900):
        written.clear()
        texts = copies_of_one(size)
        got = sorted(tuple(r) for r in near_duplicates(docs(texts), similarity=(80, 100)).collect())
        assert got == brute(texts, 5, 80, 100)
        long = [name for name, _ in written].index("open-lists")
        asked[size] = sum(df.count() for name, df in written[long:] if name == "pairs")
    assert asked[900] < 5 * asked[300] and asked[900] < 12 * 900, asked


def test_kept_documents_and_clashing_columns(docs):
    texts = ["a b c d e f g"] * 3 + ["x y", None, ""]
    table = docs(texts).withColumn("component_id", F.lit("mine")).withColumn("token", F.lit(0))
    kept = one_of_each_group(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert near_duplicates(docs([])).count() == 0


def test_null_ids_stay_and_rows_that_share_an_id_are_one_vertex(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, c), (2, a), (5, a), (5, b), (6, b), (7, None), (7, c), (None, a), (None, "a text of its own")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id) for r in near_duplicates(table).filter("doc_id is not null").collect())
    assert found == [(1, 1), (2, 2), (5, 2), (5, 2), (6, 2), (7, 1), (7, 1)]
    kept = [(r.doc_id, r.text) for r in one_of_each_group(table).collect()]
    assert sorted(kept, key=str) == sorted([(1, c), (2, a), (None, "a text of its own")], key=str)


def test_copies_go_whatever_their_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(7, a, 1), (7, a, 2), (None, b, 3), (None, b.upper() + " ", 4), (None, a, 5), (None, None, 6), (None, "", 7), (8, c, 8), (None, c, 9), (9, None, 10), (9, None, 11), (None, b + " more", 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)
    kept = one_of_each_group(table)
    assert kept.columns == table.columns
    got = sorted(r.component_id for r in kept.collect())
    assert [k for k in got if k > 2] in ([3, 6, 7, 8, 10, 11, 12], [4, 6, 7, 8, 10, 11, 12]) and len(got) == 8
    assert one_of_each_group(table.limit(0)).count() == 0


def test_prefix_filter_never_loses_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        costs = rng.integers(0, 50, n).astype(float)
        step, length = ngram_join.choose_prefix(np.sort(costs), n, 85, 100)
        need = ngram_join.least_overlap(n, 85, 100)
        assert 1 <= step <= need and length == n - need + step <= n


def test_longer_prefixes_save_candidates(docs):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(4000)]
    passages = [" ".join(rnd.choice(words) for _ in range(4)) for _ in range(500)]
    # unlike texts made of passages that about ten texts hold: each shingle has candidates
    texts = [" ".join(rnd.sample(passages, rnd.randint(8, 14))) for _ in range(450)]
    longer, plain = {}, {}
    a = sorted(tuple(r) for r in near_duplicates(docs(texts), shingle=2, similarity=(60, 100), report=longer).collect())
    b = sorted(tuple(r) for r in near_duplicates(docs(texts), shingle=2, similarity=(60, 100), longest=1, report=plain).collect())
    assert a == b == brute(texts, 2, 60, 100)
    assert set(plain["steps"]) == {1} and sum(n for step, n in longer["steps"].items() if step > 1) > 100
    assert longer["pairs"] < plain["pairs"]


def test_sketch_counts_documents(docs):
    texts = [f"common words here {k} {k + 1} {k + 2}" for k in range(500)]
    table = ngram_join.sketch(docs(texts).repartition(3).select(F.col("text").alias("_text")), 3)
    first = next(ngram_join.row_sets(pa.array(texts[:1]), 3))[2]
    assert sorted(ngram_join.excess(table, first).tolist())[-1] > 450 and sorted(ngram_join.excess(table, first).tolist())[0] < 3


def test_very_long_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, long, 0), (1, long, 0), (2, long + " end", 1), (3, None, 1)]
    found = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _n int")).collect())
    assert found == [(1, 59_996, 1), (1, 59_996, 1), (2, 59_997, 1), (3, 0, 3)]


def test_components(spark):
    rnd = random.Random(3)
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, k) for k in range(101, 140)]
    mesh = [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    edges = [*chain, *star, *mesh, (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
