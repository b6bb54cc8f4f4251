import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm.embedding_dedup import near_duplicate_vectors
from tallyspark.llm.language_id import identified, learned_from

sys.path.insert(0, str(Path(__file__).parents[2]))


def brute_links(vectors, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    hit = np.zeros((len(vectors), len(vectors)), dtype=bool)
    for size in {len(v) for v, o in zip(vectors, ok) if o}:
        at = np.flatnonzero([o and len(v) == size for v, o in zip(vectors, ok)])
        m = np.array([vectors[k] for k in at], dtype=np.float64)
        m /= np.linalg.norm(m, axis=1)[:, None]
        hit[np.ix_(at, at)] = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    comp = list(range(len(vectors)))
    changed = True
    while changed:
        changed = False
        for i in range(len(vectors)):
            low = min([comp[i], *(comp[j] for j in np.flatnonzero(hit[i]))])
            if low < comp[i]:
                comp[i], changed = low, True
    return [(i, int(hit[i].sum()), comp[i], comp[i] == i) for i in range(len(vectors))]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 24)).tolist()
    for size, noise in ((2, 0.02), (3, 0.05), (60, 0.02), (40, 0.3)):
        base = rng.standard_normal(24)
        vectors += [(base + noise * rng.standard_normal(24)).tolist() for _ in range(size)]
    vectors += [vectors[0]] * 30 + [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [0.0] * 23, [1.0], [x * 3 for x in vectors[1]]]
    table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)
    exact = [None if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    got = sorted(tuple(r) for r in near_duplicate_vectors(table, block=16, most=16).collect())
    assert got == brute_links(exact, 0.9)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_lengths_do_not_disturb_each_other(spark):
    schema = "vec_id long, embedding array<double>, kept string"
    near = [[1.0, 0.01 * k] for k in range(5)]
    for more, want in (([], 4), ([[1.0, 2.0, 3.0]], 4), ([[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [5.0]], 4)):
        vectors = near + more
        table = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], schema)
        audits = []
        got = sorted(tuple(r) for r in near_duplicate_vectors(table, audits=audits).collect())
        assert got == brute_links(vectors, 0.9) and got[0][1] == want and audits[-1] >= 0.98
    only_short = spark.createDataFrame([(3, [1.0], "x"), (2, [2.0], "x"), (2, [-1.0], "x"), (None, [1.0], "x")], schema)
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id) for r in near_duplicate_vectors(only_short).collect()) == [(-1, 0, None), (2, 0, 2), (2, 1, 2), (3, 1, 2)]


def test_tight_groups_larger_than_a_part_stay_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    vectors = [(base + 0.01 * rng.standard_normal(24)).tolist() for _ in range(150)] + rng.standard_normal((40, 24)).tolist()
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = brute_links(vectors, 0.9)
    assert sorted(tuple(r) for r in near_duplicate_vectors(table, tries=1).collect()) == want
    # too few comparisons to find the links: all vectors are compared in the end
    assert sorted(tuple(r) for r in near_duplicate_vectors(table, neighbours=1, tables=1, rounds=0, most=2, tries=1, block=50).collect()) == want


WORDS = {
    "en": "the of and to in is that was for on with as by this from are be it",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein",
    "fr": "de la le et les des en un du une que est dans qui par pour au sur",
    "es": "de la que el en y los se del las un por con no una su para es",
}


def test_held_out_accuracy(spark):
    rnd = random.Random(5)
    langs = list(WORDS)
    rows = [(k, " ".join(rnd.choice(WORDS[langs[k % 4]].split()) for _ in range(rnd.randint(15, 60))), langs[k % 4]) for k in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... ###", None), (1003, "漢字", None), (None, "the of and", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identified(table, per_language=60, keep=["doc_id", "lang"]).withColumn("held", ~learned_from(F.col("doc_id"))).collect()
    held = [r for r in got if r.held and r.doc_id < 1000]
    assert len(held) > 60 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1003].lang_pred != "und" and by[None].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in identified(table.filter("lang is null")).collect()} == {"und"}
    assert identified(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    line = WORDS["en"] + " one two three four five six"
    texts = [line, line, "write to a@b.org " + line[:40], "9 8 7", None, "x " + " ".join(f"bench{k}" for k in range(12)), "short"]
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept == [[0, 1, 2, 5, 6], [0, 2, 5, 6], [0, 2, 6], [0, 2, 6]]
    assert docs.filter("doc_id = 2").first().text.startswith("write to <email> the of")
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [0, 2, 6]
