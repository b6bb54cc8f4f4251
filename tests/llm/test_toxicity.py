"""Toxicity: features one by one, defined results, and held-out accuracy."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.toxicity import FEATURES, Describer, Lexicon, fragments, learned_from, scored

SF = "/root/testdata/sf0.1"


def described(text, weights=None):
    return dict(zip(FEATURES, Describer(weights or {"=idiot": 5.0, "=scum": 4.0, "achl": 2.0}).features(text)))


def test_features_of_hits_and_masks():
    f = described("You idiot, IDIOT! achlicht and more")
    assert (f["hits"], f["hit_words"], f["strength"], f["strongest"], f["near_you"]) == (3, 2, 12, 5, 1)
    assert f["hits_per_word"] == 3 / 6 and f["you_per_word"] == 1 / 6 and f["loud_words"] == 1 / 6 and f["exclaimed"] == 1 / 6
    for masked in ("1d10t", "id*ot".replace("*", "!"), "idiooot", "i d i o t", "s.c.u.m", "5cum"):
        f = described(f"some {masked} here")
        assert f["hits"] == 0 and f["masked_hits"] >= 1, masked
    for plain in ("a@b.com", "http://idi0t.example", "3rd 2x4 1984", "end.of.sentence", "idiot"):
        assert described(f"some {plain} here")["masked_hits"] == 0, plain
    assert described("“idiot” — idiot…")["hits"] == 2 and described("ÉCOLE école")["capitals"] == 5 / 10


def test_features_of_odd_texts():
    assert all(v == 0 for v in described(None).values()) and described("") == described(None)
    for text in ("!", "a", "\x00", "\ud800 x", "x" * 300_000, "a1" * 150_000, "idiot " * 100_000):
        assert all(abs(v) < float("inf") for v in described(text).values())
    assert described("idiot " * 100_000)["hits"] == 100_000


def test_lexicon_takes_a_document_out():
    lexicon = Lexicon.of([("=x", 0, 5), ("=y", 3, 0)], clean=10, toxic=10)
    assert lexicon.less[1]["=x"] < lexicon.any["=x"] and lexicon.less[0]["=y"] > lexicon.any["=y"]
    assert fragments("abcd") == ["=abcd", "abc", "abcd"]


def corpus(spark, n=240):
    rnd = random.Random(4)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        text = [rnd.choice(words) for _ in range(40)]
        for _ in range(3 * toxic):
            text[rnd.randrange(40)] = rnd.choice(["vile", "wretch", "stinker"])
        rows.append((k, " ".join(text), "a", "b"))
        labels += [(k, int(toxic))] * (1 + k % 2)
    return spark.createDataFrame(rows, "doc_id long, text string, score string, _margin string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")


def test_learned_words_and_defined_results(spark):
    docs, labels = corpus(spark)
    more = spark.createDataFrame([(None, "you vile wretch stinker", "a", "b"), (None, None, "a", "b"), (3, "", "a", "b"), (3, "vile vile vile stinker", None, None)], docs.schema)
    found = scored(docs.unionByName(more), labels, keep=["doc_id", "_margin"], score_col="toxicity", rounds=8, depth=2)
    assert found.columns == ["doc_id", "_margin", "toxicity", "predicted"]
    rows = found.collect()
    assert len(rows) == 244 and all(0 <= r.toxicity <= 1 and r.predicted == (r.toxicity >= 0.5) for r in rows)
    held = {r[0] for r in docs.filter(~learned_from(F.col("doc_id"))).select("doc_id").collect()}
    assert len(held) > 20 and all(r.predicted == (r.doc_id % 4 == 0) for r in rows if r.doc_id in held and r.doc_id != 3)
    assert sorted(r.predicted for r in rows if r.doc_id is None) == [0, 1] and sorted(r.predicted for r in rows if r.doc_id == 3) == [0, 0, 1]
    with pytest.raises(ValueError):
        scored(docs, labels, keep=["score"])


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 12)
    assert {(r.score, r.predicted) for r in scored(docs, labels.limit(0)).collect()} == {(0.0, 0)}
    assert {(r.score, r.predicted) for r in scored(docs, labels.filter("toxic = 1")).collect()} == {(1.0, 1)}
    assert scored(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, labels).filter(~learned_from(F.col("doc_id"))).join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.88 and n.get((0, 1), 0) / n[0, 0] <= 0.01
