"""Counting on plans, the greedy distance rule in rounds, added positions."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import counting
from tallyspark.operators.apart import apart, with_added


def greedy(rows, distance):
    """rows: (order, x, y) of one group; the orders that stand."""
    kept = []
    for o, x, y in sorted(rows):
        if all((x - a) ** 2 + (y - b) ** 2 >= distance * distance for _, a, b in kept):
            kept.append((o, x, y))
    return [k[0] for k in kept]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rule_against_one_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(g, k, rng.uniform(-400, 400), rng.uniform(-400, 400)) for g in ("a", "b", None) for k in range(120)]
    rows += [("a", 1000 + k, 7.0 + k / 1000, 7.0) for k in range(300)]  # a crowd in one cell
    rows += [("c", k, 10.0 * k, 0.0) for k in range(60)]  # each decision hangs on the one before
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, x double, y double").repartition(3)
    got = sorted(((r.g, r.n) for r in apart(df, ["g"], ["y", "x", "n"], 70.0, few=(20_000, 100, 30)[seed]).collect()), key=str)
    want = sorted(((g, o[2]) for g in {r[0] for r in rows} for o in greedy([((y, x, n), x, y) for h, n, x, y in rows if h == g], 70.0)), key=str)
    assert got == want


def test_greedy_rule_borders(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 70.0, 0.0), (3, 69.999, 0.1), (4, None, 1.0), (5, float("nan"), 1.0), (6, None, None)], "n int, x double, y double")
    assert sorted(r.n for r in apart(df, [], ["n"], 70.0).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r.n for r in apart(df, [], ["n"], 70.0, few=0).collect()) == [1, 2, 4, 5, 6]
    assert apart(df.limit(0), [], ["n"], 70.0).count() == 0


def test_added_positions(spark):
    found = spark.createDataFrame([("p", 0.0, 0.0)], "page string, x double, y double")
    added = spark.createDataFrame([("p", 1, 10.0, 0.0), ("p", 2, 30.0, 0.0), ("p", 3, 40.0, 0.0), ("p", 4, 45.0, 0.0), ("q", 5, 10.0, 0.0)], "page string, seq int, x double, y double")
    assert sorted(r.seq for r in with_added(found, added, ["page"], "seq", 15.0).collect()) == [2, 4, 5]
    assert sorted(r.seq for r in with_added(found.limit(0), added, ["page"], "seq", 15.0).collect()) == [1, 2, 4, 5]


def glyph_rows(placed):
    rows, at = [], 0
    for page, word, x, y, size in placed:
        for c in word:
            rows.append((page, at, c, x, x + 5.0, y, y + 8.0, size))
            x, at = x + 6.0, at + 1
        at += 1
    return rows


GLYPHS = "page_id int, char_index long, text string, x0 double, x1 double, top double, bottom double, size double"


def test_counts_from_glyphs_to_views(spark):
    placed = [
        (1, "A1", 100, 100, 10.0), (1, "A1", 600, 100, 10.0), (1, "A1", 500, 300, 10.0),  # left, right, in both
        (1, "A1", 900, 100, 10.0), (1, "A1", 5, 100, 10.0), (1, "A1", 200, 500, 30.0),  # legend, border, too large
        (1, "B", 100, 200, 10.0), (1, "B", 130, 200, 10.0), (1, "B", 300, 200, 10.0), (1, "x", 312, 200, 10.0), (1, "BA1", 400, 600, 10.0),  # near the first, not alone, part of a word
        (1, "E2", 300, 700, 10.0), (1, "E2", 100, 740, 10.0),
        (2, "A1", 100, 100, 10.0), (2, "A1", 400, 400, 10.0),
    ]
    glyphs = spark.createDataFrame(glyph_rows([(p, w, float(x), float(y), s) for p, w, x, y, s in placed]), GLYPHS)
    pages = spark.createDataFrame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in (1, 2, 3)], "page_id int, bx0 double, by0 double, bx1 double, by1 double")
    views = spark.createDataFrame([(1, "L", 0, 0, 550, 1000), (1, "R", 450, 0, 1000, 1000)], "page_id int, view string, x0 int, y0 int, x1 int, y1 int")
    words = spark.createDataFrame([(1, "(See", 270.0, 290.0, 700.0, 708.0), (1, "see", 100.0, 120.0, 900.0, 908.0)], "page_id int, text string, x0 double, x1 double, top double, bottom double")
    schedules = spark.createDataFrame([(2, 395.0, 395.0, 420.0, 420.0)], "page_id int, sx0 double, sy0 double, sx1 double, sy1 double")
    codes = ["A1", "B", "E2"]
    found = counting.positions(glyphs, pages, codes, views, schedules, words, ["e2"])
    got = {(r.page_id, r["view"], r.code): r.n for r in counting.counts(found, pages, codes, views).collect()}
    assert got == {(1, "L", "A1"): 2, (1, "L", "B"): 1, (1, "L", "E2"): 1, (1, "R", "A1"): 2, (1, "R", "B"): 0, (1, "R", "E2"): 0, (2, "", "A1"): 1, (2, "", "B"): 0, (2, "", "E2"): 0, (3, "", "A1"): 0, (3, "", "B"): 0, (3, "", "E2"): 0}
    rejected = spark.createDataFrame([(1, "L", "A1", 110.0, 104.0), (2, None, "B", 105.0, 104.0)], "page_id int, view string, code string, cx double, cy double")
    added = spark.createDataFrame([(2, None, "A1", 1, 105.0, 104.0), (2, None, "A1", 2, 205.0, 104.0), (2, None, "A1", 3, 210.0, 104.0), (2, "none", "A1", 4, 800.0, 104.0), (2, None, "Z", 5, 1.0, 1.0)], "page_id int, view string, code string, seq int, cx double, cy double")
    found = counting.positions(glyphs, pages, codes, views, schedules, words, ["e2"], rejected, added)
    got = {(r.page_id, r["view"], r.code): r.n for r in counting.counts(found, pages, codes, views).filter("n > 0").collect()}
    assert got == {(1, "L", "A1"): 1, (1, "L", "B"): 1, (1, "L", "E2"): 1, (1, "R", "A1"): 2, (2, "", "A1"): 2}
    assert [(r.cx, r.char_index, r.size) for r in found.filter("user_added").collect()] == [(205.0, -1, 0.0)]


def test_usual_size_prefers_the_first_of_equals(spark):
    rows = [(1, "", "B", 1, 9.0, 5), (1, "", "A", 0, 20.0, 7)]
    df = spark.createDataFrame(rows, "page_id int, view string, code string, code_at int, size double, char_index long")
    assert [r.code for r in counting.of_usual_size(df, counting.Settings()).collect()] == ["A"]
    assert counting.views_of(df.select("page_id", *[F.lit(1.0).alias(c) for c in ("bx0", "by0", "bx1", "by1")]).limit(1), None).count() == 1
