"""Keynote panels of pages against plain loops, and how often their steps read a page."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import keynote_pages, keynotes, spatial

WORDS = "page_id int, word_index long, text string, x0 double, x1 double, top double, bottom double"
HELD = ["KEY", "KEYED", "NOTES:", "KEYNOTES:", "key", "1.", "2)", "Provide", "type", "12", None, "", "ä"]


def plan(df):
    return df.select("*")._jdf.queryExecution().optimizedPlan().toString()


def text_of(held):
    lines, last = [], None
    for _, top, x0, k, text in sorted((w[5], w[5], w[3], w[1], w[2]) for w in held):
        if last is None or abs(top - last) > 3:
            lines.append([])
        lines[-1].append((x0, k, text))
        last = top
    return "\n".join(" ".join(t for _, _, t in sorted(line, key=lambda w: w[:2]) if t is not None) for line in lines)


def header_of(held):
    held = sorted(held, key=lambda w: w[1])
    said = lambda w: (w[2] or "").strip().upper()
    for i, w in enumerate(held):
        near = [abs(n[5] - w[5]) < 5 and n[3] - w[4] < 30 for n in held[i + 1 : i + 4]]
        if said(w) in ("KEYNOTES", "KEYNOTES:") or said(w) in ("KEY", "KEYED") and any(all(near[: k + 1]) and "NOTE" in said(n) for k, n in enumerate(held[i + 1 : i + 4])):
            return w[3]


def fits(text):
    return any(re.search(p, text, re.I) for p in keynotes.HEADERS) and re.search(keynote_pages.STRICT_ENTRY, text)


def panel_of(held, x0, y0, x1, y1):
    within = lambda a, d: [w for w in held if w[3] >= a and w[4] <= x1 and w[5] >= y0 and w[6] <= y0 + (y1 - y0) * d]
    header = header_of(held)
    tried = [(k, x0 + (x1 - x0) * a, d) for k, (a, d) in enumerate(keynote_pages.PANELS, 1)]
    if header is not None:
        tried.insert(0, (0, max(x0, header - 30), 0.85))
    for k, left, depth in tried:
        if fits(text := text_of(within(left, depth))):
            return k, text
    return 4, text_of(held)


@pytest.mark.parametrize("views", [False, True])
def test_panels_against_loops(spark, views):
    rng = random.Random(7)
    rows = []
    for page in range(120):
        left = rng.choice([50, 620, 660, 710])
        for k in range(rng.choice([1, 6, 30])):
            x, top = left + 12.0 * rng.randrange(20), 2.0 * rng.randrange(12) + rng.choice([0, 0, 900])
            rows.append((page, k, rng.choice(HELD), x, x + 8, top, top + 8))
        rows += [(page, 100 + k, t, left + 12.0 * k, left + 12.0 * k + 8, 100.0, 108.0) for k, t in enumerate(rng.choice([["KEY", "NOTES:"], ["KEYNOTES"], ["PLAN"]]))]
        rows += [(page, 110 + k, t, left + 12.0 * k, left + 12.0 * k + 8, rng.choice([112.0, 870.0]) + k, 880.0) for k, t in enumerate(["1.", "Provide"])]
    rng.shuffle(rows)
    words = spark.createDataFrame(rows, WORDS).repartition(3)
    pages = spark.createDataFrame([(p, 0.0, 0.0, 1000.0, 1000.0) for p in range(121)], "page_id int, bx0 double, by0 double, bx1 double, by1 double")
    boxes = {"L": (0.0, 0.0, 500.0, 1000.0), "R": (400.0, 0.0, 1000.0, 1000.0), "none": (2000.0, 0.0, 3000.0, 1.0)}
    own = spark.createDataFrame([(p, v, *b) for p in range(0, 121, 2) for v, b in boxes.items()], "page_id int, view string, x0 double, y0 double, x1 double, y1 double") if views else None
    want = {}
    for page in range(120):
        mine = [w for w in rows if w[0] == page]
        for view, (x0, y0, x1, y1) in boxes.items() if views and page % 2 == 0 else [("", (0.0, 0.0, 1000.0, 1000.0))]:
            held = [w for w in mine if view == "" or (w[3] >= x0 and w[4] <= x1 and w[5] >= y0 and w[6] <= y1)]
            if held:
                want[page, view] = panel_of(held, x0, y0, x1, y1)
    got = keynote_pages.region_texts(words, pages, own)
    assert {(r.page_id, r["view"]): (r.region, r.text) for r in got.collect()} == want
    assert len({k for k, _ in want.values()}) >= 4
    assert "Window" not in plan(got) and plan(got).count("collect_list") == 1  # words were sorted and grouped for each rectangle


def test_entries_and_sections_are_read_once(spark):
    text = "KEYNOTES:\n1. Provide a new lamp\nand its whole base\n\n2) Fixture of the wall\n1 - Provide a lamp\n 3. Too short\nOF\n4. Not read"
    words = spark.createDataFrame([(p, 100 * i + k, t, 800.0 + 9 * k, 808.0 + 9 * k, 12.0 * i, 12.0 * i + 8) for p in (1, 2) for i, line in enumerate(text.split("\n")) for k, t in enumerate(line.split(" ")) if t], WORDS)
    pages = spark.createDataFrame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in (1, 2, 3)], "page_id int, bx0 double, by0 double, bx1 double, by1 double")
    found = keynote_pages.sections(words, pages)
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "regexp_extract" in line]  # the filter read each section again
    assert [r.section for r in spark.createDataFrame([(None,), ("",), ("KEY NOTES",)], "t string").select(keynotes.section(F.col("t")).alias("section")).collect()] == [None, None, "KEY NOTES"]
    entries = keynote_pages.entries(found, ["page_id"])
    assert "Window" not in plan(entries)
    want = [("1", "Provide a new lamp and its whole base", 1), ("2", "Fixture of the wall", 2)]
    assert sorted(map(tuple, entries.collect())) == [(p, *w) for p in (1, 2) for w in want]
    assert keynote_pages.entries(found.select("page_id", F.lit("no entry\nat all").alias("section")), ["page_id"]).count() == 0


def test_keynotes_of_a_page_come_from_one_gathering_of_its_words(spark, monkeypatch):
    said = [(0, "KEYNOTES:", 800.0), (100, "1.", 800.0), (101, "Provide", 820.0), (102, "a", 880.0), (103, "lamp", 890.0), (104, "A1", 920.0), (900, "1", 100.0), (901, "1", 600.0)]
    words = spark.createDataFrame([(p, k, t, x, x + 8, 12.0 * (k // 100), 12.0 * (k // 100) + 8) for p in (1, 2) for k, t, x in said], WORDS)
    pages = spark.createDataFrame([(p, 0.0, 0.0, 1000.0, 1000.0) for p in (1, 2)], "page_id int, bx0 double, by0 double, bx1 double, by1 double")
    views = spark.createDataFrame([(2, "L", 0.0, 0.0, 500.0, 1000.0), (2, "R", 500.0, 0.0, 1000.0, 1000.0)], "page_id int, view string, x0 double, y0 double, x1 double, y1 double")
    none = spark.createDataFrame([], "page_id int, ax double, ay double, bx double, by double")
    plans, write = {}, keynote_pages.written
    monkeypatch.setattr(keynote_pages, "written", lambda df, name: (plans.setdefault(name, plan(df)), write(df, name))[1])
    got = keynote_pages.all_keynotes(words, none, pages, views).collect()
    assert sorted((r.page_id, r.number, r.text, r.total, r.counts, r.references) for r in got) == [(1, "1", "Provide a lamp A1", 2, {"": 2}, ["A1"]), (2, "1", "Provide a lamp A1", 2, {"L": 1, "R": 1}, ["A1"])]
    assert "Window" not in plans["entries"] and plans["entries"].count("collect_list") == 1


def test_ends_of_segments_are_not_multiplied(spark):
    left, right = spark.createDataFrame([(1, 1, 29.0, 29.0)], "page int, id int, x double, y double"), spark.createDataFrame([(1, 31.0, 31.0), (1, 20.0, 29.0), (1, 19.0, 29.0), (2, 29.0, 29.0)], "page int, rx double, ry double")
    near = spatial.near_pairs(left, right, 10.0, ["page"])
    made = [line for line in plan(near).splitlines() if "Generate" in line]
    assert len(made) == 1 and not re.search(r"\brx#", made[0])
    assert sorted(r.square for r in near.collect()) == [8.0, 81.0]
