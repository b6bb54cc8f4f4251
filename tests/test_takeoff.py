"""A whole take-off of a small drawing set, and partial reruns against full ones."""

import pytest
from test_counting import GLYPHS, glyph_rows
from test_pages_and_tables import PANEL, WORDS, square, words_of

from tallyspark.plans.takeoff import Takeoff


@pytest.fixture(scope="module")
def inputs(spark):
    sheets = [(1, 1, "E000", "Cover", ""), (2, 2, "E600", "Light fixture schedule", ""), (3, 3, "E200", "Lighting plan level 1", ""), (4, 4, "E201", "Roof", "")]
    cells = {
        (1, 10): [["Sheet No", "Title"], ["E200", "Lighting plan level 1"], ["E201", "Lighting plan roof"], ["E600", "Schedules"]],
        (2, 20): [["Light fixture schedule", "", ""], ["Mark", "Description", "Voltage"], ["A1", "Recessed troffer", "277"], ["B2", "Wall light", ""], ["NOTES", "x", ""]],
        (2, 21): [["Fixture schedule", ""], ["C3 1", "Recessed downlight of six inches", "120"], ["A1", "x", ""]],
        (3, 30): [["Mark", "Lamp", "Voltage"], ["", "b", "c"]],
    }
    placed = [(3, "A1", 100, 100), (3, "A1", 600, 100), (3, "B2", 100, 300), (3, "A1", 310, 510), (4, "A1", 100, 100), (4, "C3", 200, 200), (2, "A1", 500, 500)]
    words = words_of(4, PANEL, 720.0, top=20.0) + [(4, 5000, "1", 97.0, 103.0, 396.0, 404.0)]
    frame = spark.createDataFrame
    return {
        "sheets": frame(sheets, "page_id long, page_number int, code string, title string, content string"),
        "cells": frame([(p, t, r, c, x) for (p, t), rows in cells.items() for r, row in enumerate(rows) for c, x in enumerate(row)], "page_id long, table_id int, row_idx int, col_idx int, text string"),
        "boxes": frame([(3, 30, 300, 500, 400, 560)], "page_id long, table_id int, x0 int, y0 int, x1 int, y1 int"),
        "glyphs": frame(glyph_rows([(p, w, float(x), float(y), 10.0) for p, w, x, y in placed]), GLYPHS.replace("page_id int", "page_id long")),
        "words": frame(words, WORDS.replace("page_id int", "page_id long")),
        "segments": frame([(p, *map(float, s)) for p, *s in square(4, 100, 400, 4)], "page_id long, ax double, ay double, bx double, by double"),
        "pages": frame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in range(1, 5)], "page_id long, bx0 double, by0 double, bx1 double, by1 double"),
        "views": frame([(3, "L", 0, 0, 500, 1000), (3, "R", 500, 0, 1000, 1000)], "page_id long, view string, x0 int, y0 int, x1 int, y1 int"),
    }


def held(takeoff, versions):
    return {t: sorted(map(str, takeoff.table(t, versions).collect())) for t in versions}


@pytest.fixture(scope="module")
def first(spark, inputs, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('takeoff')}"
    takeoff = Takeoff(spark, root, inputs)
    return root, takeoff, takeoff.run(1)


def test_whole_run(first):
    _, takeoff, versions = first
    assert {r.code: r.page_type for r in takeoff.table("page_types", versions).collect()}["E201"] == "lighting_plan"  # from the index
    assert {r.code: (r.description, r.voltage) for r in takeoff.table("fixtures", versions).collect()} == {"A1": ("Recessed troffer", "277"), "B2": ("Wall light", ""), "C3": ("Recessed downlight of six inches", "120")}
    got = {(r.plan, r.code): r.n for r in takeoff.table("counts", versions).collect()}
    assert got == {("E200-L", "A1"): 1, ("E200-L", "B2"): 1, ("E200-L", "C3"): 0, ("E200-R", "A1"): 1, ("E200-R", "B2"): 0, ("E200-R", "C3"): 0, ("E201", "A1"): 1, ("E201", "B2"): 0, ("E201", "C3"): 1}
    assert {(r.page_id, r.number): r.total for r in takeoff.table("keynotes", versions).collect()} == {(4, "1"): 1, (4, "2"): 0}
    row = takeoff.table("quality", versions).first()
    assert (row.fixture_types, row.total_fixtures, row.lighting_plans, row.keynotes) == (3, 5, 2, 2) and 0.8 < row.overall_confidence < 1


@pytest.mark.parametrize(
    "events, again",
    [
        ([("remove", "B2", None, None, None, None), ("add", "X9", None, None, None, None), ("count_override", "A1", "E200-L", None, "7", None)], {"fixtures", "positions", "counts", "quality"}),
    ],
)
def test_partial_reruns_equal_full_ones(spark, inputs, first, events, again):
    root, _, before = first
    changes = spark.createDataFrame([(k, *e) for k, e in enumerate(events)], "seq long, action string, fixture_code string, sheet string, field string, value string, page_type string")
    takeoff = Takeoff(spark, root, inputs, changes)
    assert takeoff.stale() == again
    partly, whole = takeoff.run(2, before), takeoff.run(3)
    assert {t for t, v in partly.items() if v == 2} == again
    assert held(takeoff, partly) == held(takeoff, whole) != held(takeoff, before)


def test_stale_tables(spark, inputs):
    event = lambda *e: Takeoff(spark, "file:///none", inputs, spark.createDataFrame([(1, *e)], "seq long, action string, fixture_code string")).stale()
    assert event("reclassify_page", "4") == {"page_types", "fixtures", "positions", "counts", "keynotes", "quality"}
    assert event("keynote_count_override", "1") == {"keynotes", "quality"}
    assert event("update_spec", "A1") == {"fixtures", "quality"}
    assert Takeoff(spark, "file:///none", inputs).stale() == {"quality"}
