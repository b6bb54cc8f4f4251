"""Steps that must not move, gather or send more than the tables ask for."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import keynote_pages, matching, spatial, tables, viewports
from tallyspark.plans import counting_queries as cq
from tallyspark.sources.written import written

GLYPH = "char_index long, text string, x0 double, x1 double, top double, size double"


def shuffles(df):
    # of a plan that has not run, as one that has shows them twice
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_runs_spell_as_streams_and_move_nothing(spark):
    said = ["the of a", "oft of", "", "x", "of"]
    rows = [(1, [(100 * n + k, c, 6.0 * k, 6.0 * k + 5, 12.0 * n, 9.0) for k, c in enumerate(t)]) for n, t in enumerate(said)]
    runs = spark.createDataFrame(rows, f"page_id int, glyphs array<struct<{GLYPH.replace(' ', ':').replace(',:', ',')}>>")
    found = spatial.spelled_in_runs(runs, ["of", "the", "a"])
    assert shuffles(found) == 0
    stream = spatial.spelled(runs.select("page_id", F.inline("glyphs")), ["of", "the", "a"])
    assert sorted(found.collect()) == sorted(stream.collect()) and found.count() == 5
    assert spatial.spelled_in_runs(runs.limit(0), ["of"]).count() == 0


def test_glyphs_never_go_through_the_driver(spark, tmp_path):
    # a table of few bytes may be many glyphs: Spark's estimate is that of the file
    text = "a de the of wonderful a " * 20
    spark.createDataFrame([(c, t, "user", text) for c in range(6) for t in range(1, 4)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    runs, stretches = cq.plan_runs(spark, str(tmp_path)), cq.plan_stretches(spark, str(tmp_path))
    glyphs = runs.select("page_id", F.inline("glyphs"))
    spelled = spatial.spelled_in_runs(runs, ["a"])
    few = spatial.isolated(spelled, stretches)
    assert "BroadcastExchange" not in few._jdf.queryExecution().executedPlan().toString()
    want = spatial.isolated(spelled, glyphs)
    assert "BroadcastExchange" not in want._jdf.queryExecution().executedPlan().toString()
    assert 0 < want.count() < spelled.count() and sorted(few.collect()) == sorted(want.collect())
    assert stretches.count() * 2 < glyphs.count()


def test_a_match_in_a_stretch_of_two_is_not_alone(spark):
    matches = spark.createDataFrame([(1, "a", 0.0, 5.0, 0.0, 1), (1, "a", 100.0, 105.0, 0.0, 5), (1, "a", 200.0, 205.0, 0.0, 9)], "page_id int, code string, x0 double, x1 double, top double, char_index long")
    stretches = spark.createDataFrame([(1, 1, 2, 0.0, 25.0, 0.0), (1, 5, 5, 100.0, 105.0, 0.0), (1, 9, 9, 200.0, 205.0, 0.0), (1, 11, 30, 219.0, 400.0, 6.0)], "page_id int, char_index long, last_index long, x0 double, x1 double, top double")
    assert [r.char_index for r in spatial.isolated(matches, stretches).collect()] == [5]


def test_positions_spell_once(spark, tmp_path, monkeypatch):
    from tallyspark.operators import counting

    spark.createDataFrame([(c, t, "user", "a de the of see of a") for c in range(6) for t in range(1, 4)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plans = []
    write = lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), written(df, name))[1]
    monkeypatch.setattr(counting, "written", write)
    monkeypatch.setattr(spatial, "written", write)
    found = cq.plan_positions(spark, str(tmp_path))
    assert sum("_before" in p for p in plans) == 1 and found.filter("not user_added").count() > 0


def test_near_pairs_send_no_side_whole(spark):
    left, right = spark.createDataFrame([(1, 1, 0.0, 0.0)], "page int, id int, x double, y double"), spark.createDataFrame([(1, 3.0, 4.0)], "page int, rx double, ry double")
    near = spatial.near_pairs(left, right, 10.0, ["page"])
    assert "BroadcastExchange" not in near._jdf.queryExecution().executedPlan().toString() and [r.square for r in near.collect()] == [25.0]


def test_a_point_goes_to_few_cells(spark):
    points = spark.range(900).select((F.col("id") % 30 * 1.0).alias("rx"), F.floor(F.col("id") / 30).cast("double").alias("ry"))
    assert points.select(F.avg(F.size(spatial.cells_around(F.col("rx"), F.col("ry"), 10.0, 30.0)))).first()[0] <= 4


def test_a_heading_holds_no_table_of_all_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Mark"), (1, 0, 1, "Volts"), (1, 1, 0, "Type"), (1, 1, 1, "Description"), (1, 2, 0, "A1"), (1, 2, 1, "lamp")], "table_id int, row_idx int, col_idx int, text string")
    heads = tables.header_rows(cells)
    assert [tuple(r) for r in heads.collect()] == [(1, 0, 6)] and shuffles(heads) == 1
    assert [tuple(r) for r in tables.records(cells, heads, ["code", "voltage"]).filter("row_idx = 2").collect()] == [(1, 2, "A1", "lamp")]


def test_references_gather_no_pairs(spark):
    messages = spark.createDataFrame([(1, "see 7 and E7"), (1, "E7"), (2, "E8")], "id int, text string")
    pages = spark.createDataFrame([(7, "E7"), (8, "e7"), (9, None)], "page_id int, code string")
    found = matching.page_references(messages, pages, "id", r"\b(E?[0-9]+)\b")
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


@pytest.mark.parametrize("views", [False, True])
def test_pages_move_once(spark, views):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        words = spark.createDataFrame([(1, 1, "KEYNOTES:", 800.0, 808.0, 0.0, 8.0), (1, 2, "1.", 800.0, 808.0, 12.0, 20.0), (1, 3, "Provide", 810.0, 818.0, 12.0, 20.0)], "page_id int, word_index long, text string, x0 double, x1 double, top double, bottom double")
        pages = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], "page_id int, bx0 double, by0 double, bx1 double, by1 double")
        own = pages.select("page_id", F.lit("L").alias("view"), *[F.col(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]) if views else None
        text = keynote_pages.region_texts(words, pages, own)
        assert [(r.region, r.text) for r in text.collect()] == [(0, "KEYNOTES:\n1. Provide")]
        assert shuffles(text) == 2 + views  # words, and boxes and views of pages
        titles = viewports.split_pages(viewports.cropped_titles(words, "page_id", 1000.0, 1000.0), "page_id", 1000.0, 1000.0)
        assert shuffles(viewports.boxes_of_titles(titles, "page_id", 1000.0, 1000.0)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
