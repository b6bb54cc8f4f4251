from pyspark.sql import functions as F

from tallyspark.operators import corrections, keynotes, spatial, tables, viewports


def test_section_ends_where_entries_do(spark):
    texts = [
        "x\nKEY NOTES:\n\n1. First\nsee the other sheet\nab\n\n2. Lost",
        "KEYNOTES\n1) One\n3/16\" = 1'-0\"\n2) Two",
        "Keyed notes\nintro\nintro\n5 - Entry\nOF\nmore",
        "no header",
        None,
        "",
    ]
    got = [r.s for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(keynotes.section(F.col("t")).alias("s")).collect()]
    assert got == ["KEY NOTES:\n1. First\nsee the other sheet", "KEYNOTES\n1) One", "Keyed notes\n5 - Entry", None, None, None]


def test_header_within_three_words_of_its_line(spark):
    rows = [(1, 0, "KEYED", 0.0, 8.0, 5), (1, 1, "SHEET", 10.0, 18.0, 5), (1, 2, "NOTES", 20.0, 28.0, 5), (2, 0, "KEY", 0.0, 8.0, 5), (2, 1, "NOTES", 10.0, 18.0, 50), (3, 0, "a", 0.0, 8.0, 5), (3, 1, "keynotes:", 40.0, 48.0, 9)]
    words = spark.createDataFrame(rows, "page_id int, word_index int, text string, x0 double, x1 double, top int")
    assert sorted(tuple(r) for r in keynotes.header_x(words, "page_id").collect()) == [(1, 0.0), (3, 40.0)]


def test_viewports_in_a_band_and_in_a_grid(spark):
    schema = "page int, text string, cx double, cy double, lighting boolean"
    rows = [(1, "Lighting Plan A", 100.0, 900.0, True), (1, "Lighting Plan B", 300.0, 900.0, True), (1, "Power Plan", 500.0, 900.0, False)]
    rows += [(2, "Lighting Plan Level 1", 100.0, 300.0, True), (2, "Lighting Plan Level 2", 300.0, 700.0, True), (2, "Power Plan Level 1", 40.0, 310.0, False)]
    rows += [(3, "Lighting Plan A", 100.0, 900.0, True), (3, "Lighting Plan B", 130.0, 900.0, True), (4, "Lighting Plan A", 100.0, 900.0, True)]
    titles = viewports.split_pages(spark.createDataFrame(rows, schema), "page", 1000.0, 1000.0)
    got = sorted(tuple(r) for r in viewports.boxes_of_titles(titles, "page", 1000.0, 1000.0).collect())
    assert got == [(1, "Lighting Plan A", 0.0, 0.0, 200.0, 1000.0), (1, "Lighting Plan B", 200.0, 0.0, 400.0, 1000.0), (2, "Lighting Plan Level 1", 70.0, 0.0, 1000.0, 502.5), (2, "Lighting Plan Level 2", 0.0, 502.5, 1000.0, 1000.0)]


def test_keynote_events_in_order(spark):
    schema = "source_key string, seq int, action string, code string, number string, text string, sheet string, n long"
    rows = [("a", 1, "keynote_add", "", "3", "t", "S1", 2), ("a", 2, "keynote_add", "", "3", "u", "S1", 4), ("a", 3, "keynote_remove", "KN-7", "", "", "", 0), ("a", 4, "keynote_remove", "KN-3", None, "", "", 0), ("a", 5, "keynote_add", "", "3", "v", "S2", 1), ("a", 6, "keynote_add", "", "", "none", "S2", 1)]
    hints = keynotes.folded(spark.createDataFrame(rows, schema))
    assert sorted((r.number, r.removed, r.text, r.counts) for r in hints.collect()) == [("3", False, "v", {"S2": 1}), ("7", True, None, {})]
    base = spark.createDataFrame([("a", "3", "S1", 9), ("a", "7", "S1", 9), ("a", "8", "S1", 9)], "source_key string, number string, plan string, n long")
    given = spark.createDataFrame([("a", "8", "S1", 1), ("a", "8", "S9", 5)], base.schema)
    assert sorted(tuple(r) for r in keynotes.corrected(base, hints, given).collect()) == [("a", "3", "S1", 9), ("a", "3", "S2", 1), ("a", "8", "S1", 1)]


def test_headings_with_values(spark):
    rows = [("MARK A", "code"), ("MARK\nB2", "code"), ("Fixture Type", "code"), ("ID 7", "code"), ("Voltage", "voltage"), ("Rated Lumen Output 900", "lumens"), ("x", "code")]
    got = [r.v for r in spark.createDataFrame(rows, "t string, f string").coalesce(1).select(tables.embedded_value(F.col("t"), F.col("f")).alias("v")).collect()]
    assert got == ["A", "B2", None, "7", None, "900", None]


def test_patches_and_spelling(spark):
    fixtures = spark.createDataFrame([("s", "A1", "277", None), ("s", "B1", "120", "900")], "source_key string, code string, voltage string, lumens string")
    hints = spark.createDataFrame([("s", "update_spec", "A1", "lumens", "500"), ("s", "update_spec", "A1", "nothing", "x"), ("t", "update_spec", "B1", "voltage", "1")], "source_key string, action string, fixture_code string, place string, value string")
    assert sorted(tuple(r) for r in corrections.apply_spec_patches(fixtures, hints, ["voltage", "lumens"]).collect()) == [("s", "A1", "277", "500"), ("s", "B1", "120", "900")]
    glyphs = spark.createDataFrame([(1, k, c, k * 6.0, k * 6.0 + 5, 0.0, 9.0) for k, c in enumerate("A1 A12 xA1 A1")], "page_id int, char_index int, text string, x0 double, x1 double, top double, size double")
    assert sorted(r.char_index for r in spatial.spelled(glyphs, ["A1", "A"]).collect()) == [0, 11]
