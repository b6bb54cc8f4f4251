from pyspark.sql import functions as F

from tallyspark.operators import matching, similarity, spatial


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_codes_against_plan_codes(spark):
    fx = spark.createDataFrame([(1, "A1", ""), (2, "A-2", ""), (3, "W2", ""), (4, "WL1", "with BATTERY BACKUP"), (5, "B1", ""), (6, "Z9", "")], "id int, code string, description string")
    plan = spark.createDataFrame([("AL1",), ("A2",), ("WL2",), ("WL1",), ("WL1E",), ("BL1",), ("BK1",)], "code string")
    assert [(r.id, r.new_code) for r in matching.corrected_codes(fx, plan).orderBy("id").collect()] == [(1, "AL1"), (2, "A2"), (3, "WL2"), (4, "WL1E"), (5, "B1"), (6, "Z9")]


def test_sources(spark):
    names = spark.createDataFrame([("School A plans",), ("schoola",), ("other",), ("ab",)], "name string")
    known = spark.createDataFrame([("School A", 1), ("School A plans 2", 2), ("AB", 3)], "source string, ord int")
    assert rows(matching.resolved_source(names, known)) == [("School A plans", "School A"), ("ab", "AB"), ("other", None), ("schoola", "School A")]


def test_page_references(spark):
    messages = spark.createDataFrame([(1, "see e200 and page 3, again E200")], "id int, text string")
    pages = spark.createDataFrame([(2, "E200"), (3, "E300")], "page_id int, code string")
    assert rows(matching.page_references(messages, pages, "id", r"(?i)\b(E?[0-9]+)\b")) == [(1, 2), (1, 3)]


def test_keynote_counts(spark):
    a = spark.createDataFrame([("P", "1", 0), ("P", "2", 3)], "plan string, number string, n int")
    b = spark.createDataFrame([("P", "1", 4), ("P", "2", 9), ("Q", "1", 0)], "plan string, number string, n int")
    assert rows(matching.preferred_counts(a, b)) == [("P", "1", 4), ("P", "2", 3), ("Q", "1", 0)]
    assert rows(matching.synced_counts(a, b)) == [("1", "P", 4), ("2", "P", 9)]


def test_outline(spark):
    n = spark.createDataFrame([(1, 1, 0.0, 0.0)], "page int, id int, x double, y double")
    box = [(1, -5.0, -5.0, 5.0, -5.0), (1, 5.0, -5.0, 5.0, 5.0), (1, 5.0, 5.0, -5.0, 5.0), (1, -5.0, 5.0, -5.0, -5.0), (1, 0.0, 0.0, 50.0, 0.0)]
    s = spark.createDataFrame(box, "page int, ax double, ay double, bx double, by double")
    assert rows(spatial.polygon_quality(n, s, ["page"], "id")) == [(1, 1, 4, 4, 0.0)]


def test_words_left_of_a_match(spark):
    m = spark.createDataFrame([(1, 100.0, 50.0), (1, 300.0, 50.0)], "page int, x double, y double")
    w = spark.createDataFrame([(1, 60.0, 55.0, "SEE:"), (1, 280.0, 50.0, "other")], "page int, x double, y double, text string")
    assert rows(spatial.near_words(m, w, "page", ["see"])) == [(1, 100.0, 50.0)]


def test_nearest(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0], k % 2) for k in range(40)], "vec_id int, embedding array<float>, label int")
    found = similarity.nearest(v, v.filter("vec_id in (0, 10)"), k=2, block=1)
    assert rows(found) == [(0, 1, 1.0, 1), (0, 2, 2.0, 2), (10, 11, 1.0, 2), (10, 9, 1.0, 1)]
    same = similarity.nearest(v, v.filter("vec_id = 10"), k=2, filter_col="label")
    assert [r.vec_id for r in same.orderBy("rank").collect()] == [8, 12]


def test_bounds_and_neighbours(spark):
    t = spark.createDataFrame([(1, "a", 500.0), (1, "b", 1000.0), (1, "c", 1500.0)], "page int, label string, cx double")
    assert rows(spatial.bounds_between(t, "page")) == [(1, "a", 0.0, 750.0), (1, "b", 750.0, 1250.0), (1, "c", 1250.0, None)]
    p = t.select("page", F.col("label").alias("plan"), "cx")
    assert [(r.previous, r.next) for r in matching.neighbours(p, "page", "cx").orderBy("cx").collect()] == [("c", "b"), ("a", "c"), ("b", "a")]
    moved = spatial.rebased(spark.createDataFrame([(-1000.0, 5.0)], "x0 double, top double"), F.lit(-1224.0), F.lit(0.0))
    assert rows(moved) == [(224.0, 5.0)]


def test_reports(spark):
    from tallyspark.operators import reports

    items = spark.createDataFrame([("g", f"c{k:02d}", k / 100) for k in range(13)] + [("h", "x", 0.5)], "g string, code string, confidence double")
    lines = rows(reports.report_lines(items, "g"))
    assert ("g", 1, "c00: 0%") in lines and ("g", 11, "... and 3 more") in lines and ("h", 1, "x: 50%") in lines and len(lines) == 12
    none = spark.createDataFrame([], "sheet_code string, sheet_title string, page_type string")
    assert rows(reports.verify_pages(none, False)) == [("no_pages", "error", 1.0)]
    pages = spark.createDataFrame([("E1", "DEMO", "lighting_plan"), ("E1", None, "lighting_plan"), ("E5", "", "schedule"), (None, None, "strange")], "sheet_code string, sheet_title string, page_type string")
    assert rows(reports.verify_pages(pages, True)) == [("duplicate_sheet_codes", "warning", 0.05), ("invalid_page_types", "error", 0.15), ("possible_misclassification", "warning", 0.1)]
