from tallyspark.operators import viewports, workbooks

CELLS = "workbook string, sheet string, row_idx int, col_idx int, text string"


def cells_of(spark, books):
    return spark.createDataFrame([(b, s, r, c, t) for b, sheets in books.items() for s, rows in sheets.items() for r, row in enumerate(rows) for c, t in enumerate(row)], CELLS)


def test_seeded_dashboard(spark):
    books = {
        "Hall (12)_inventory": {
            workbooks.FIXTURES: [["Type", " Voltage", "E1", "E2", "Total", "E9"], ["A1", "277 ", "2", None, "2", "7"], ["B", None, "1.0", "x", "4", ""], ["", "stop"], ["C", "after", "1", "1", "1", ""]],
            workbooks.KEYNOTES: [["Keynote #", "Keynote Text", "E1", "Total"], ["1", " text ", "2", "2"], ["2", None, None, None]],
            workbooks.QUALITY: [["QA"], ["Overall Confidence", "95.5%"], ["Warnings", ""]],
        },
        "Empty": {workbooks.FIXTURES: [["Type", "Total"], ["#", "1"]]},
    }
    cells = cells_of(spark, books)
    assert sorted((r.code, r.voltage, r.total) for r in workbooks.fixtures(cells).collect()) == [("A1", "277", 2), ("B", "", 4)]
    assert sorted((r.row_idx, r.plan, r.n) for r in workbooks.fixture_counts(cells).collect()) == [(1, "E1", 2), (1, "E2", 0), (2, "E1", 1), (2, "E2", 0)]
    assert sorted((r.number, r.text, r.total) for r in workbooks.keynotes(cells).collect()) == [("1", "text", 2), ("2", "", 0)]
    assert sorted(tuple(r) for r in workbooks.dashboard_index(cells).collect()) == [("Empty", "Empty", 0, 0, 0, 0, None, None), ("Hall (12)_inventory", "Hall", 2, 6, 2, 2, 0.955, True)]
    assert workbooks.dashboard_index(cells.limit(0)).count() == 0


def test_titles_are_read_from_cropped_words(spark):
    words = [(1, 0, "NOTE", 655.0, 690.0), (1, 1, "LIGHTING", 560.0, 600.0), (1, 2, "PLAN", 605.0, 640.0), (1, 3, "AREA", 642.0, 655.0)]
    df = spark.createDataFrame([(p, k, t, a, b, 500.0, 510.0) for p, k, t, a, b in words], "page_id int, word_index int, text string, x0 double, x1 double, top double, bottom double")
    assert [(r.region, r.text) for r in viewports.cropped_titles(df, "page_id", 1000.0, 1000.0).collect()] == [("whole", "LIGHTING PLAN")]
    assert [r.text for r in viewports.titles_of_words(df, "page_id", 1000.0).collect()] == ["LIGHTING PLAN AREA NOTE"]


def test_no_join_passes_the_driver(spark):
    """Headings, ends and figures grow with the workbooks: no join sends them to every executor."""
    cells = spark.range(40).selectExpr("concat('B', id div 4) AS workbook", "'Fixture Inventory' AS sheet", "cast(id % 2 AS int) AS row_idx", "cast(id div 2 % 2 AS int) AS col_idx", "'Type' AS text")
    for df in (workbooks.fixtures(cells), workbooks.fixture_counts(cells), workbooks.dashboard_index(cells)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
