"""Keynote panels and symbols, tables without headings, sheet indexes, schedules on plans."""

from tallyspark.operators import keynote_pages, table_roles

WORDS = "page_id int, word_index long, text string, x0 double, x1 double, top double, bottom double"
PAGES = "page_id int, bx0 double, by0 double, bx1 double, by1 double"


def words_of(page, lines, x, start=0, top=0.0):
    out = []
    for n, line in enumerate(lines):
        at = x
        for k, w in enumerate(line.split(" ")):
            out.append((page, start + n * 100 + k, w, at, at + 5.0 * len(w), top + 12.0 * n, top + 12.0 * n + 8))
            at += 5.0 * len(w) + 5
    return out


PANEL = ["KEY NOTES:", "1. Provide a new fixture here", "2. Connect to B12 and A1 again"]


def test_regions(spark):
    rows = words_of(1, PANEL, 500.0) + [(1, 9000, "E201", 30.0, 60.0, 12.0, 20.0)]
    rows += words_of(2, ["KEYED", "NOTES:", *PANEL[1:]], 710.0) + words_of(3, ["KEYED", "NOTES:", *PANEL[1:]], 655.0) + words_of(4, ["KEYED", "NOTES:", *PANEL[1:]], 10.0) + words_of(5, ["no notes"], 10.0)
    df = spark.createDataFrame(rows, WORDS)
    pages = spark.createDataFrame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in range(1, 7)], PAGES)
    got = {r.page_id: (r.region, r.text) for r in keynote_pages.region_texts(df, pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1, 3: 2, 4: 4, 5: 4}
    assert got[1][1] == "\n".join(PANEL) and got[5][1] == "no notes"
    views = spark.createDataFrame([(1, "L", 0, 0, 300, 1000), (1, "R", 400, 0, 1000, 1000)], "page_id int, view string, x0 int, y0 int, x1 int, y1 int")
    found = {(r.page_id, r["view"]): r.section for r in keynote_pages.sections(df, pages, views).collect()}
    assert found[1, "L"] == found[1, "R"] == "\n".join(PANEL)  # the left view takes the page's panel
    assert (5, "") not in found


def test_entries(spark):
    text = "KEY NOTES:\n1. Short\n2. A text that is long enough\ngoes on\n21. Number of a general note\n2. A text that is long enough to win here\n3 - Another text of some length"
    df = spark.createDataFrame([(1, text), (2, "no entry")], "page_id int, section string")
    assert sorted(tuple(r) for r in keynote_pages.entries(df, ["page_id"]).collect()) == [(1, "2", "A text that is long enough to win here", 2), (1, "3", "Another text of some length", 5)]


def square(page, x, y, sides, r=5.0):
    return [(page, x + a, y + b, x + c, y + d) for a, b, c, d in ((-r, -r, r, -r), (r, -r, r, r), (r, r, -r, r), (-r, r, -r, -r))[:sides]]


def test_symbols_and_all_keynotes(spark):
    number = lambda page, k, t, x, y, h=8.0: (page, 50_000 + k, t, x - 3, x + 3, y - h / 2, y + h / 2)
    rows = words_of(1, PANEL, 750.0) + words_of(2, PANEL, 750.0)
    rows += [number(1, 1, "1", 100, 300), number(1, 2, "1", 400, 300), number(1, 3, "2", 100, 500), number(1, 4, "2", 200, 500, 12.0), number(1, 5, "1", 300, 300), number(1, 6, "7", 300, 500)]
    rows += [number(2, 1, "1", 100, 300), number(2, 2, "2", 100, 950)]
    segs = square(1, 100, 300, 4) + square(1, 400, 300, 3) + square(1, 100, 500, 2) + square(1, 200, 500, 4, 6.0) + square(1, 300, 300, 1)
    df = spark.createDataFrame([tuple(float(v) if k > 2 else v for k, v in enumerate(r)) for r in rows], WORDS)
    segments = spark.createDataFrame([(p, *map(float, s)) for p, *s in segs], "page_id int, ax double, ay double, bx double, by double")
    pages = spark.createDataFrame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in (1, 2, 3)], PAGES)
    views = spark.createDataFrame([(1, "L", 0, 0, 300, 1000), (1, "R", 250, 0, 1000, 1000)], "page_id int, view string, x0 int, y0 int, x1 int, y1 int")
    got = {(r.page_id, r.number): (r.total, r.counts, r.references) for r in keynote_pages.all_keynotes(df, segments, pages, views).collect()}
    # page 1: the number in a half-open square counts for its three sides, the larger one not; page 2 has no outline
    assert got[1, "1"] == (2, {"L": 1, "R": 1}, []) and got[1, "2"] == (1, {"L": 1, "R": 0}, ["B12", "A1"])
    assert got[2, "1"] == (1, {"": 1}, []) and got[2, "2"][0] == 0 and len(got) == 4


def test_dense_pages_trust_polygons(spark):
    number = lambda k, x, h: (1, k, "1", x - 3.0, x + 3.0, 300.0 - h / 2, 300.0 + h / 2)
    df = spark.createDataFrame([number(1, 100.0, 8.0), number(2, 200.0, 8.0), *(number(3 + k, 300.0 + 50 * k, 12.0) for k in range(3))], WORDS)
    wires = [(1, x + a, 300.0 + b, x + a + 40.0 * c, 300.0 + b + 30.0) for x in (300.0, 350.0, 400.0) for a, b, c in ((5.0, -5.0, 1), (5.0, 5.0, 1), (-5.0, 5.0, -1), (-5.0, -5.0, -1))]
    segments = spark.createDataFrame([(p, *map(float, s)) for p, *s in square(1, 100, 300, 4) + square(1, 200, 300, 4)] + wires, "page_id int, ax double, ay double, bx double, by double")
    pages, numbers = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], PAGES), spark.createDataFrame([(1, "1")], "page_id int, number string")
    seen = lambda dense: sorted(r.word_index for r in keynote_pages.symbols(df, segments, numbers, pages, dense=dense).collect())
    assert seen(10) == [1, 2] and seen(10_000) == [3, 4, 5]


CELLS = "table_id int, row_idx int, col_idx int, text string"


def cells_of(spark, tables):
    return spark.createDataFrame([(t, r, c, x) for t, rows in tables.items() for r, row in enumerate(rows) for c, x in enumerate(row)], CELLS)


def test_headerless_records(spark):
    tables = {
        1: [["LIGHT FIXTURE SCHEDULE", "", ""], ["F1 1", "277", "2x4 recessed troffer with a lens", "3000K", "RM-4/FL"], ["A1", " ", None], ["WALL", "x"], ["B2", "recessed", "surface", "0-10V dimm and 277 volts or more", "40 W", "12-34-56", "AB-CD-EF"]],
        2: [["A1", "277", "nothing of the kind"]],
        3: [["led lights", "x"], ["", "A1", "y"], ["C1", "120 V for all of the fixtures", "900 lm"]],
    }
    got = {(r.table_id, r.row_idx): r for r in table_roles.headerless_records(cells_of(spark, tables)).collect()}
    assert sorted(got) == [(1, 1), (1, 4), (3, 2)]
    a, b, c = (got[k] for k in sorted(got))
    assert (a.code, a.voltage, a.description, a.cct, a.fixture_style, a.mounting) == ("F1", "277", "2x4 recessed troffer with a lens", "3000K", "RM-4/FL", "")
    # the second mounting cell finds the kind taken, the long voltage cell leaves it free and is the description
    assert (b.mounting, b.voltage, b.dimming, b.max_va, b.fixture_style) == ("recessed", "", "", "40 W", "AB-CD-EF") and b.description.startswith("0-10V")
    assert (c.lumens, c.voltage, c.description) == ("900 lm", "", "120 V for all of the fixtures")


def test_sheet_index(spark):
    tables = {
        1: [["No", "Sheet No", "Rev", "Title", "Size"], ["1", "E101", "a", "Lighting plan", "z"], ["2", "e1.1a", "", " Power \n plan ", ""], ["3", "bad code", "", "x", ""], ["4", "E1\nE2", "", "One\nTwo", ""], ["5", "E3\nE4", "", "One", ""]],
        2: [["E100", "Cover sheet of the project"], ["E200", "Lighting plan of level one"]],
        3: [["", ""], ["x", "y"]],
        4: [["only", "one row"]],
        5: [["Title", "Code"], ["Roof plan", "E9"]],
    }
    df = cells_of(spark, tables)
    assert sorted(tuple(r) for r in table_roles.index_columns(df).collect()) == [(1, 1, 3), (2, 0, 1), (3, 0, 1), (5, 1, 0)]
    got = sorted(tuple(r) for r in table_roles.index_entries(df).collect())
    assert got == [(1, 1, 0, "E101", "Lighting plan"), (1, 2, 0, "E1.1A", "Power plan"), (1, 4, 0, "E1", "One"), (1, 4, 1, "E2", "Two"), (2, 0, 0, "E100", "Cover sheet of the project"), (2, 1, 0, "E200", "Lighting plan of level one"), (5, 1, 0, "E9", "Roof plan")]


def test_schedule_boxes(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (1, 2, 0, 0, 50, 50), (1, 3, 5, 5, 60, 60), (2, 4, 0, 0, 900, 900), (3, 5, 0, 0, 9, 9), (4, 6, 0, 0, 9, 9)], "page_id int, table_id int, x0 int, y0 int, x1 int, y1 int")
    heads = {1: [["Mark", "Lamp"]], 2: [["MARK", None, "Lamp", "Volts", "Voltage"], ["Watt"]], 3: [["mark", "lamp", "voltage"]], 4: [["mark", "lamp", "watts"]], 5: [["mark lamp voltage", "x" * 500]], 6: [["Notes"]]}
    pages = spark.createDataFrame([(k, 0.0, 0.0, 1000.0, 1000.0) for k in range(1, 5)], PAGES)
    assert [tuple(r) for r in table_roles.schedule_boxes(boxes, cells_of(spark, heads), pages).collect()] == [(1, 2, 0.0, 0.0, 50.0, 50.0)]
