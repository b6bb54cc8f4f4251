import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.functions import parsing, rules, text
from tallyspark.operators import corrections, dedup, inventory, quality, spatial, store, tables
from tallyspark.plans.stages import StageTables
from tallyspark.sources.documents import fixtures_of, in_order, list_folder, read_results, register_pdf_source, write_matrix, write_results
from tallyspark.streaming import progress


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


def stream(spark, spelled, page=1):
    """Glyphs from (text, x0, top, size) in stream order."""
    data = [(page, k, t, float(x), float(x) + 5, float(y), float(s)) for k, (t, x, y, s) in enumerate(spelled)]
    return spark.createDataFrame(data, "page_id int, char_index long, text string, x0 double, x1 double, top double, size double")


def test_glyphs_spell_codes_across_small_gaps(spark):
    g = stream(spark, [("A", 0, 0, 9.6), ("1", 8.5, 0, 9.6), (" ", 20, 0, 9.6), ("A", 40, 0, 9.6), ("1", 45, 0, 9.6), ("2", 50, 0, 9.6), ("A", 100, 0, 9.6), ("1", 112, 0, 9.6)])
    assert [r.char_index for r in spatial.spelled(g, ["A1", "B"]).collect()] == [0]


def test_a_far_neighbour_in_the_stream_is_no_neighbour(spark):
    g = stream(spark, [("X", 400, 50, 9), ("F", 42, 50, 9), ("Z", 900, 50, 9)])
    assert spatial.spelled(g, ["F"]).count() == 1


def test_modal_size(spark):
    g = stream(spark, [x for k in range(4) for x in (("E", k * 100, 0, 9.6), ("3", k * 100 + 6, 0, 9.6))] + [("E", 900, 0, 21.6), ("3", 906, 0, 21.6)])
    assert spatial.of_modal_size(spatial.spelled(g, ["E3"])).count() == 4


def test_isolation_reaches_two_rows(spark):
    g = stream(spark, [("A", 100, 30, 9), ("x", 118, 30, 9), ("A", 300, 30, 9), ("y", 318, 37, 9), ("A", 500, 30, 9), ("z", 518, 45, 9)])
    found = spatial.isolated(spatial.spelled(g, ["A"]), g)
    assert [r.x0 for r in found.collect()] == [500.0]


def test_zones(spark):
    pts = spark.createDataFrame([(10.0, 500.0), (942.0, 500.0), (820.0, 500.0), (820.0, 900.0), (500.0, 500.0)], "x double, y double")
    z, k = F.lit(0.0), F.lit(1000.0)
    assert [r.e for r in pts.select(spatial.excluded(F.col("x"), F.col("y"), z, z, k, k).alias("e")).collect()] == [True, True, False, True, False]


def test_enclosure(spark):
    n = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 100.0, 0.0)], "page int, id int, x double, y double")
    s = spark.createDataFrame([(1, -5.0, -5.0, 5.0, -5.0), (1, 5.0, 5.0, 6.0, 5.0), (1, 5.0, 5.0, -5.0, 5.0), (1, 105.0, 0.0, 95.0, 0.0)], "page int, ax double, ay double, bx double, by double")
    assert rows(spatial.enclosing_quadrants(n, s, ["page"], "id")) == [(1, 1, 4), (1, 2, 2)]


def test_page_rules(spark):
    assert one(spark, "DEMOLITION LIGHTING PLAN", lambda c: rules.first_match(c, rules.TYPE_OF_DESCRIPTION)) == "demolition_plan"
    assert one(spark, "SEE SHEET E600 FOR LIGHT FIXTURE SCHEDULE.\nLIGHTING PLAN", lambda c: rules.first_match(rules.without_cross_references(c), rules.TYPE_OF_CONTENT)) == "lighting_plan"
    assert one(spark, "E201", lambda c: rules.type_of_prefix(c, F.lit("Power"))) == "power_plan"
    assert one(spark, "x", lambda c: rules.page_type(F.lit(None), c, c, c)) == "other"


def test_text_functions(spark):
    assert one(spark, "a\nE1.11R GYM\nREV E2", text.last_sheet_code) == "E2"
    assert one(spark, "FE10691-013", text.last_sheet_code) == "FE10691-013"
    assert one(spark, "ab\nLONG LINE\nE200", text.longest_line) == "LONG LINE"
    assert tuple(one(spark, "007---E1.11R GYM PLAN.pdf", text.file_parts)) == ("E1.11R", "GYM PLAN")
    assert tuple(one(spark, "LIGHTING PLAN  E200", text.index_line)) == ("E200", "LIGHTING PLAN")
    assert [one(spark, c, text.code_of_cell) for c in ("F1 1", "AL1", "A long text", "")] == ["F1", "AL1", "", ""]
    assert [one(spark, t, text.viewport_label) for t in ("LEVEL 1 PLAN", "2nd floor", "AREA B", "Enlarged Lobby plan", "plan")] == ["L1", "FL2", "AB", "LOB", "VP"]
    assert one(spark, "A1, al22 FE3 TOOLONG99", text.plan_codes) == ["A1", "AL22"]
    assert one(spark, "why is it?", lambda c: text.intent(text.intent_scores(c))) == "question"


def test_tables(spark):
    cells = spark.createDataFrame(
        [("t", 0, 0, "Light Fixture Schedule"), ("t", 1, 0, "MARK"), ("t", 1, 1, "Description"), ("t", 1, 2, "Volts"), ("t", 2, 0, "A1"), ("t", 2, 1, " a  lamp "), ("t", 2, 2, "277"), ("t", 3, 0, "NOTES"), ("p", 0, 0, "PANEL A"), ("q", 0, 0, "FLAT PANEL RECESSED")],
        "table_id string, row_idx int, col_idx int, text string",
    )
    heads = tables.header_rows(cells)
    assert [(r.table_id, r.row_idx) for r in heads.collect()] == [("t", 1)]
    assert rows(tables.records(cells, heads, ["code", "description", "voltage"])) == [("t", 2, "A1", "a lamp", "277")]
    assert rows(tables.table_kind(cells)) == [("p", False), ("q", True), ("t", True)]
    numbered = spark.createDataFrame([("n", str(k)) for k in range(6)] + [("m", f"A{k}") for k in range(6)] + [("s", "1")], "table_id string, code string")
    assert rows(tables.panel_tables(numbered)) == [("n",)]
    lines = spark.createDataFrame([(1, 0, "notes"), (1, 1, "1. first"), (1, 2, "goes on"), (1, 3, ""), (1, 4, "2) second")], "page_id int, line_no int, text string")
    assert [r.text for r in tables.keynotes_of_lines(lines).orderBy("item").collect()] == ["first goes on", "second"]


def test_merge_of_counts(spark):
    cases = [("A", 5, 7, 7), ("A", 5, 8, 5), ("A", 0, 3, 3), ("A1", 5, 6, 5), ("A", 4, None, 4), ("A", 2, None, 2)]
    df = spark.createDataFrame(cases, "code string, t int, v int, want int")
    assert [r.n for r in df.select(inventory.merged_count(F.col("code"), F.col("t"), F.col("v")).alias("n")).collect()] == [c[3] for c in cases]


def test_inventory(spark):
    counts = spark.createDataFrame([("P1", "A", 3), ("P2", "B", 1)], "plan string, code string, n long")
    assert rows(inventory.zero_filled(counts)) == [("P1", "A", 3), ("P1", "B", 0), ("P2", "A", 0), ("P2", "B", 1)]
    assert rows(inventory.matrix(counts, ["P1", "P2"])) == [("A", 3, 0, 3), ("B", 0, 1, 1)]
    later = spark.createDataFrame([("P1", "A", 2), ("P1", "C", 1)], "plan string, code string, n long")
    assert {(r.action, r.code, r.plan, r.old, r.new) for r in inventory.diff(counts, later).collect()} == {("count_override", "A", "P1", 3, 2), ("remove", "B", None, 1, None), ("add", "C", None, None, 1)}


def test_dedup(spark):
    df = spark.createDataFrame([(1, "A", "x", ""), (2, "A", "x", "y"), (3, None, "", ""), (4, None, "", "")], "seq int, code string, p string, q string")
    assert [r.seq for r in dedup.keep_last(df, "code", "seq").orderBy("seq").collect()] == [2, 3, 4]
    assert dedup.keep_most_complete(df.filter("code is not null"), "code", ["p", "q"], "seq").first().seq == 2


def test_quality_scores(spark):
    stages = spark.createDataFrame([("sheet_index", 1.0), ("schedule_extraction", 1.0), ("fixture_counting", 0.95), ("keynote_extraction", 1.0)], "stage string, score double")
    assert tuple(quality.overall(stages).first()) == (0.98, True)
    other = spark.createDataFrame([("sheet_index", 0.85), ("schedule_extraction", 0.995), ("fixture_counting", 0.985), ("keynote_extraction", 1.0)], "stage string, score double")
    assert tuple(quality.overall(other).first()) == (0.97, True)
    none = spark.createDataFrame([], "sheet_code string")
    pages = spark.createDataFrame([], "sheet_code string, page_type string")
    assert quality.index_score(none, pages).first().score == 0.85
    assert tuple(quality.finished(spark.createDataFrame([(0.1, True)], "deduction double, error boolean")).first()) == (0.9, False)


def correction_rows(spark, actions):
    return spark.createDataFrame([(k, 1, a, c, s, None, v, 0) for k, (a, c, s, v) in enumerate(actions)], "seq long, source_key long, action string, fixture_code string, sheet string, field string, value long, original long")


def test_fold_and_apply(spark):
    state = corrections.fold(correction_rows(spark, [("add", "X", None, None), ("remove", "X", None, None), ("add", "X", None, None), ("remove", "A", None, None), ("count_override", "B", "P1", 1), ("count_override", "B", "P1", 9)]))
    assert {(r.action, r.fixture_code, r.value) for r in state.collect()} == {("add", "X", None), ("remove", "A", None), ("count_override", "B", 9)}
    counts = spark.createDataFrame([("A", "P1", 3), ("B", "P1", 2), ("B", "P2", 5)], "code string, plan string, n long")
    assert rows(corrections.apply_to_counts(counts, state)) == [("B", "P1", 9), ("B", "P2", 5), ("X", "P1", 0), ("X", "P2", 0)]
    assert corrections.target_stages(correction_rows(spark, [("add", "X", None, None)])).first().stages == "2,3,5"
    assert corrections.target_stages(correction_rows(spark, [("split_page", "X", None, None)])).first().stages == "1,2,3,4,5"
    over = corrections.overlay(state, spark.createDataFrame([(1, "remove", "X", None, None)], state.schema))
    assert {(r.action, r.fixture_code) for r in over.collect()} == {("remove", "X"), ("remove", "A"), ("count_override", "B")}


def test_patterns_need_three_sources(spark):
    base = correction_rows(spark, [("add", "A", None, None)] * 3 + [("add", "B", None, None)] * 4)
    spread = base.withColumn("source_key", F.when(F.col("fixture_code") == "A", F.col("seq")).otherwise(F.col("seq") % 2))
    assert [(r.category, r.fixture_code, r.source_count, r.examples) for r in corrections.mine_patterns(spread).collect()] == [("missing_fixture_type", "A", 3, "0,1,2")]


def test_parameters(spark):
    asked = spark.createDataFrame([("dpi", "300"), ("dpi", "x"), ("dpi", "1.5"), ("dpi", "9999"), ("flag", "yes"), ("flag", "2"), ("nope", "1")], "param string, value string")
    registry = spark.createDataFrame([("dpi", "int", 72.0, 600.0), ("flag", "bool", None, None)], "param string, kind string, low double, high double")
    assert {(r.param, r.value, r.error) for r in corrections.validated_params(asked, registry).collect()} == {("dpi", "300", ""), ("dpi", "x", "type"), ("dpi", "1.5", "type"), ("dpi", "9999", "range"), ("flag", "yes", ""), ("flag", "2", "type"), ("nope", "1", "unknown")}


def test_answers(spark):
    assert [tuple(x) for x in one(spark, 'Sure:\n```json\n{"a1": 3, "B": "x"}\n```', lambda c: parsing.counts_of(c, ["A1", "B", "C"]))] == [("A1", 3), ("B", 0), ("C", 0)]
    assert one(spark, '[{"number": 1}, {"x": 1}, {"number": 2', parsing.recovered_objects) == ['{"number": 1}']
    assert one(spark, '{"1": "Lighting_Plan", "x": "schedule", "2": "other"}', lambda c: parsing.page_labels(c, ["lighting_plan", "schedule"])) == {"1": "Lighting_Plan"}
    assert one(spark, '{"n": 4}', lambda c: parsing.number_of(c, "n")) == 4


def test_store(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, seq int, v string")
    b = spark.createDataFrame([(1, 3, "c"), (3, 4, "d")], "k int, seq int, v string")
    assert rows(store.upserted(a, b, ["k"], "seq").select("k", "v")) == [(1, "c"), (2, "b"), (3, "d")]


def test_stream_state_equals_batch(spark, tmp_path):
    events = [(k, k % 5, ["view", "click", "signup", "purchase", "error"][(k * 7) % 5 if k % 3 else 0]) for k in range(60)]
    table = spark.createDataFrame(events, "event_id long, user_id long, event_type string")
    for part in range(3):
        table.filter(f"event_id % 3 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = progress.stream_state(source, "user_id", "event_id").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("states").groupBy("user_id").agg(F.max_by(F.struct("status", "events", "ended"), "events").alias("s")).select("user_id", "s.*")
    assert rows(last) == rows(progress.final_state(table, "user_id", "event_id"))


def test_documents_and_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("002---E2 b.pdf", "001---E1 a.PDF", "010---e1 later.pdf", "x.txt", ".hidden.pdf"):
        (tmp_path / "d" / n).write_bytes(b"x")
    (tmp_path / "d" / "003---E9 empty.pdf").write_bytes(b"")
    assert [(r.name, r.page_number) for r in list_folder(spark, str(tmp_path / "d")).orderBy("page_number").collect()] == [("002---E2 b.pdf", 1), ("010---e1 later.pdf", 2)]
    (tmp_path / "r.json").write_text('{"project_name": "p",\n "fixtures": [{"code": "A", "counts_per_plan": {"P1": 2, "P2": 0}, "total": 2}, {"code": "B", "counts_per_plan": {}}]}')
    found = read_results(spark, str(tmp_path / "r.json"))
    assert sorted((r.code, r.plan, r.n) for r in fixtures_of(found).collect()) == [("A", "P1", 2), ("A", "P2", 0), ("B", None, None)]
    write_results(found.drop("source"), f"{tmp_path}/out")
    assert read_results(spark, f"{tmp_path}/out").first().project_name == "p"
    counts = spark.createDataFrame([("P1", "A", 3)], "plan string, code string, n long")
    write_matrix(inventory.matrix(counts, ["P1", "P2"]), f"{tmp_path}/m")
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/m")) == [("A", "3", "0", "3")]
    assert isinstance(register_pdf_source(spark), bool)
    names = spark.createDataFrame([Row(name=n) for n in ("b.pdf", "2---E1 x.pdf", "10---E3 y.pdf")])
    assert [r.name for r in in_order(names).orderBy("page_number").collect()] == ["2---E1 x.pdf", "10---E3 y.pdf", "b.pdf"]


def test_only_stale_stages_run_again(spark, tmp_path):
    runs = []

    def stage(name):
        def f(s, t):
            runs.append(name)
            return s.range(len(t) + 1)

        return f

    tables_ = StageTables(spark, str(tmp_path), [(n, stage(n)) for n in ("search", "count", "qa")])
    held = tables_.run(1)
    held = tables_.run(2, {"count"}, held)
    assert runs == ["search", "count", "qa", "count"] and held == {"search": 1, "count": 2, "qa": 1}
    assert tables_.table("count", held).count() == 2


def test_entry_and_registry(spark):
    entry = pytest.importorskip("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25
