from pyspark.sql import functions as F

from tallyspark.functions import chat
from tallyspark.operators import similarity


def test_actions(spark):
    fence = "text\n```json\n{}\n``` more".replace("{}", "%s")
    answers = [
        fence % '{"actions":[{"type":"remove","page":4},{"action":"reclassify_page","code":"E1","fixture_data":{"page_type":"legend"}},"x",{"action":"split_page","fixture_code":"E2","viewports":[]}]}',
        fence % '{"actions":[{"action":"reclassify_page","sheet_code":"E1"}]}\n{"actions":[]}',
        fence % '{"highlight":1,"actions":[{"action":"add"}]}',
        fence % '{"actions":{}}',
        '```json\n{"actions":[{"action":"add"}]}',
        "nothing",
        None,
    ]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "id int, answer string")
    got = [[tuple(a) for a in r.a] for r in df.select("id", chat.actions(F.col("answer")).alias("a")).orderBy("id").collect()]
    assert got[0] == [("remove", "4", "other", None, None), ("reclassify_page", "E1", "other", "legend", None), ("split_page", "E2", "other", "lighting_plan", "[]")]
    assert got[1] == [("reclassify_page", "E1", "other", "lighting_plan", None)] and got[2:] == [[], [], [], [], []]
    assert [r.k for r in df.select("id", chat.answer_kind(F.col("answer")).alias("k")).orderBy("id").collect()] == ["actions", "actions", "highlight", "actions", None, None, None]


def test_resolved(spark):
    found = spark.createDataFrame([("s", "split_page", "e1"), ("s", "reclassify_page", "2"), ("s", "add", "a1"), ("t", "add", "A1"), ("s", "split_page", "x")], "source_key string, action string, fixture_code string")
    pages = spark.createDataFrame([("s", 10, 1, "E1"), ("s", 11, 2, None), ("s", 12, 3, "E1")], "source_key string, page_id int, page_number int, sheet_code string")
    fixtures = spark.createDataFrame([("s", "A1")], "source_key string, code string")
    got = {(r.source_key, r.fixture_code): (r.page_id, r.known) for r in chat.resolved(found, pages, fixtures).collect()}
    assert got == {("s", "e1"): (10, True), ("s", "2"): (11, True), ("s", "a1"): (None, True), ("t", "A1"): (None, False), ("s", "x"): (None, False)}


def test_similar_rows_of_other_sources(spark):
    rows = [(k, [float(k), 0.0], "a" if k % 2 else "b") for k in range(10)] + [(20, None, "a"), (21, [float("nan"), 1.0], "a"), (22, [1.0], None), (23, [4.0, 0.0], None)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>, source string")
    got = sorted(tuple(r) for r in similarity.from_other_sources(v, v.filter("vec_id IN (4, 22)"), "source", k=4).collect())
    assert got == [(4, 3, 1.0, 2), (4, 5, 1.0, 3), (4, 23, 0.0, 1)]
    assert similarity.nearest(v, v.limit(0)).count() == 0
    assert [r.f for r in v.limit(2).select(similarity.focus_text(F.lit("count")).alias("f")).collect()] == [similarity.FOCUS["count"]] * 2
