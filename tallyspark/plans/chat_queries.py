"""Driver queries over chat answers, made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat
from ..operators import similarity
from .queries import query, table

#: Blocks of answers by number; # stands for a small number.
BLOCKS = [
    '{"actions":[{"type":"remove","page":#,"reason":"r"}]}',
    '{"actions":[{"action":"reclassify_page","page_code":"e#","page_type":"riser"},{"action":"add","fixture_code":"F#"},5]}',
    '{"actions":[{"action":"split_page","fixture_code":"","sheet_code":"E#","viewports":[{"label":"A"}]}]}',
    '{"highlight":{"x":1},"actions":[{"action":"add","code":"Z"}]}',
    '{"param_changes":{"a":1}}',
    '{"actions":[{"action":',
    '{"actions":[{"action":"reclassify_page","code":"#","fixture_data":{"page_type":"legend"}},{"action":"split_page","page":null,"code":"E#","fixture_data":{"viewports":[1]}}]}\n{"actions":[]}',
    "none",
]
_ANSWERS = "an AS (SELECT event_id, user_id, replace(([" + ", ".join("'" + b.replace("\n", "' || chr(10) || '") + "'" for b in BLOCKS) + "])[1 + event_id % 8], '#', CAST(event_id % 9 AS VARCHAR)) AS block FROM events), js AS (SELECT event_id, user_id, CASE WHEN json_valid(block) THEN block WHEN json_valid(string_split(block, chr(10))[1]) THEN string_split(block, chr(10))[1] END AS j FROM an WHERE block <> 'none')"
_TEXT = "nullif(json_extract_string(a, '$.{}'), '')".format
_FLAT = f"""{_ANSWERS}, el AS (SELECT event_id, user_id, unnest(json_extract(j, '$.actions[*]')) AS a, unnest(range(0, CAST(json_array_length(j, '$.actions') AS BIGINT))) AS pos FROM js WHERE json_extract(j, '$.highlight') IS NULL AND json_type(j, '$.actions') = 'ARRAY'),
ac AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS pos, coalesce(json_extract_string(a, '$.action'), json_extract_string(a, '$.type'), '') AS action, coalesce({', '.join(_TEXT(f) for f in chat.CODE_FIELDS)}, '') AS fixture_code, coalesce(json_extract_string(a, '$.reason'), 'other') AS reason, a FROM el WHERE json_type(a) = 'OBJECT'),
ok AS (SELECT event_id, user_id, pos, action, fixture_code, reason, CASE action WHEN 'reclassify_page' THEN coalesce({_TEXT('page_type')}, {_TEXT('fixture_data.page_type')}, 'lighting_plan') WHEN 'split_page' THEN coalesce(json_extract_string(a, '$.fixture_data.page_type'), 'lighting_plan') ELSE json_extract_string(a, '$.fixture_data.page_type') END AS page_type, CASE WHEN action = 'split_page' THEN coalesce(nullif(CAST(json_extract(a, '$.viewports') AS VARCHAR), '[]'), nullif(CAST(json_extract(a, '$.fixture_data.viewports') AS VARCHAR), '[]'), '[]') END AS viewports FROM ac)"""


def chat_actions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.replace(F.get(F.array(*map(F.lit, BLOCKS)), (F.col("event_id") % 8).cast("int")), F.lit("#"), (F.col("event_id") % 9).cast("string"))
    answer = F.when(block == "none", "no actions here").otherwise(F.concat(F.lit("I will:\n```json\n"), block, F.lit("\n```\nDone.")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.posexplode(chat.actions(answer)).alias("pos", "a")).select("event_id", "user_id", F.col("pos").cast("long").alias("pos"), "a.*")


@query(f"WITH {_FLAT} SELECT event_id, pos, action, fixture_code, reason, page_type, viewports FROM ok")
def chat_actions(spark, sf_dir):
    return chat_actions_of(spark, sf_dir).drop("user_id")


@query(f"""WITH {_FLAT}, pg AS (SELECT c_custkey // 10 AS source_key, c_custkey AS page_id, CAST(c_custkey % 10 AS VARCHAR) AS page_number, 'E' || c_nationkey % 7 AS sheet_code FROM customer),
nm AS (SELECT source_key, name, min(page_id) AS page_id FROM (SELECT source_key, page_id, page_number AS name FROM pg UNION ALL SELECT source_key, page_id, sheet_code FROM pg) GROUP BY 1, 2), fx AS (SELECT DISTINCT c_custkey // 10 AS source_key, 'F' || c_nationkey % 6 AS name FROM customer)
SELECT event_id, pos, CASE WHEN action IN ('reclassify_page', 'split_page') THEN nm.page_id END AS page_id, CASE WHEN action IN ('reclassify_page', 'split_page') THEN nm.page_id IS NOT NULL ELSE fx.name IS NOT NULL END AS known FROM ok LEFT JOIN nm ON nm.source_key = user_id % 100 AND nm.name = upper(fixture_code) LEFT JOIN fx ON fx.source_key = user_id % 100 AND fx.name = upper(fixture_code)""")
def chat_resolved(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("source_key", F.floor(F.col("c_custkey") / 10))
    pages = c.select("source_key", F.col("c_custkey").alias("page_id"), (F.col("c_custkey") % 10).alias("page_number"), F.concat(F.lit("e"), F.col("c_nationkey") % 7).alias("sheet_code"))
    fixtures = c.select("source_key", F.concat(F.lit("f"), F.col("c_nationkey") % 6).alias("code"))
    found = chat_actions_of(spark, sf_dir).withColumn("source_key", F.col("user_id") % 100)
    return chat.resolved(found, pages, fixtures).select("event_id", "pos", "page_id", "known")


@query(f"SELECT event_id, CASE event_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in zip(('signup', 'error', 'click', 'purchase'), similarity.FOCUS.values()))} ELSE '' END AS focus FROM events")
def similarity_focus(spark, sf_dir):
    agent = F.element_at(F.create_map(*[F.lit(x) for e in zip(("signup", "error", "click", "purchase"), similarity.FOCUS) for x in e]), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", similarity.focus_text(F.coalesce(agent, F.lit("none"))).alias("focus"))
