"""Driver queries over inventory workbooks: six parts a workbook, two of them a keynote sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import workbooks
from .queries import query, table

_HEADS = ["Type", "Description", "Voltage", "E201", "E202", "Total", "E999"]
_ROWS = """bk AS (SELECT 'Job ' || p_partkey // 6 || ' (3)_inventory' AS workbook, p_partkey // 6 AS b, p_partkey % 6 AS k, p_brand, p_type, p_size FROM part),
fx AS (SELECT workbook, b, k, CASE WHEN b % 5 = 1 AND k = 4 THEN '' WHEN b % 5 = 2 AND k = 3 THEN 'Key Notes Summary' ELSE p_brand || k END AS code, p_type AS description, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE '277 ' END AS voltage, p_size % 7 AS a, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 5 END AS c FROM bk),
ok AS (SELECT fx.* FROM fx LEFT JOIN (SELECT b, min(k) AS e FROM fx WHERE code IN ('', 'Key Notes Summary') GROUP BY 1) s USING (b) WHERE e IS NULL OR k < e)"""


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    b, k = F.floor(p / 6), p % 6
    book = F.concat(F.lit("Job "), b, F.lit(" (3)_inventory"))
    code = F.when((b % 5 == 1) & (k == 4), "").when((b % 5 == 2) & (k == 3), "Key Notes Summary").otherwise(F.concat("p_brand", k))
    second = F.when(size % 4 != 0, size % 5)
    row = F.array(code, F.col("p_type"), F.when(size % 3 == 0, " ").otherwise("277 "), (size % 7).cast("string"), second.cast("string"), (size % 7 + F.coalesce(second, F.lit(0))).cast("string"), F.lit("8"))
    parts = table(spark, sf_dir, "part")
    body = parts.select(book.alias("workbook"), F.lit(workbooks.FIXTURES).alias("sheet"), (k + 1).cast("int").alias("row_idx"), F.posexplode(row).alias("col_idx", "text"))
    books = parts.select(book.alias("workbook"), b.alias("b")).distinct()
    heads = books.select("workbook", F.lit(workbooks.FIXTURES).alias("sheet"), F.lit(0).alias("row_idx"), F.posexplode(F.array(*map(F.lit, _HEADS))).alias("col_idx", "text"))
    notes = books.filter("b % 2 = 0").select("workbook", F.lit(workbooks.KEYNOTES).alias("sheet"), F.posexplode(F.array(F.array(*map(F.lit, ["Keynote #", "Keynote Text", "Total"])), F.array(F.lit("1"), F.lit("text"), F.lit("3")), F.array(F.lit("2"), F.lit("more"), F.lit("")))).alias("row_idx", "r")).select("workbook", "sheet", "row_idx", F.posexplode("r").alias("col_idx", "text"))
    report = books.filter("b % 3 <> 0").select("workbook", F.lit(workbooks.QUALITY).alias("sheet"), F.lit(2).alias("row_idx"), F.posexplode(F.array(F.lit("Overall Confidence"), F.concat(90 + F.col("b") % 10, F.lit("%")))).alias("col_idx", "text"))
    return body.unionByName(heads).unionByName(notes).unionByName(report)


@query(f"WITH {_ROWS} SELECT workbook, code, description, trim(voltage) AS voltage, CAST(a + coalesce(c, 0) AS BIGINT) AS total FROM ok")
def workbook_fixtures(spark, sf_dir):
    return workbooks.fixtures(workbook_cells(spark, sf_dir)).select("workbook", "code", "description", "voltage", "total")


@query(f"WITH {_ROWS} SELECT workbook, CAST(k + 1 AS INT) AS row_idx, plan, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT workbook, k, 'E201' AS plan, a AS n FROM ok UNION ALL SELECT workbook, k, 'E202', c FROM ok)")
def workbook_counts(spark, sf_dir):
    return workbooks.fixture_counts(workbook_cells(spark, sf_dir))


@query(f"""WITH {_ROWS}, f AS (SELECT b, count(*) AS n, sum(a + coalesce(c, 0)) AS t FROM ok GROUP BY 1)
SELECT DISTINCT workbook, 'Job ' || bk.b AS name, CAST(coalesce(n, 0) AS BIGINT) AS fixture_types, CAST(coalesce(t, 0) AS BIGINT) AS total_fixtures, CAST(CASE WHEN bk.b % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS keynote_count, CAST(2 AS BIGINT) AS plan_count, CASE WHEN bk.b % 3 <> 0 THEN CAST(90 + bk.b % 10 AS DOUBLE) / 100 END AS qa_score, CASE WHEN bk.b % 3 <> 0 THEN CAST(90 + bk.b % 10 AS DOUBLE) / 100 >= 0.95 END AS qa_passed FROM bk LEFT JOIN f USING (b)""")
def dashboard_index(spark, sf_dir):
    return workbooks.dashboard_index(workbook_cells(spark, sf_dir))
