"""Inventory workbooks as cells (workbook, sheet, row_idx, col_idx, text), and a dashboard seeded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sheets, the headings of a fixture's fields, and what stands below the fixtures.
FIXTURES, KEYNOTES, QUALITY = "Fixture Inventory", "Key Notes Inventory", "QA Report"
FIELDS = {"Type": "code", "Description": "description", "Fixture Style": "fixture_style", "Voltage": "voltage", "Mounting": "mounting", "Lumens": "lumens", "CCT": "cct", "Dimming": "dimming", "Max VA": "max_va"}
BELOW = ["key notes summary", "#"]


def _text(c: str = "text") -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(0))


def _merged(df: DataFrame) -> DataFrame:
    """What grows with the workbooks is joined by sorted partitions: sent to every executor, it passes the driver whole."""
    return df.hint("merge")


def _body(cells: DataFrame, sheet: str, below: list[str]) -> DataFrame:
    """(workbook, row_idx, col_idx, t, head): the rows under the heading up to the first one that
    is missing, has an empty first cell or begins what stands below."""
    own = cells.filter(F.col("sheet") == sheet).select("workbook", "row_idx", "col_idx", _text().alias("t"))
    heads = own.filter("row_idx = 0").select("workbook", "col_idx", F.col("t").alias("head"))
    first = own.filter("row_idx > 0").groupBy("workbook", "row_idx").agg(F.coalesce(F.max(F.when(F.col("col_idx") == 0, F.col("t"))), F.lit("")).alias("_f"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy("workbook").orderBy("row_idx")))
    ends = ranked.filter((F.col("_f") == "") | F.lower("_f").isin(below) | (F.col("row_idx") > F.col("_k"))).groupBy("workbook").agg(F.min("row_idx").alias("_end"))
    return own.filter("row_idx > 0").join(_merged(ends), "workbook", "left").filter("_end IS NULL OR row_idx < _end").join(_merged(heads), ["workbook", "col_idx"]).drop("_end")


def plan_columns(cells: DataFrame) -> DataFrame:
    """(workbook, col_idx, plan): headings behind the last field and before the first total."""
    heads = cells.filter((F.col("sheet") == FIXTURES) & (F.col("row_idx") == 0)).select("workbook", "col_idx", _text().alias("plan"))
    ends = heads.groupBy("workbook").agg(F.coalesce(F.max(F.when(F.col("plan").isin(list(FIELDS)), F.col("col_idx"))), F.lit(-1)).alias("_a"), F.min(F.when(F.lower("plan") == "total", F.col("col_idx"))).alias("_b"))
    return heads.join(_merged(ends), "workbook").filter("col_idx > _a AND col_idx < _b").select("workbook", "col_idx", "plan")


def fixtures(cells: DataFrame) -> DataFrame:
    """(workbook, row_idx, fields, total); of equal headings the last one's value counts."""
    body = _body(cells, FIXTURES, BELOW)
    pick = lambda hit: F.max_by("t", F.when(hit, F.col("col_idx")))
    out = body.groupBy("workbook", "row_idx").agg(*[F.coalesce(pick(F.col("head") == h), F.lit("")).alias(f) for h, f in FIELDS.items()], _number(pick(F.lower("head") == "total")).alias("total"))
    return out.filter("code <> ''")


def fixture_counts(cells: DataFrame) -> DataFrame:
    """(workbook, row_idx, plan, n): a fixture's count on every plan, 0 where the cell is empty."""
    body = _body(cells, FIXTURES, BELOW).join(_merged(plan_columns(cells)), ["workbook", "col_idx"])
    counted = body.groupBy("workbook", "row_idx", "plan").agg(_number(F.max_by("t", "col_idx")).alias("n"))
    return counted.join(_merged(fixtures(cells).select("workbook", "row_idx")), ["workbook", "row_idx"], "left_semi")


def keynotes(cells: DataFrame) -> DataFrame:
    """(workbook, row_idx, number, text, total)."""
    body = _body(cells, KEYNOTES, [])
    at = lambda k: F.coalesce(F.max(F.when(F.col("col_idx") == k, F.col("t"))), F.lit(""))
    return body.groupBy("workbook", "row_idx").agg(at(0).alias("number"), at(1).alias("text"), _number(F.max_by("t", F.when(F.lower("head") == "total", F.col("col_idx")))).alias("total"))


def quality_score(cells: DataFrame) -> DataFrame:
    """(workbook, qa_score): the overall confidence of the report, a percentage."""
    rows = cells.filter(F.col("sheet") == QUALITY).groupBy("workbook", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, _text())).alias("label"), F.max(F.when(F.col("col_idx") == 1, _text())).alias("value"))
    said = F.when((F.col("label") == "Overall Confidence") & (F.col("value") != ""), F.replace("value", F.lit("%"), F.lit("")).try_cast("double") / 100)
    return rows.groupBy("workbook").agg(F.coalesce(F.max_by(said, F.when(said.isNotNull(), F.col("row_idx"))), F.lit(0.0)).alias("qa_score"))


def dashboard_index(cells: DataFrame) -> DataFrame:
    """One row a workbook: id, name, the four figures, the score and whether it passes (null without a report)."""
    books = cells.select("workbook").distinct()
    held = books.join(_merged(fixtures(cells).groupBy("workbook").agg(F.count("*").alias("fixture_types"), F.sum("total").alias("total_fixtures"))), "workbook", "left")
    held = held.join(_merged(keynotes(cells).groupBy("workbook").agg(F.count("*").alias("keynote_count"))), "workbook", "left")
    held = held.join(_merged(plan_columns(cells).groupBy("workbook").agg(F.count("*").alias("plan_count"))), "workbook", "left").join(_merged(quality_score(cells)), "workbook", "left")
    name = F.trim(F.regexp_replace(F.replace("workbook", F.lit("_inventory"), F.lit("")), r"\([0-9]+\)", ""))
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fixture_types", "total_fixtures", "keynote_count", "plan_count")]
    return held.select("workbook", name.alias("name"), *figures, "qa_score", (F.col("qa_score") >= 0.95).alias("qa_passed"))
