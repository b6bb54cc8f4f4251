"""Reports and suggestions over quality results, pages and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PAGE_TYPES = ["symbols_legend", "lighting_plan", "demolition_plan", "power_plan", "schedule", "detail", "cover", "site_plan", "fire_alarm", "riser", "other"]
# What a category says of a code.
SAYINGS = {
    "systematic_overcount": "Fixture '%s' is systematically overcounted",
    "systematic_undercount": "Fixture '%s' is systematically undercounted",
    "short_code_ambiguity": "Short code '%s' matches non-fixture text",
    "missing_fixture_type": "Fixture type '%s' consistently missed by schedule parser",
    "phantom_fixture_type": "Fixture type '%s' consistently wrongly extracted",
    "spec_correction": "Spec for '%s' consistently wrong",
    "vlm_misread": "VLM consistently misreads '%s'",
}


def described(patterns: DataFrame) -> DataFrame:
    """Adds ``description`` and the ``action`` that the pattern hints at."""
    out = None
    for category, saying in SAYINGS.items():
        text = F.format_string(saying + " (%d sources)", "fixture_code", "source_count")
        out = F.when(F.col("category") == category, text) if out is None else out.when(F.col("category") == category, text)
    action = F.when(F.col("category") == "phantom_fixture_type", "remove").when(F.col("category") == "missing_fixture_type", "add").otherwise("warn")
    return patterns.withColumns({"description": out, "action": action})


def report_lines(items: DataFrame, group: str, most: int = 10) -> DataFrame:
    """(group, line_no, line): the first flagged items of each group, and how many more there are."""
    w = Window.partitionBy(group)
    ranked = items.withColumns({"line_no": F.row_number().over(w.orderBy("confidence", "code")), "_all": F.count("*").over(w)})
    shown = ranked.filter(F.col("line_no") <= most).select(group, "line_no", F.format_string("%s: %.0f%%", "code", F.col("confidence") * 100).alias("line"))
    more = ranked.filter((F.col("line_no") == 1) & (F.col("_all") > most)).select(group, F.lit(most + 1).alias("line_no"), F.format_string("... and %d more", F.col("_all") - most).alias("line"))
    return shown.unionByName(more)


def unique_ids(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Adds ``id``: the safe name, numbered from the second row of the same name on."""
    base = F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 60)
    k = F.row_number().over(Window.partitionBy(base).orderBy(seq)) - 1
    return df.withColumn("id", F.when(k == 0, base).otherwise(F.concat_ws("_", base, k)))


def column_scores(cells: DataFrame) -> DataFrame:
    """(table_id, col_idx, score): columns by how code-like their cells are; the best and first of each table."""
    t = F.trim("text")
    score = F.sum(F.when(t.rlike("^[A-Za-z]{1,3}[0-9]+(\\.[0-9]+)?[A-Za-z]{0,2}$"), 2).when(F.length(t).between(1, 8), 1).otherwise(0))
    scored = cells.groupBy("table_id", "col_idx").agg(score.alias("score"))
    best = scored.groupBy("table_id").agg(F.max_by("col_idx", F.struct("score", -F.col("col_idx"))).alias("col_idx"), F.max("score").alias("score"))
    return best


def verify_pages(pages: DataFrame, has_index: bool) -> DataFrame:
    """(check, severity, deduction) of the issues among pages; a set without pages has one."""
    def issue(check: str, severity: str, amount: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), amount.cast("double").alias("deduction"))

    title = F.lower(F.coalesce("sheet_title", F.lit("")))
    repeated = pages.filter("sheet_code is not null").groupBy("page_type", "sheet_code").agg(F.count("*").alias("n")).filter("n > 1").agg(F.countDistinct("page_type").alias("types"))
    sums = pages.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("page_type") == "lighting_plan").alias("plans"),
        F.count_if(F.col("page_type") == "schedule").alias("schedules"),
        F.count_if(~F.col("page_type").isin(PAGE_TYPES)).alias("unknown"),
        F.count_if((F.col("page_type") == "lighting_plan") & title.contains("demo")).alias("demo"),
    ).crossJoin(repeated)
    off = lambda c, x: F.when(c, x).otherwise(0.0)
    found = F.when(F.col("pages") == 0, F.array(issue("no_pages", "error", F.lit(1.0)))).otherwise(
        F.array(
            issue("no_sheet_index", "warning", F.lit(0.0 if has_index else 0.10)),
            issue("no_lighting_plans", "warning", off(F.col("plans") == 0, 0.20)),
            issue("no_schedules", "warning", off(F.col("schedules") == 0, 0.20)),
            issue("invalid_page_types", "error", off(F.col("unknown") > 0, 0.15)),
            issue("possible_misclassification", "warning", 0.10 * F.col("demo")),
            issue("duplicate_sheet_codes", "warning", 0.05 * F.col("types")),
        )
    )
    return sums.select(F.explode(F.filter(found, lambda i: i["deduction"] > 0)).alias("i")).select("i.check", "i.severity", F.round("i.deduction", 4).alias("deduction"))


def suggestions(results: DataFrame, group: str, each: int = 2, most: int = 8, width: int = 80) -> DataFrame:
    """The first issues of failed results, cut short, and few of them."""
    first = results.filter("not passed").withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("seq"))).filter(F.col("_k") <= each)
    return first.select(group, F.substring("message", 1, width).alias("message")).orderBy(group, "message").limit(most)
