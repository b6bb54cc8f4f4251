"""Data quality by penalties: items to stage means to one weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that a fixture should have, and the weights of the stages.
IMPORTANT = ["voltage", "mounting", "lumens", "cct"]
WEIGHTS = {"sheet_index": 0.15, "schedule_extraction": 0.30, "fixture_counting": 0.40, "keynote_extraction": 0.15}
# Words that are table headings, never codes.
HEADING_WORDS = ["schedule", "schedules", "luminaire", "fixture", "fixtures", "lighting", "type", "description", "mark", "symbol", "catalog", "mounting", "voltage", "dimming", "watts", "wattage"]


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def penalty(condition: Column, amount: float) -> Column:
    return F.when(condition, amount).otherwise(0.0)


def schedule_items(fixtures: DataFrame) -> DataFrame:
    """(code, confidence) for every fixture with a code."""
    off = sum((penalty(blank(f), 0.05) for f in IMPORTANT), F.lit(0.0)) + penalty(blank("description") & blank("fixture_style"), 0.1)
    return fixtures.filter(~blank("code")).select("code", F.greatest(F.lit(0.0), 1 - off).alias("confidence"))


def count_items(fixtures: DataFrame) -> DataFrame:
    off = penalty(F.col("total") == 0, 0.1) + penalty(F.col("code").rlike("^[A-Z][0-9]$"), 0.05) + penalty(F.col("summed") != F.col("total"), 0.1)
    return fixtures.select("code", "total", F.greatest(F.lit(0.0), 1 - off).alias("confidence"))


def keynote_items(keynotes: DataFrame) -> DataFrame:
    off = penalty(F.length(F.trim(F.coalesce("text", F.lit("")))) < 3, 0.2) + penalty(F.col("total") == 0, 0.1)
    return keynotes.select("number", F.greatest(F.lit(0.0), 1 - off).alias("confidence"))


def stage_mean(items: DataFrame) -> DataFrame:
    return items.agg(F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("score"))


def counting_score(items: DataFrame) -> DataFrame:
    """The mean, less one hundredth for each fixture that is on no plan."""
    zero = F.coalesce(F.sum(F.when(F.col("total") == 0, 1).otherwise(0)), F.lit(0))
    return items.agg(F.greatest(F.lit(0.0), F.coalesce(F.avg("confidence"), F.lit(1.0)) - 0.01 * zero).alias("score"))


def index_score(index_codes: DataFrame, pages: DataFrame) -> DataFrame:
    """.85 without an index; else less .05 a missing code, .2 without plans, .2 without schedules."""
    missing = index_codes.distinct().join(pages.select("sheet_code").distinct(), "sheet_code", "left_anti").agg(F.count("*").alias("missing"))
    listed = index_codes.agg(F.count("*").alias("listed"))
    seen = pages.agg(F.count_if(F.col("page_type") == "lighting_plan").alias("plans"), F.count_if(F.col("page_type") == "schedule").alias("schedules"))
    off = 0.05 * F.col("missing") + penalty(F.col("plans") == 0, 0.2) + penalty(F.col("schedules") == 0, 0.2)
    return missing.crossJoin(listed).crossJoin(seen).select(F.when(F.col("listed") == 0, 0.85).otherwise(F.greatest(F.lit(0.0), 1 - off)).alias("score"))


def overall(stages: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``stages``: (stage, score). One row: the weighted score and whether it passes."""
    sums = None
    for stage, weight in WEIGHTS.items():
        part = weight * F.coalesce(F.max(F.when(F.col("stage") == stage, F.col("score"))), F.lit(1.0))
        sums = part if sums is None else sums + part
    return stages.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sums)).alias("raw")).select(F.round("raw", 4).alias("overall_confidence"), (F.col("raw") >= threshold).alias("passed"))


def band(score: Column) -> Column:
    return F.when(score >= 0.95, "green").when(score >= 0.80, "yellow").otherwise("red")


def verify_codes(codes: DataFrame) -> DataFrame:
    """Per code the deductions of schedule verification: heading words, length, letters only, characters, repeats."""
    counted = codes.groupBy("code").agg(F.count("*").alias("n"))
    off = (
        penalty(F.lower("code").isin(HEADING_WORDS), 0.10)
        + penalty(~F.length("code").between(1, 6), 0.05)
        + penalty(F.col("code").rlike("^[A-Za-z]{4,}$"), 0.10)
        + penalty(~F.col("code").rlike("^[A-Za-z0-9./-]+$"), 0.05)
        + penalty(F.col("n") > 1, 0.05)
    )
    error = F.lower("code").isin(HEADING_WORDS) | F.col("code").rlike("^[A-Za-z]{4,}$")
    return counted.select("code", off.alias("deduction"), error.alias("error"))


def verify_counts(counts: DataFrame) -> DataFrame:
    """Deductions of count verification per (plan, code): negative and implausible counts."""
    return counts.select("plan", "code", (penalty(F.col("n") < 0, 0.10) + penalty(F.col("n") > 500, 0.15)).alias("deduction"), ((F.col("n") < 0) | (F.col("n") > 500)).alias("error"))


def verify_keynotes(keynotes: DataFrame) -> DataFrame:
    """Deductions per keynote number: repeats, blank texts, more than 20 call-outs."""
    per = keynotes.groupBy("number").agg(F.count("*").alias("n"), F.max("total").alias("most"), F.max(F.when(F.trim("text") == "", 1).otherwise(0)).alias("empty"))
    return per.select("number", (penalty(F.col("n") > 1, 0.05) + penalty(F.col("empty") == 1, 0.05) + penalty(F.col("most") > 20, 0.05)).alias("deduction"))


def finished(deductions: DataFrame) -> DataFrame:
    """One row: confidence floored at 0, and passed = no error and at least one half."""
    return deductions.agg(F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("deduction"), F.lit(0.0))), 4).alias("confidence"), F.coalesce(F.max(F.col("error").cast("int")), F.lit(0)).alias("errors")).select(
        "confidence", ((F.col("errors") == 0) & (F.col("confidence") >= 0.5)).alias("passed")
    )
