"""Counts of codes on plans: zero-filled, totalled, spread wide, merged and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(counts: DataFrame, plans: list[str] | None = None) -> DataFrame:
    """(plan, code, n) with a row for every code on every plan.

    The plans of a project are few; they go into each code's row as one array, so
    the counts are grouped once and never meet each other.
    """
    known = counts.select("plan").distinct().agg(F.array_sort(F.collect_set("plan")).alias("plans")) if plans is None else None
    by_code = counts.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("plan", "n"))).alias("held"))
    spread = by_code.crossJoin(known) if known is not None else by_code.withColumn("plans", F.array(*map(F.lit, plans)))
    return spread.select("code", "held", F.explode("plans").alias("plan")).select("plan", "code", F.coalesce(F.try_element_at("held", F.col("plan")), F.lit(0)).cast("long").alias("n"))


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("code").agg(F.sum("n").alias("total"))


def summary(counts: DataFrame) -> DataFrame:
    return counts.agg(F.countDistinct("code").alias("types"), F.sum("n").alias("fixtures"), F.countDistinct("plan").alias("plans"))


def matrix(counts: DataFrame, plans: list[str]) -> DataFrame:
    """One row a code, one column a plan, and the total; the plans are given, so that columns never depend on data."""
    wide = counts.groupBy("code").pivot("plan", plans).agg(F.sum("n"))
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in plans), F.lit(0))
    return wide.select("code", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in plans], total.cast("long").alias("total"))


def long_form(wide: DataFrame, plans: list[str]) -> DataFrame:
    """Plan columns back to rows; blank cells are left out."""
    return wide.unpivot("code", plans, "plan", "n").filter(F.coalesce("n", F.lit(0)) > 0)


def merged_count(code: Column, text: Column, vision: Column, tolerance: int = 2) -> Column:
    """One count from a text count and a vision count: codes of several letters keep the
    text count; a letter that the text missed takes the vision's; counts that nearly
    agree give the greater one, and where they disagree the text stands."""
    t, v = F.coalesce(text, F.lit(0)), F.coalesce(vision, F.lit(0))
    return F.when(F.length(code) > 1, t).when((t == 0) & (v > 0), v).when(F.abs(v - t) <= tolerance, F.greatest(t, v)).otherwise(t)


def merge_counts(text: DataFrame, vision: DataFrame) -> DataFrame:
    both = text.select("plan", "code", F.col("n").alias("t")).join(vision.select("plan", "code", F.col("n").alias("v")), ["plan", "code"], "full")
    return both.select("plan", "code", merged_count(F.col("code"), F.col("t"), F.col("v")).cast("long").alias("n"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two count tables: codes added or removed, and counts that differ."""
    a, b = before.groupBy("code").agg(F.sum("n").alias("old")), after.groupBy("code").agg(F.sum("n").alias("new"))
    codes = a.join(b, "code", "full")
    gone = codes.filter("old is null or new is null").select(F.when(F.col("old").isNull(), "add").otherwise("remove").alias("action"), "code", F.lit(None).cast("string").alias("plan"), "old", "new")
    both = before.select("code", "plan", F.col("n").alias("old")).join(after.select("code", "plan", F.col("n").alias("new")), ["code", "plan"], "full")
    kept = codes.filter("old is not null and new is not null").select("code")
    changed = both.join(kept, "code", "left_semi").withColumns({"old": F.coalesce("old", F.lit(0)), "new": F.coalesce("new", F.lit(0))}).filter("old <> new")
    return gone.unionByName(changed.select(F.lit("count_override").alias("action"), "code", "plan", "old", "new"))


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("changes"), F.countDistinct("code").alias("codes"))


def reprocess_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that both runs hold and whose count changed, with the old count."""
    both = before.select("code", "plan", F.col("n").alias("old")).join(after.select("code", "plan", "n"), ["code", "plan"])
    return both.filter("old <> n").select("code", "plan", "old")


def dashboard(projects: DataFrame, tenant: Column) -> DataFrame:
    """Per tenant: projects, types, fixtures and the mean of the known scores in percent."""
    return projects.groupBy(tenant.alias("tenant")).agg(
        F.count("*").alias("projects"), F.sum("types").alias("types"), F.sum("fixtures").alias("fixtures"), F.round(F.avg("score") * 100, 2).alias("mean_score")
    )


def merged_keynotes(keynotes: DataFrame) -> DataFrame:
    """One row a number: the longest text (the first on ties) and the sorted union of references."""
    return keynotes.groupBy("number").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("seq"))).alias("text"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))), ",").alias("refs"),
        F.sum("n").alias("total"),
    )
