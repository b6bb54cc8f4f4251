"""Codes, pages and sources that name the same thing a little differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
EMERGENCY = ["EMERGENCY", "BATTERY PACK", "BATTERY BACKUP"]


def letters(code: Column) -> Column:
    return F.regexp_extract(code, "^([A-Z]+)", 1)


def digits(code: Column) -> Column:
    return F.regexp_extract(code, "([0-9]+[A-Z]*)$", 1)


def corrected_codes(fixtures: DataFrame, plan_codes: DataFrame) -> DataFrame:
    """(id, code, description, new_code): read codes against the codes on the plans.

    A code on a plan stays; else without its hyphens; else the one plan code with the same
    digits whose letters begin with the code's letters. Then a trailing E is added for
    emergency fixtures whose E code is on a plan and not yet among the fixtures.
    """
    on_plan = plan_codes.select(F.col("code").alias("plan_code")).distinct()
    clean = F.replace("code", F.lit("-"), F.lit(""))
    base = fixtures.select("id", "code", "description", clean.alias("clean"))
    same = base.join(on_plan, F.col("code") == F.col("plan_code"), "left").withColumnRenamed("plan_code", "exact")
    bare = same.join(on_plan, F.col("clean") == F.col("plan_code"), "left").withColumnRenamed("plan_code", "stripped")
    asked = base.select("clean").distinct().withColumns({"d": digits(F.col("clean")), "l": letters(F.col("clean"))}).filter("d <> '' and l <> ''")
    offered = on_plan.withColumns({"pd": digits(F.col("plan_code")), "pl": letters(F.col("plan_code"))}).filter("pd <> '' and pl <> ''")
    unique = asked.join(offered, (F.col("d") == F.col("pd")) & F.startswith("pl", "l")).groupBy("clean").agg(F.count("*").alias("n"), F.min("plan_code").alias("only")).filter("n = 1")
    first = bare.join(unique.select("clean", "only"), "clean", "left").select("id", "code", "description", F.coalesce("exact", "stripped", "only", "code").alias("new_code"))
    emergency = F.lit(False)
    for w in EMERGENCY:
        emergency = emergency | F.upper("description").contains(w)
    wanted = first.withColumn("_e", F.concat("new_code", F.lit("E")))
    held = first.select(F.col("new_code").alias("_e")).distinct().withColumn("_held", F.lit(True))
    both = wanted.join(held, "_e", "left").join(on_plan.select(F.col("plan_code").alias("_e"), F.lit(True).alias("_on")), "_e", "left")
    add = F.col("_on").isNotNull() & F.col("_held").isNull() & emergency & ~F.upper(F.col("new_code")).endswith("E")
    return both.select("id", "code", "description", F.when(add, F.col("_e")).otherwise(F.col("new_code")).alias("new_code"))


def resolved_source(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, source): an equal normalised name, or one that holds the other; the first known one in order.

    Equality is a join on the name; containment compares a name with the few sources of
    its first letters on either side, so names shorter than three letters only match equal.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = names.select("name", plain(F.col("name")).alias("n"))
    b = known.select("source", F.col("ord"), plain(F.col("source")).alias("m"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    # whoever is contained begins with a trigram that the other holds
    left = a.withColumn("g", F.explode(grams(F.col("n"))))
    right = b.withColumn("g", F.substring("m", 1, 3))
    one = left.join(right, "g").filter(F.col("n").contains(F.col("m")))
    two = a.withColumn("g", F.substring("n", 1, 3)).join(b.withColumn("g", F.explode(grams(F.col("m")))), "g").filter(F.col("m").contains(F.col("n")))
    every = one.select("name", "source", "ord").unionByName(two.select("name", "source", "ord"))
    return names.select("name").distinct().join(every.groupBy("name").agg(F.min_by("source", "ord").alias("source")), "name", "left")


def page_references(messages: DataFrame, pages: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """(id, page): the distinct pages that a message's references name by number or code."""
    said = messages.select(id_col, F.explode(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.upper(x))).alias("ref"))
    named = pages.select("page_id", F.explode(F.array(F.upper("code"), F.col("page_id").cast("string"))).alias("ref")).filter("ref IS NOT NULL")
    # both sides know all their names, so that a pair counts at the first one that it shares: pairs,
    # as many as pages of a code times messages that name it, are not gathered to be told apart
    hits = said.groupBy(id_col).agg(F.array_sort(F.collect_set("ref")).alias("_refs")).select(id_col, "_refs", F.explode("_refs").alias("ref"))
    names = named.groupBy("page_id").agg(F.collect_set("ref").alias("_names")).select("page_id", "_names", F.explode("_names").alias("ref"))
    return hits.join(names, "ref").filter(F.array_min(F.array_intersect("_refs", "_names")) == F.col("ref")).select(id_col, "page_id")


def neighbours(plans: DataFrame, group: str, order: str) -> DataFrame:
    """Adds previous and next plan, cyclic within the group."""
    w = Window.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return plans.withColumns({"previous": F.coalesce(F.lag("plan").over(w), F.last("plan").over(whole)), "next": F.coalesce(F.lead("plan").over(w), F.first("plan").over(whole))})


def preferred_counts(geometric: DataFrame, vision: DataFrame) -> DataFrame:
    """Keynote counts per (plan, number): the geometric count where there is one, else the vision's."""
    both = geometric.select("plan", "number", F.col("n").alias("g")).join(vision.select("plan", "number", F.col("n").alias("v")), ["plan", "number"], "full")
    return both.select("plan", "number", F.when(F.coalesce("g", F.lit(0)) > 0, F.col("g")).otherwise(F.coalesce("v", F.lit(0))).alias("n"))


def synced_counts(held: DataFrame, counted: DataFrame) -> DataFrame:
    """Counts of keynotes overwritten by a new count; a plan is added only with a count over 0."""
    both = held.select("number", "plan", F.col("n").alias("old")).join(counted.select("number", "plan", F.col("n").alias("new")), ["number", "plan"], "full")
    return both.filter("old is not null or new > 0").select("number", "plan", F.coalesce("new", "old").alias("n"))


def downgraded(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Issues with the severity info where a verdict calls the check a false alarm."""
    return issues.join(verdicts, "check", "left").select("check", F.when(F.coalesce("verdict", F.lit("")) == "false_alarm", "info").otherwise(F.col("severity")).alias("severity"))
