"""Corrections as events: folded to hints, applied, mined for patterns, and parameters by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stages that an action makes stale; stage 5 always runs.
STAGES_OF_ACTION = {
    "add": [2, 3],
    "remove": [2, 3],
    "update_spec": [2],
    "count_override": [3],
    "keynote_count_override": [4],
    "keynote_add": [4],
    "keynote_remove": [4],
    "reclassify_page": [1, 2, 3, 4],
    "split_page": [1, 2, 3, 4],
}
ALL_STAGES = [1, 2, 3, 4, 5]


def fold(corrections: DataFrame) -> DataFrame:
    """The state of each (source, kind, code, place) after its events in order.

    An add takes back a remove and the other way round, so the later one stands; of
    overrides of one place the last stands.
    """
    kind = F.when(F.col("action").isin("add", "remove"), "presence").otherwise(F.col("action"))
    place = F.when(F.col("action") == "count_override", F.col("sheet")).when(F.col("action") == "update_spec", F.col("field"))
    keyed = corrections.withColumn("kind", kind).withColumn("place", place)
    last = keyed.groupBy("source_key", "kind", "fixture_code", "place").agg(F.max_by(F.struct("action", "value"), "seq").alias("last"))
    return last.select("source_key", F.col("last.action").alias("action"), "fixture_code", "place", F.col("last.value").alias("value"))


def overlay(*layers: DataFrame) -> DataFrame:
    """Hints of later layers win over earlier ones, key by key."""
    every = None
    for rank, layer in enumerate(layers):
        one = layer.withColumn("_rank", F.lit(rank))
        every = one if every is None else every.unionByName(one)
    kind = F.when(F.col("action").isin("add", "remove"), "presence").otherwise(F.col("action"))
    best = every.groupBy("source_key", kind.alias("_kind"), "fixture_code", "place").agg(F.max_by(F.struct("action", "value"), "_rank").alias("last"))
    return best.select("source_key", F.col("last.action").alias("action"), "fixture_code", "place", F.col("last.value").alias("value"))


def apply_to_counts(counts: DataFrame, hints: DataFrame) -> DataFrame:
    """(source_key, code, plan, n) without removed codes, with added ones on every plan of their
    source, and with overridden counts. Tables without ``source_key`` are of one source."""
    key = ["source_key"] if "source_key" in counts.columns else []
    code = [*key, "code"]
    said = hints.withColumnRenamed("fixture_code", "code")
    removed = said.filter("action = 'remove'").select(*code).distinct()
    added = said.filter("action = 'add'").select(*code).distinct().join(counts.select(*code).distinct(), code, "left_anti")
    plans = counts.select(*key, "plan").distinct()
    new = (added.join(plans, key) if key else added.crossJoin(F.broadcast(plans))).select(*code, "plan", F.lit(0).cast("long").alias("n"))  # the plans of one source are few
    over = said.filter("action = 'count_override'").groupBy(*code, F.col("place").alias("plan")).agg(F.max("value").alias("_over")).join(removed, code, "left_anti")
    kept = counts.join(removed, code, "left_anti").select(*code, "plan", "n")
    return kept.unionByName(new).join(over, [*code, "plan"], "full").select(*code, "plan", F.coalesce("_over", "n").alias("n"))


def apply_spec_patches(fixtures: DataFrame, hints: DataFrame, fields: list[str]) -> DataFrame:
    """Fixtures (source_key, code, fields) with the fields that users changed; unknown fields do nothing."""
    patches = hints.filter(F.col("action") == "update_spec").groupBy("source_key", F.col("fixture_code").alias("code")).pivot("place", fields).agg(F.max("value"))
    renamed = patches.withColumnsRenamed({f: f"_new_{f}" for f in fields})
    return fixtures.join(renamed, ["source_key", "code"], "left").withColumns({f: F.coalesce(F.col(f"_new_{f}").cast(fixtures.schema[f].dataType), f) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def target_stages(corrections: DataFrame) -> DataFrame:
    """Per project the stages to run again: the union over its actions."""
    pairs = [F.struct(F.lit(a).alias("action"), F.array(*map(F.lit, s)).alias("stages")) for a, s in STAGES_OF_ACTION.items()]
    known = F.filter(F.array(*pairs), lambda p: p["action"] == F.col("action"))
    stages = F.when(F.size(known) > 0, F.element_at(known, 1)["stages"]).otherwise(F.array(*map(F.lit, ALL_STAGES)))
    found = corrections.select("source_key", "action").distinct().select("source_key", F.explode(F.array_union(stages, F.array(F.lit(5)))).alias("stage"))
    listed = found.groupBy("source_key").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
    whole = F.when(F.array_contains("stages", 1), F.array(*map(F.lit, ALL_STAGES))).otherwise(F.col("stages"))
    return listed.select("source_key", F.array_join(F.transform(whole, lambda s: s.cast("string")), ",").alias("stages"))


def categorised(corrections: DataFrame) -> DataFrame:
    """Adds ``category``; counts that were lowered, and whatever has no category of its own, are overcounts."""
    misread = F.col("reason") == "vlm_misread" if "reason" in corrections.columns else F.lit(False)
    override = F.col("action") == "count_override"
    category = (
        F.when(override & (F.col("value") < F.col("original")) & (F.length("fixture_code") == 1), "short_code_ambiguity")
        .when(override & (F.col("value") > F.col("original")), "systematic_undercount")
        .when(F.col("action") == "remove", "phantom_fixture_type")
        .when(F.col("action") == "add", "missing_fixture_type")
        .when((F.col("action") == "update_spec") & misread, "vlm_misread")
        .when(F.col("action") == "update_spec", "spec_correction")
        .otherwise("systematic_overcount")
    )
    return corrections.withColumn("category", category)


def mine_patterns(corrections: DataFrame, sources: int = 3, examples: int = 5) -> DataFrame:
    """(category, code) with at least so many distinct sources, and its first examples in order."""
    keyed = categorised(corrections)
    counted = keyed.groupBy("category", "fixture_code").agg(F.countDistinct("source_key").alias("source_count"), F.count("*").alias("n"))
    promoted = counted.filter(F.col("source_count") >= sources)
    first = F.row_number().over(_by_pattern())
    shown = keyed.join(promoted.select("category", "fixture_code"), ["category", "fixture_code"], "left_semi").withColumn("_k", first).filter(F.col("_k") <= examples)
    listed = shown.groupBy("category", "fixture_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_key"))), lambda x: x["seq"].cast("string")), ",").alias("examples"))
    return promoted.join(listed, ["category", "fixture_code"])


def _by_pattern():
    from pyspark.sql import Window

    return Window.partitionBy("category", "fixture_code").orderBy("seq")


def new_patterns(found: DataFrame, existing: DataFrame) -> DataFrame:
    return found.join(existing, ["category", "fixture_code"], "left_anti")


def effective_params(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(param, value, scope): the value of the narrowest scope that sets it."""
    order = F.create_map(*[F.lit(x) for p in {"default": 0, "global": 1, "source": 2, "project": 3}.items() for x in p])
    every = defaults.select("param", "value", F.lit("default").alias("scope")).unionByName(overrides.select("param", "value", "scope"))
    best = every.groupBy("param").agg(F.max_by(F.struct("value", "scope"), F.element_at(order, F.col("scope"))).alias("b"))
    return best.select("param", F.col("b.value").alias("value"), F.col("b.scope").alias("scope"))


def validated_params(params: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``ok`` and ``error``: unknown names, wrong types and values out of range."""
    both = params.join(registry, "param", "left")
    number = F.expr("try_cast(value as double)")
    error = (
        F.when(F.col("kind").isNull(), "unknown")
        .when((F.col("kind") == "bool") & ~F.lower("value").isin("true", "false", "1", "0", "yes", "no"), "type")
        .when(F.col("kind").isin("int", "float") & number.isNull(), "type")
        .when((F.col("kind") == "int") & (number != F.floor(number)), "type")
        .when(F.col("kind").isin("int", "float") & ((number < F.col("low")) | (number > F.col("high"))), "range")
    )
    return both.select("param", "value", error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))
