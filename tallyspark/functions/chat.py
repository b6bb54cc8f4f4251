"""Actions out of chat answers: a fenced JSON object, read with its habitual variations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that may stand for the code, in order; fixed values.
CODE_FIELDS = ["fixture_code", "page", "page_code", "sheet_code", "code"]


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def answer_object(answer: Column) -> Column:
    """The first JSON object of the first closed json fence as a variant; null if there is none."""
    block = F.nullif(F.trim(F.regexp_extract(answer, r"(?s)```json(.*?)```", 1)), F.lit(""))
    found = F.try_parse_json(block)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def answer_kind(answer: Column) -> Column:
    """highlight, actions or param_changes, the first that the object has."""
    held = answer_object(answer)
    has = lambda k: F.try_variant_get(held, f"$.{k}", "variant").isNotNull()
    out = F.when(has("highlight"), "highlight")
    for k in ("actions", "param_changes"):
        out = out.when(has(k), k)
    return out


def _action(a: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    action = F.coalesce(_text(a, "$.action"), _text(a, "$.type"), F.lit(""))
    code = F.coalesce(*[filled(_text(a, f"$.{f}")) for f in CODE_FIELDS], F.lit(""))
    inner = _text(a, "$.fixture_data.page_type")
    page_type = F.when(action == "reclassify_page", F.coalesce(filled(_text(a, "$.page_type")), filled(inner), F.lit("lighting_plan"))).when(action == "split_page", F.coalesce(inner, F.lit("lighting_plan"))).otherwise(inner)
    listed = lambda path: F.nullif(F.to_json(F.try_variant_get(a, path, "variant")), F.lit("[]"))
    views = F.when(action == "split_page", F.coalesce(listed("$.viewports"), listed("$.fixture_data.viewports"), F.lit("[]")))
    return F.struct(action.alias("action"), code.alias("fixture_code"), F.coalesce(_text(a, "$.reason"), F.lit("other")).alias("reason"), page_type.alias("page_type"), views.alias("viewports"))


def actions(answer: Column) -> Column:
    """array<struct<action, fixture_code, reason, page_type, viewports>> of an answer.

    ``type`` may stand for ``action``; the first of the code fields that is not empty is the
    code; a page's new type and a split's viewports may lie in ``fixture_data`` or beside it
    and have defaults. Elements that are no objects are left out. Answers without a closed fence, with
    broken JSON or with a highlight have no actions.
    """
    held = F.try_variant_get(answer_object(answer), "$.actions", "array<variant>")
    objects = F.filter(held, lambda a: F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False)))
    empty = F.array().cast("array<struct<action:string,fixture_code:string,reason:string,page_type:string,viewports:string>>")
    return F.when(answer_kind(answer) == "actions", F.coalesce(F.transform(objects, _action), empty)).otherwise(empty)


def resolved(found: DataFrame, pages: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Adds ``page_id`` and ``known`` to actions (source_key, action, fixture_code, ...).

    Page actions name a page by its number or its sheet code (of several the one with the
    smallest id), others a fixture of the source. ``pages``: source_key, page_id, page_number,
    sheet_code; ``fixtures``: source_key, code. Case does not matter.
    """
    of_page = F.col("action").isin("reclassify_page", "split_page")
    names = pages.select("source_key", "page_id", F.explode(F.array(F.col("page_number").cast("string"), F.upper("sheet_code"))).alias("_name")).filter("_name IS NOT NULL AND _name <> ''").groupBy("source_key", "_name").agg(F.min("page_id").alias("page_id"))
    codes = fixtures.select("source_key", F.upper("code").alias("_name")).distinct().withColumn("_fixture", F.lit(True))
    asked = found.withColumn("_name", F.upper("fixture_code"))
    both = asked.join(names, ["source_key", "_name"], "left").join(codes, ["source_key", "_name"], "left")
    return both.select(*found.columns, F.when(of_page, F.col("page_id")).alias("page_id"), F.when(of_page, F.col("page_id").isNotNull()).otherwise(F.coalesce("_fixture", F.lit(False))).alias("known"))
