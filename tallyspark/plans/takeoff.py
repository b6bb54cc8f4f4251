"""A whole take-off of one drawing set: five stages over written tables, and partial reruns.

Inputs are relations: sheets (page_id, page_number, code, title, content), cells (page_id, table_id, row_idx,
col_idx, text), boxes (page_id, table_id, x0, y0, x1, y1), and glyphs, words, segments, pages and
views as in ``counting`` and ``keynote_pages``. Corrections are events (seq, action,
fixture_code, sheet, field, value, page_type). A stage writes its tables; corrections make stages
stale by their action, and only those and the quality stage run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import corrections as corr
from ..operators import counting, dedup, keynote_pages, quality, table_roles, tables
from ..sources.written import written
from .stages import StageTables

FIELDS = ["description", "fixture_style", "voltage", "mounting", "lumens", "cct", "dimming", "max_va"]
#: The tables of each numbered stage.
TABLES = {1: ["page_types"], 2: ["fixtures"], 3: ["positions", "counts"], 4: ["keynotes"], 5: ["quality"]}
NONE = "seq long, source_key string, action string, fixture_code string, sheet string, field string, value string, page_type string"


class Takeoff:
    def __init__(self, spark: SparkSession, root: str, inputs: dict[str, DataFrame], corrections: DataFrame | None = None):
        given = spark.createDataFrame([], NONE) if corrections is None else corrections
        held = {c: (F.col(c) if c in given.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (x.split() for x in NONE.split(", "))}
        self.events = given.select(*held.values()).withColumn("source_key", F.lit("one"))
        self.hints = corr.fold(self.events)
        self.inputs = inputs
        self.stages = StageTables(spark, root, [("page_types", self.page_types), ("fixtures", self.fixtures), ("positions", self.positions), ("counts", self.counts), ("keynotes", self.keynotes), ("quality", self.quality)])

    def run(self, version: int, before: dict[str, int] | None = None) -> dict[str, int]:
        """The version of each table. With the versions of an earlier run only what the corrections
        make stale is computed; without any correction nothing but the quality is."""
        return self.stages.run(version, None if before is None else self.stale(), before)

    def stale(self) -> set[str]:
        """The tables that the corrections make stale."""
        found = corr.target_stages(self.events).first()
        return {t for s in ([int(x) for x in found.stages.split(",")] if found else [5]) for t in TABLES[s]}

    def table(self, name: str, versions: dict[str, int]) -> DataFrame:
        return self.stages.table(name, versions)

    def page_types(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        """Pages by the cascade of rules; a sheet index in their tables and user overrides come before it."""
        sheets = self.inputs["sheets"]
        listed = table_roles.index_entries(self.inputs["cells"]).groupBy(F.col("code").alias("_code")).agg(F.min_by("title", F.struct("table_id", "row_idx", "part")).alias("_listed"))
        known = sheets.join(listed, F.upper("code") == F.col("_code"), "left")
        by_rule = rules.page_type(rules.first_match(F.col("_listed"), rules.TYPE_OF_DESCRIPTION), F.col("code"), F.col("title"), F.col("content"))
        said = self.events.filter("action IN ('reclassify_page', 'split_page')").groupBy(F.upper("fixture_code").alias("_name")).agg(F.max_by(F.coalesce("page_type", F.lit("lighting_plan")), "seq").alias("_type"), F.max("seq").alias("_seq"))
        typed = known.select("page_id", "code", "title", by_rule.alias("_rule"), F.explode(F.array_distinct(F.array(F.upper("code"), F.col("page_number").cast("string")))).alias("_name"))
        both = typed.join(said, "_name", "left").groupBy("page_id").agg(F.first("code").alias("code"), F.first("title").alias("title"), F.first("_rule").alias("_rule"), F.max_by("_type", "_seq").alias("_type"))
        return both.select("page_id", "code", "title", F.coalesce("_type", "_rule").alias("page_type"))

    def fixtures(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        """Records of the luminaire tables on schedule pages and plans, the most complete of each code,
        without removed codes, with added ones and changed fields."""
        on = done["page_types"].filter("page_type IN ('schedule', 'lighting_plan')").select("page_id")
        cells = self.inputs["cells"].join(on, "page_id", "left_semi").drop("page_id")
        lights = tables.table_kind(cells).filter("luminaire").select("table_id")
        cells = written(cells.join(lights, "table_id", "left_semi"), "cells")
        heads = written(tables.header_rows(cells), "heads")
        headed = tables.records(cells, heads, ["code", *FIELDS])
        bare = table_roles.headerless_records(cells.join(heads, "table_id", "left_anti"))
        every = headed.select("table_id", "row_idx", "code", *FIELDS).unionByName(bare.select("table_id", "row_idx", "code", *FIELDS))
        every = written(every, "records")
        panels = tables.panel_tables(every)
        every = every.join(panels, "table_id", "left_anti").withColumn("seq", F.struct("table_id", "row_idx"))
        best = dedup.keep_most_complete(every, "code", FIELDS, "seq").withColumn("source_key", F.lit("one")).select("source_key", "code", *[F.coalesce(f, F.lit("")).alias(f) for f in FIELDS])
        removed = self.hints.filter("action = 'remove'").select(F.col("fixture_code").alias("code"))
        added = self.hints.filter("action = 'add'").select(F.lit("one").alias("source_key"), F.col("fixture_code").alias("code"), *[F.lit("").alias(f) for f in FIELDS]).distinct()
        kept = best.join(removed, "code", "left_anti").select("source_key", "code", *FIELDS)
        return corr.apply_spec_patches(kept.unionByName(added.join(kept, "code", "left_anti").select("source_key", "code", *FIELDS)), self.hints, FIELDS).drop("source_key")

    def positions(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        """Where the fixtures' codes stand on the lighting plans. The codes of one set are few."""
        plans = done["page_types"].filter("page_type = 'lighting_plan'")
        on = lambda name: self.inputs[name].join(plans.select("page_id"), "page_id", "left_semi")
        codes = sorted(r.code for r in done["fixtures"].select("code").distinct().collect())
        if not codes:
            return spark.createDataFrame([], "page_id long, view string, code string, cx double, cy double, size double, char_index long, user_added boolean")
        sheet_codes = sorted({r.code for r in plans.filter(F.upper("code").isin([c.upper() for c in codes])).select("code").collect()})
        pages = on("pages")
        boxes = table_roles.schedule_boxes(on("boxes"), self.inputs["cells"].drop("page_id"), pages)
        return counting.positions(on("glyphs"), pages, codes, on("views"), boxes, on("words"), sheet_codes)

    def counts(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        """(page_id, view, plan, code, n): every fixture on every view, with the users' counts.

        A view's plan is the sheet code, with the view's name behind it where a page has several."""
        plans = done["page_types"].filter("page_type = 'lighting_plan'").select("page_id", "code")
        pages = self.inputs["pages"].join(plans.select("page_id"), "page_id", "left_semi")
        codes = done["fixtures"].select("code").distinct()
        seen = done["positions"].groupBy("page_id", "view", "code").agg(F.count("*").alias("n"))
        views = counting.views_of(pages, self.inputs["views"]).select("page_id", "view")
        named = views.join(plans.withColumnRenamed("code", "sheet_code"), "page_id").withColumn("plan", F.concat_ws("-", "sheet_code", F.nullif("view", F.lit(""))))
        # every fixture on every plan is the feature; both are few in one set
        every = named.crossJoin(F.broadcast(codes)).join(seen, ["page_id", "view", "code"], "left").select("page_id", "view", "plan", "code", F.coalesce("n", F.lit(0)).alias("n"))
        over = self.hints.filter("action = 'count_override'").select(F.col("fixture_code").alias("code"), F.col("place").alias("plan"), F.col("value").try_cast("long").alias("_over"))
        return every.join(over, ["plan", "code"], "left").select("page_id", "view", "plan", "code", F.coalesce("_over", "n").alias("n"))

    def keynotes(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        on = lambda name: self.inputs[name].join(done["page_types"].filter("page_type = 'lighting_plan'").select("page_id"), "page_id", "left_semi")
        found = keynote_pages.all_keynotes(on("words"), on("segments"), on("pages"), on("views"))
        said = self.events.filter("action = 'keynote_count_override'").groupBy(F.col("fixture_code").alias("number")).agg(F.max_by(F.col("value").try_cast("long"), "seq").alias("_over"))
        return found.join(said, "number", "left").withColumn("total", F.coalesce("_over", "total")).drop("_over")

    def quality(self, spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        """One row: the four summary figures, the weighted confidence and whether it passes."""
        fixtures, counts, notes = done["fixtures"], done["counts"], done["keynotes"]
        totals = fixtures.select("code").join(counts.groupBy("code").agg(F.sum("n").alias("total")), "code", "left").select("code", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("total", F.lit(0)).alias("summed"))
        listed = table_roles.index_entries(self.inputs["cells"]).select(F.col("code").alias("sheet_code"))
        scores = [
            ("sheet_index", quality.index_score(listed, done["page_types"].withColumnRenamed("code", "sheet_code"))),
            ("schedule_extraction", quality.stage_mean(quality.schedule_items(fixtures))),
            ("fixture_counting", quality.counting_score(quality.count_items(totals))),
            ("keynote_extraction", quality.stage_mean(quality.keynote_items(notes))),
        ]
        scored = None
        for name, score in scores:
            one = score.select(F.lit(name).alias("stage"), F.col("score").cast("double").alias("score"))
            scored = one if scored is None else scored.unionByName(one)
        figures = [("fixture_types", fixtures.agg(F.count("*").alias("n"))), ("total_fixtures", counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))), ("lighting_plans", done["page_types"].agg(F.count_if(F.col("page_type") == "lighting_plan").alias("n"))), ("keynotes", notes.agg(F.count("*").alias("n")))]
        summary = None
        for name, one in figures:
            row = one.select(F.lit(name).alias("name"), "n")
            summary = row if summary is None else summary.unionByName(row)
        wide = summary.groupBy().pivot("name", [n for n, _ in figures]).agg(F.first("n"))
        return wide.crossJoin(quality.overall(scored))  # one row and one row
