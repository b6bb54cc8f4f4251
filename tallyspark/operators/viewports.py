"""Viewports of a page: titles from words, and the boxes that titles divide a page into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import lines_of_words

# Words of titles, and parts of a page's width or height.
LIGHTING = r"(?i)lighting\s+plan|enlarged\s+lighting|lighting\s+layout"
NON_LIGHTING = r"(?i)power\s+plan|power\s+&|systems\s+plan|demolition|demo\s+plan|signal\s+plan|fire\s+alarm|mechanical|plumbing"
QUALIFIER = r"(?i)level|floor|area|enlarged|partial|basement|mezzanine|roof|penthouse|garage|upper|lower|main"
BAND_RIGHT, BAND_TOP, BAND_BOTTOM = 0.75, 0.82, 0.97
WHOLE_RIGHT, TITLE_GAP, APART, ROW_DY = 0.65, 0.03, 0.10, 0.03


def titles_of_words(words: DataFrame, page: str | list[str], width: float, tolerance: float = 5.0) -> DataFrame:
    """(page, text, cx, cy, lighting): segments of word lines that name a plan.

    ``words``: page, word_index, text, x0, x1, top, bottom. A segment that names a
    lighting plan and another one counts as the other.
    """
    keys = [page] if isinstance(page, str) else page
    lined = lines_of_words(words, keys, tolerance)
    order = Window.partitionBy(*keys, "line").orderBy("x0", "word_index")
    cut = F.when(F.col("x0") - F.lag("x1").over(order) > width * TITLE_GAP, 1).otherwise(0)
    parts = lined.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(order))
    listed = parts.groupBy(*keys, "line", "segment").agg(
        F.array_sort(F.collect_list(F.struct("x0", "word_index", "text"))).alias("_w"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.avg((F.col("top") + F.col("bottom")) / 2).alias("cy")
    )
    named = listed.select(*keys, F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), "cx", "cy")
    return named.filter(F.col("text").rlike(LIGHTING) | F.col("text").rlike(NON_LIGHTING)).select(*keys, "text", "cx", "cy", (~F.col("text").rlike(NON_LIGHTING)).alias("lighting"))


def cropped_titles(words: DataFrame, page: str, width: float, height: float) -> DataFrame:
    """(page, region, text, cx, cy, lighting): titles of the bottom band and of the page left of
    the notes, each read from the words that lie wholly in it, so that a word outside does not join
    a line inside."""
    within = (F.col("x0") >= 0) & (F.col("top") >= 0) & (F.col("bottom") <= height)
    band = within & (F.col("x1") <= width * BAND_RIGHT) & (F.col("top") >= height * BAND_TOP) & (F.col("bottom") <= height * BAND_BOTTOM)
    whole = within & (F.col("x1") <= width * WHOLE_RIGHT)
    regions = F.filter(F.array(F.when(band, "band"), F.when(whole, "whole")), lambda r: r.isNotNull())
    # dealt out by page once, which serves every window and grouping up to the boxes
    keyed = words.repartition(page).withColumn("region", F.explode(regions))
    return titles_of_words(keyed, [page, "region"], width).select(page, "region", "text", "cx", "cy", "lighting")


def split_pages(titles: DataFrame, page: str, width: float, height: float) -> DataFrame:
    """Adds ``grid`` to the titles of pages with two lighting titles or more that lie apart.

    The titles in the bottom band are taken if two of them are lighting; else those of
    the whole page left of the notes that carry a qualifier (``grid``). Titles with a
    ``region`` are of the region that they were read from, others of those that hold their centre.
    """
    in_band = (F.col("cx") <= width * BAND_RIGHT) & F.col("cy").between(height * BAND_TOP, height * BAND_BOTTOM)
    on_page = (F.col("cx") <= width * WHOLE_RIGHT) & F.col("text").rlike(QUALIFIER)
    if "region" in titles.columns:
        in_band, on_page = F.col("region") == "band", (F.col("region") == "whole") & F.col("text").rlike(QUALIFIER)
    per_page = Window.partitionBy(page)
    counted = titles.withColumns({"_b": in_band, "_p": on_page}).withColumns({"_nb": F.count_if(F.col("_b") & F.col("lighting")).over(per_page), "_np": F.count_if(F.col("_p") & F.col("lighting")).over(per_page)})
    chosen = counted.filter(F.when(F.col("_nb") >= 2, F.col("_b")).otherwise((F.col("_np") >= 2) & F.col("_p"))).withColumn("grid", F.col("_nb") < 2)
    # the greatest step between neighbouring lighting titles
    order = Window.partitionBy(page, "lighting").orderBy("cx", "cy", "text")
    steps = chosen.withColumns({c: F.when(F.col("lighting"), F.abs(F.col(v) - F.lag(v).over(order))) for c, v in (("_dx", "cx"), ("_dy", "cy"))})
    apart = (F.max("_dx").over(per_page) >= width * APART) | (F.max("_dy").over(per_page) >= height * APART)
    return steps.withColumn("_apart", apart).filter("_apart").select(page, "text", "cx", "cy", "lighting", "grid")


def boxes_of_titles(titles: DataFrame, page: str, width: float, height: float) -> DataFrame:
    """(page, text, x0, y0, x1, y1): a box for each lighting title of ``split_pages``.

    Boxes end halfway between neighbouring titles; in a grid, rows of titles do so in
    height too, and a title of another plan left of a row bounds it there as well.
    """
    down = Window.partitionBy(page).orderBy("cy", "cx", "text")
    jump = F.when(F.col("grid") & (F.col("cy") - F.lag("cy").over(down) > height * ROW_DY), 1).otherwise(0)
    rows = titles.withColumn("_jump", jump).withColumn("row", F.sum("_jump").over(down))
    in_row = Window.partitionBy(page, "row")
    rows = rows.withColumns({"_c": F.avg("cy").over(in_row), "_g": F.bool_or("grid").over(in_row)})
    by_row = Window.partitionBy(page).orderBy("row")  # rows count up by one
    rows = rows.withColumns({n: F.when(F.col("_g"), (F.first("_c").over(by_row.rangeBetween(k, k)) + F.col("_c")) / 2) for k, n in ((-1, "_y0"), (1, "_y1"))})
    light = F.when(F.col("lighting"), F.col("cx"))
    ends = rows.withColumns({"_first": F.min(light).over(in_row), "_last": F.max(light).over(in_row)})
    other = F.when(~F.col("lighting"), F.col("cx"))
    ends = ends.withColumns({"_after": F.min(F.when(other > F.col("_last"), other)).over(in_row), "_before": F.max(F.when(F.col("grid") & (other < F.col("_first")), other)).over(in_row)})
    along = Window.partitionBy(page, "row").orderBy("cx", "cy", "text")
    shown = ends.filter("lighting").withColumns({"_l": F.lag("cx").over(along), "_r": F.lead("cx").over(along)})

    def half(a: str, b: str) -> Column:
        return (F.col(a) + F.col(b)) / 2

    boxes = shown.withColumns({"x0": F.coalesce(half("_l", "cx"), half("_before", "cx"), F.lit(0.0)), "x1": F.coalesce(half("cx", "_r"), half("cx", "_after"), F.lit(width))})
    return boxes.select(page, "text", "x0", F.coalesce("_y0", F.lit(0.0)).alias("y0"), "x1", F.coalesce("_y1", F.lit(height)).alias("y1"))
