"""Glyphs, words, points and segments on pages: spelling, zones, enclosure, distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written

# Fixed values, in points or as parts of the page.
CHAR_GAP, CHAR_DY, BOUNDARY = 6.0, 3.0, 5.0
BORDER, LEGEND_X, TITLE_X, TITLE_Y = 0.02, 0.85, 0.80, 0.85
WIDE, TIGHT, NEAR_SAME, REJECT, ISOLATION = 1.5, 1.15, 70.0, 15.0, 15.0


def excluded(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """In the border, the legend column or the title block of a page box."""
    w, h = x1 - x0, y1 - y0
    border = (x < x0 + w * BORDER) | (x > x0 + w * (1 - BORDER)) | (y < y0 + h * BORDER) | (y > y0 + h * (1 - BORDER))
    return border | (x > x0 + w * LEGEND_X) | ((x > x0 + w * TITLE_X) & (y > y0 + h * TITLE_Y))


def spelled(glyphs: DataFrame, codes: list[str], page: str = "page_id") -> DataFrame:
    """Places where consecutive glyphs of a page spell a code: (page, code, x0, top, x1, size, char_index),
    and the first glyph's bottom where glyphs have one.

    One window over the page's stream brings each glyph the one before it and those after
    it, as far as the longest code needs; only glyphs that begin a code are looked at.
    """
    stream = Window.partitionBy(page).orderBy("char_index")
    longest = max(map(len, codes))
    one = F.struct("text", "x0", "x1", "top")
    more = ["bottom"] if "bottom" in glyphs.columns else []
    wide = glyphs.select(page, "char_index", "x0", "top", "size", *more, one.alias("_g0"), F.lag(one, 1).over(stream).alias("_before"), *[F.lead(one, k).over(stream).alias(f"_g{k}") for k in range(1, longest + 1)])
    return _spelled_from(wide.filter(F.col("_g0.text").isin(sorted({c[0] for c in codes}))), codes, page, more)


def spelled_in_runs(runs: DataFrame, codes: list[str], page: str = "page_id", glyph: Callable[[Column], Column] | None = None) -> DataFrame:
    """As ``spelled``, from runs (page, glyphs): arrays of the glyphs (char_index, text, x0, x1, top,
    size and perhaps bottom) of a stretch of the page's stream, in their order.

    Where a glyph follows from its place, runs may have ``texts``, an array of characters, instead, and
    ``glyph`` gives the glyph at a place (from 0). A run is whole: no glyph of it touches one of another run, as with lines of text. Its
    glyphs do not move, only those that begin a code become rows.
    """
    longest, firsts = max(map(len, codes)), sorted({c[0] for c in codes})
    if glyph is None:
        runs, glyph = runs.withColumn("texts", F.transform("glyphs", lambda g: g["text"])), lambda i: F.get("glyphs", i)
    def begins(i: Column) -> Column:
        hit = F.lit(False)
        for code in codes:
            same = F.get("texts", i) == code[0]
            for k, c in enumerate(code[1:], 1):
                same = same & (F.get("texts", i + k) == c)
            hit = hit | same
        return F.get("texts", i).isin(firsts) & hit

    def around(i: Column) -> Column:
        held = lambda k: F.when((i + k >= 0) & (i + k < F.size("texts")), glyph(i + k))
        return F.struct(held(-1).alias("_before"), *[held(k).alias(f"_g{k}") for k in range(longest + 1)])

    # of a run without glyphs the place 0 begins nothing; inline_outer, since Spark filters runs before an
    # inline by the size of what it spells, and so would spell them twice
    placed = runs.withColumn("_at", F.filter(F.sequence(F.lit(0), F.greatest(F.size("texts") - 1, F.lit(0))), begins))
    seen = placed.select(page, F.inline_outer(F.transform("_at", around))).filter("_g0 IS NOT NULL")
    more = ["bottom"] if "bottom" in seen.schema["_g0"].dataType.names else []
    return _spelled_from(seen.select("*", *[F.col(f"_g0.{c}").alias(c) for c in ("char_index", "x0", "top", "size", *more)]), codes, page, more)


def _spelled_from(seen: DataFrame, codes: list[str], page: str, more: list[str]) -> DataFrame:
    """The codes that begin at the glyphs ``_g0``, each with the one before it and those after it."""

    def linked(a: str, b: str) -> Column:
        """The next glyph of the same word."""
        return F.coalesce((F.col(f"{b}.x0") - F.col(f"{a}.x1")).between(-2, CHAR_GAP) & (F.abs(F.col(f"{b}.top") - F.col(f"{a}.top")) <= CHAR_DY), F.lit(False))

    def longer(a: str, b: str, other: str) -> Column:
        """A neighbour that would make the word longer."""
        touch = (F.abs(F.col(f"{b}.x0") - F.col(f"{a}.x1")) < BOUNDARY) & (F.abs(F.col(f"{b}.top") - F.col(f"{a}.top")) < CHAR_DY)
        return F.coalesce(touch & F.col(f"{other}.text").rlike(r"^[\p{L}\p{N}]$"), F.lit(False))

    out = []
    for size in sorted({len(c) for c in codes}):
        whole = F.concat(*[F.col(f"_g{k}.text") for k in range(size)])
        hit = whole.isin([c for c in codes if len(c) == size])
        for k in range(size - 1):
            hit = hit & linked(f"_g{k}", f"_g{k + 1}")
        last = f"_g{size - 1}"
        out.append(F.when(hit & ~longer(last, f"_g{size}", f"_g{size}"), F.struct(whole.alias("code"), F.col(f"{last}.x1").alias("x1"))))
    found = seen.filter(~longer("_before", "_g0", "_before")).withColumn("m", F.explode(F.filter(F.array(*out), lambda m: m.isNotNull())))
    return found.select(page, "m.code", "x0", "top", "m.x1", "size", "char_index", *more)


def of_modal_size(matches: DataFrame, page: str = "page_id") -> DataFrame:
    """Matches whose size is near the most frequent size of all matches of the page."""
    rounded = F.bround(F.col("size") * 2) / 2
    counted = matches.groupBy(page, rounded.alias("modal")).agg(F.count("*").alias("n"), F.min("char_index").alias("seen"))
    modal = counted.groupBy(page).agg(F.max_by("modal", F.struct("n", -F.col("seen"))).alias("modal"))
    both = matches.join(modal, page)
    reach = F.when(F.length("code") == 1, TIGHT).otherwise(WIDE)
    return both.filter((F.col("modal") <= 0) | (rounded.between(F.col("modal") / reach, F.col("modal") * reach))).drop("modal")


def isolated(matches: DataFrame, glyphs: DataFrame, page: str = "page_id", reach: float = ISOLATION) -> DataFrame:
    """One-letter matches without another glyph near in their row: glyphs lie in rows
    of 3 points, and a match looks two rows up and down. The matches, few of the glyphs, are
    sent to these rows; a glyph goes to its own row only.

    ``glyphs`` may be stretches, as words are: glyphs of one top from ``char_index`` to ``last_index``,
    each nearer than ``reach`` to the one before, with the x0 of the first and the x1 of the last. A window
    that meets a stretch then meets one of its glyphs, and a match in a longer stretch is not alone.
    """
    found = written(matches, "matches")  # read twice
    last = F.col("last_index" if "last_index" in glyphs.columns else "char_index")
    rows = glyphs.select(F.col(page).alias("_p"), F.col("char_index").alias("_ci"), last.alias("_li"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.floor(F.col("top") / 3).alias("_r"))
    asked = found.select(page, "char_index", "x0", "x1", "top", F.explode(F.sequence(F.floor(F.col("top") / 3) - 2, F.floor(F.col("top") / 3) + 2)).alias("_row"))
    near = ((F.col("_ci") != F.col("char_index")) | (F.col("_li") != F.col("char_index"))) & (F.col("_x1") > F.col("x0") - reach) & (F.col("_x0") < F.col("x1") + reach)
    # merge: by its estimate, that of the file they are read from, a table of glyphs may look small enough to be sent whole through the driver
    crowded = asked.join(rows.hint("merge"), (F.col(page) == F.col("_p")) & (F.col("_row") == F.col("_r")) & near, "left_semi")
    return found.join(crowded.select(page, "char_index", "x0", "x1", "top").hint("merge"), [page, "char_index", "x0", "x1", "top"], "left_anti").select(*matches.columns)


def cells_around(x: Column, y: Column, radius: float, size: float) -> Column:
    """The grid cells that points nearer than ``radius`` lie in: one to four where a cell is larger than twice that."""
    reach = lambda v: F.sequence(F.floor((v - radius) / size), F.floor((v + radius) / size))
    return F.flatten(F.transform(reach(x), lambda a: F.transform(reach(y), lambda b: F.struct(a.alias("cx"), b.alias("cy")))))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows of ``left`` (x, y) with rows of ``right`` (rx, ry) nearer than ``radius``: an equi-join on grid cells.

    Both sides grow with the pages, so neither is sent whole, however small its files are. The left
    side, mostly the smaller one, goes to the cells around."""
    size = 3 * radius  # a left row goes to 2.8 cells on average
    a = left.withColumn("_c", F.explode(cells_around(F.col("x"), F.col("y"), radius, size)))
    b = right.withColumn("_c", F.struct(F.floor(F.col("rx") / size).alias("cx"), F.floor(F.col("ry") / size).alias("cy")))
    square = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
    return a.join(b.hint("merge"), [*keys, "_c"]).withColumn("square", square).filter(F.col("square") < radius * radius).drop("_c")


def without_rejected(points: DataFrame, rejected: DataFrame, keys: list[str], id_col: str, radius: float = REJECT) -> DataFrame:
    hit = near_pairs(points, rejected, radius, keys).select(*keys, id_col).distinct()
    return points.join(hit, [*keys, id_col], "left_anti")


def enclosing_quadrants(numbers: DataFrame, segments: DataFrame, keys: list[str], id_col: str, low: float = 2.0, high: float = 10.0, least: float = 3.0) -> DataFrame:
    """(keys, id, quadrants): in how many of the four quadrants around a number's centre a segment ends."""
    long = segments.filter((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 >= least * least)
    ends = long.select(*keys, F.inline(F.array(F.struct(F.col("ax").alias("rx"), F.col("ay").alias("ry")), F.struct(F.col("bx").alias("rx"), F.col("by").alias("ry")))))
    near = near_pairs(numbers, ends, high, keys).filter(F.col("square") > low * low)
    quadrant = F.when(F.col("rx") >= F.col("x"), F.when(F.col("ry") <= F.col("y"), 1).otherwise(2)).otherwise(F.when(F.col("ry") > F.col("y"), 4).otherwise(8))
    bits = near.groupBy(*keys, id_col).agg(F.bit_or(quadrant).alias("bits"))
    return bits.select(*keys, id_col, F.bit_count("bits").cast("int").alias("quadrants"))


def lines_of_words(words: DataFrame, page: str | list[str], tolerance: float) -> DataFrame:
    """Adds ``line``: words sorted by (top, x0); a new line where the top moves by more than ``tolerance``."""
    order = Window.partitionBy(page).orderBy("top", "x0", "word_index")
    jump = F.when(F.abs(F.col("top") - F.lag("top").over(order)) > tolerance, 1).otherwise(0)
    return words.withColumn("_jump", jump).withColumn("line", F.sum("_jump").over(order)).drop("_jump")


def segments_of_lines(words: DataFrame, page: str, gap: float) -> DataFrame:
    """(page, line, segment, text): lines cut where the next word begins more than ``gap`` after the last one ends."""
    order = Window.partitionBy(page, "line").orderBy("x0", "word_index")
    cut = F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)
    parts = words.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(order))
    listed = parts.groupBy(page, "line", "segment").agg(F.array_sort(F.collect_list(F.struct("x0", "word_index", "text"))).alias("w"))
    return listed.select(page, "line", "segment", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def bounds_between(titles: DataFrame, page: str) -> DataFrame:
    """(page, label, left, right): from midpoint to midpoint of neighbouring title centres."""
    order = Window.partitionBy(page).orderBy("cx", "label")
    return titles.select(page, "label", F.coalesce((F.lag("cx").over(order) + F.col("cx")) / 2, F.lit(0.0)).alias("left"), ((F.lead("cx").over(order) + F.col("cx")) / 2).alias("right"))


def rebased(df: DataFrame, x0: Column, y0: Column) -> DataFrame:
    """Coordinates relative to the page box's corner."""
    return df.withColumns({c: F.col(c) - (x0 if c in ("x0", "x1", "cx", "x") else y0) for c in ("x0", "x1", "cx", "x", "top", "bottom", "cy", "y") if c in df.columns})


def polygon_quality(numbers: DataFrame, segments: DataFrame, keys: list[str], id_col: str, reach: float = 13.0) -> DataFrame:
    """(keys, id, segments, corners, spread) of the outline around each number.

    Segments with both ends within ``reach`` count; corners are rounded ends where exactly
    two segments meet; the spread is the population deviation of the midpoints' distances
    from the centre, 999 for fewer than two.
    """
    segs = segments.withColumn("_s", F.struct("ax", "ay", "bx", "by"))
    near = near_pairs(numbers, segs.select(*keys, F.col("ax").alias("rx"), F.col("ay").alias("ry"), "_s"), reach, keys)
    other = (F.col("_s.bx") - F.col("x")) ** 2 + (F.col("_s.by") - F.col("y")) ** 2
    inside = near.filter(other < reach * reach).select(*keys, id_col, "x", "y", "_s")
    middle = F.sqrt(((F.col("_s.ax") + F.col("_s.bx")) / 2 - F.col("x")) ** 2 + ((F.col("_s.ay") + F.col("_s.by")) / 2 - F.col("y")) ** 2)
    shape = inside.groupBy(*keys, id_col).agg(F.count("*").alias("segments"), F.when(F.count("*") >= 2, F.stddev_pop(middle)).otherwise(999.0).alias("spread"))
    ends = inside.select(*keys, id_col, F.explode(F.array(F.struct(F.round("_s.ax").alias("u"), F.round("_s.ay").alias("v")), F.struct(F.round("_s.bx").alias("u"), F.round("_s.by").alias("v")))).alias("e"))
    corners = ends.groupBy(*keys, id_col, "e").agg(F.count("*").alias("n")).groupBy(*keys, id_col).agg(F.count_if(F.col("n") == 2).alias("corners"))
    return shape.join(corners, [*keys, id_col]).select(*keys, id_col, "segments", "corners", "spread")


def near_words(matches: DataFrame, words: DataFrame, page: str, listed: list[str], dx: float = 60.0, dy: float = 10.0) -> DataFrame:
    """Matches (x, y) with one of the listed words just left of them."""
    said = words.filter(F.lower(F.regexp_replace("text", r"^[.,;:()]+|[.,;:()]+$", "")).isin(listed)).select(page, F.col("x").alias("wx"), F.col("y").alias("wy"), F.explode(F.sequence(F.floor(F.col("y") / dy) - 1, F.floor(F.col("y") / dy) + 1)).alias("_row"))
    asked = matches.withColumn("_row", F.floor(F.col("y") / dy))
    hit = (F.col("wx") < F.col("x")) & (F.col("x") - F.col("wx") < dx) & (F.abs(F.col("wy") - F.col("y")) < dy)
    return asked.join(said.withColumnRenamed(page, "_p").withColumnRenamed("_row", "_r"), (F.col(page) == F.col("_p")) & (F.col("_row") == F.col("_r")) & hit, "left_semi").drop("_row")
