"""Counting fixture codes on plans, from glyphs to counts per plan or viewport.

Steps, in order: codes are spelled on whole pages, one-letter ones only where nothing stands
near; each match goes to the viewports of its page that hold it, or to the page if it has
none; borders, legend column, title block and the schedule table are left out; sizes far from
the usual size of the view's matches go; of one-letter codes too near each other the first
stays; codes that are sheet codes too go where a word like SEE stands before them; then what
users rejected goes and what they added comes.

Relations: glyphs (page_id, char_index, text, x0, x1, top, bottom, size), pages (page_id and
the page's box bx0, by0, bx1, by1), views (page_id, view, x0, y0, x1, y1), schedules (page_id and a box
sx0, sy0, sx1, sy1), words (page_id, text, x0, x1, top, bottom), rejected (page_id, view, code, cx, cy),
added (page_id, view, code, seq, cx, cy). A page without views has the view ``""``; a null view in
rejected and added means that one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import dropped, written
from . import spatial
from .apart import apart, with_added

#: Words that point to another sheet; fixed values.
POINTERS = ["see", "sheet", "refer", "reference", "plan", "dwg", "drawing"]
VIEW = ["page_id", "view"]


@dataclass(frozen=True)
class Settings:
    """Fixed values that a user may override."""

    legend: float = spatial.LEGEND_X
    title: float = spatial.TITLE_X
    wide: float = spatial.WIDE
    tight: float = spatial.TIGHT
    near_same: float = spatial.NEAR_SAME
    reject: float = spatial.REJECT
    isolation: float = spatial.ISOLATION
    margin: float = 2.0


def views_of(pages: DataFrame, views: DataFrame | None) -> DataFrame:
    """(page_id, view, box of the page, box of the view): one row a view, or the page itself."""
    box = pages.select("page_id", "bx0", "by0", "bx1", "by1")
    if views is None:
        return box.select("page_id", F.lit("").alias("view"), "bx0", "by0", "bx1", "by1", *[F.col(c).alias(v) for c, v in zip(("bx0", "by0", "bx1", "by1"), ("vx0", "vy0", "vx1", "vy1"))])
    own = views.select("page_id", "view", *[F.col(c).cast("double").alias(f"v{c}") for c in ("x0", "y0", "x1", "y1")])
    both = box.join(own, "page_id", "left")
    whole = {f"v{c}": F.coalesce(f"v{c}", f"b{c}") for c in ("x0", "y0", "x1", "y1")}
    return both.withColumns({**whole, "view": F.coalesce("view", F.lit(""))})


def outside(x: Column, y: Column, s: Settings) -> Column:
    """Outside the view or in its border, or in the page's legend column or title block."""
    w, h = F.col("vx1") - F.col("vx0"), F.col("vy1") - F.col("vy0")
    border = (x < F.col("vx0") + w * spatial.BORDER) | (x > F.col("vx0") + w * (1 - spatial.BORDER)) | (y < F.col("vy0") + h * spatial.BORDER) | (y > F.col("vy0") + h * (1 - spatial.BORDER))
    pw, ph = F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    return border | (x > F.col("bx0") + pw * s.legend) | ((x > F.col("bx0") + pw * s.title) & (y > F.col("by0") + ph * spatial.TITLE_Y))


def in_views(matches: DataFrame, pages: DataFrame, views: DataFrame | None, schedules: DataFrame | None, s: Settings) -> DataFrame:
    """Rows with (page_id, cx, cy) once for each view that holds them outside its zones.

    The join is by page, the boxes are compared within it; a page has few views, and rows
    of a large page are split by the engine as it needs.
    """
    held = matches.join(views_of(pages, views), "page_id").filter(~outside(F.col("cx"), F.col("cy"), s)).drop("vx0", "vy0", "vx1", "vy1", "bx0", "by0", "bx1", "by1")
    if schedules is None:
        return held
    box = schedules.select(F.col("page_id").alias("_p"), "sx0", "sy0", "sx1", "sy1")
    inside = F.col("cx").between(F.col("sx0") - s.margin, F.col("sx1") + s.margin) & F.col("cy").between(F.col("sy0") - s.margin, F.col("sy1") + s.margin)
    return held.join(box, (F.col("page_id") == F.col("_p")) & inside, "left_anti")


def of_usual_size(matches: DataFrame, s: Settings) -> DataFrame:
    """Matches near the most frequent size of their view; of equally frequent ones that of
    the first match counts, codes in their order."""
    rounded = F.bround(F.col("size") * 2) / 2
    counted = matches.groupBy(*VIEW, rounded.alias("modal")).agg(F.count("*").alias("n"), F.min(F.struct("code_at", "char_index")).alias("seen"))
    order = F.struct("n", -F.col("seen.code_at"), -F.col("seen.char_index"))
    modal = counted.groupBy(*VIEW).agg(F.max_by("modal", order).alias("modal"))
    reach = F.when(F.length("code") == 1, s.tight).otherwise(s.wide)
    return matches.join(modal, VIEW).filter((F.col("modal") <= 0) | rounded.between(F.col("modal") / reach, F.col("modal") * reach)).drop("modal")


def pointed_to(matches: DataFrame, words: DataFrame, pointers: Sequence[str], dx: float = 60.0, dy: float = 10.0) -> DataFrame:
    """Matches with a pointing word just left of them, in the same view."""
    said = words.filter(F.lower(F.regexp_replace("text", r"^[.,;:()]+|[.,;:()]+$", "")).isin(list(pointers)))
    said = said.select(*[F.col(c).alias(f"_{c}") for c in VIEW], F.col("cx").alias("_wx"), F.col("cy").alias("_wy"), F.explode(F.sequence(F.floor(F.col("cy") / dy) - 1, F.floor(F.col("cy") / dy) + 1)).alias("_row"))
    same = (F.col("page_id") == F.col("_page_id")) & (F.col("view") == F.col("_view")) & (F.floor(F.col("cy") / dy) == F.col("_row"))
    left = (F.col("_wx") < F.col("cx")) & (F.col("cx") - F.col("_wx") < dx) & (F.abs(F.col("_wy") - F.col("cy")) < dy)
    return matches.join(said.hint("merge"), same & left, "left_semi")


def positions(glyphs: DataFrame, pages: DataFrame, codes: Sequence[str], views: DataFrame | None = None, schedules: DataFrame | None = None, words: DataFrame | None = None, sheet_codes: Sequence[str] = (), rejected: DataFrame | None = None, added: DataFrame | None = None, pointers: Sequence[str] = POINTERS, settings: Settings = Settings(), runs: DataFrame | None = None) -> DataFrame:
    """(page_id, view, code, cx, cy, size, char_index, user_added): what counts. Added rows
    have size 0 and char_index -1. ``runs``: the same glyphs as arrays (``spatial.spelled_in_runs``),
    which spares sorting the pages' streams; ``glyphs`` may then be stretches (``spatial.isolated``)."""
    s, codes = settings, list(dict.fromkeys(codes))
    at = F.coalesce(*[F.when(F.col("code") == c, k) for k, c in enumerate(codes)]).alias("code_at")
    spelled = spatial.spelled(glyphs, codes) if runs is None else spatial.spelled_in_runs(runs, codes)
    found = spelled.select("page_id", "code", at, "x0", "x1", "top", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("top") + F.col("bottom")) / 2).alias("cy"), "size", "char_index")
    found = every = written(found, "spelled")  # spelling costs the most: once, not for each step that reads matches
    single = [c for c in codes if len(c) == 1]
    if single:
        alone = spatial.isolated(found.filter(F.col("code").isin(single)), glyphs, reach=s.isolation)
        found = found.filter(~F.col("code").isin(single)).unionByName(alone)
    # few rows are left of the glyphs: written once, as what follows reads them more than once
    found = written(of_usual_size(in_views(found, pages, views, schedules, s), s), "matches")
    dropped(every)
    if single:
        kept = apart(found.filter(F.col("code").isin(single)), [*VIEW, "code"], ["cy", "cx", "char_index"], s.near_same, "cx", "cy")
        found = found.filter(~F.col("code").isin(single)).unionByName(kept)
    known = {c.upper() for c in sheet_codes}
    both = [c for c in codes if c.upper() in known]
    if both and words is not None:
        read = in_views(words.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2}), pages, views, schedules, s)
        point = pointed_to(found.filter(F.col("code").isin(both)), read, pointers).select(*VIEW, "code", "char_index")
        found = found.join(point.hint("merge"), [*VIEW, "code", "char_index"], "left_anti")
    key = [*VIEW, "code"]
    if rejected is not None:
        found = written(found, "matches")  # read twice; its plan would double too
        said = rejected.select("page_id", F.coalesce("view", F.lit("")).alias("view"), "code", F.col("cx").cast("double").alias("rx"), F.col("cy").cast("double").alias("ry"))
        gone = spatial.near_pairs(found.withColumns({"x": F.col("cx"), "y": F.col("cy")}), said, s.reject, key).select(*key, "char_index")
        found = found.join(gone.hint("merge"), [*key, "char_index"], "left_anti")
    out = found.select(*key, "cx", "cy", "size", "char_index", F.lit(False).alias("user_added"))
    if added is not None:
        out = written(out, "matches")
        given = added.select("page_id", F.coalesce("view", F.lit("")).alias("view"), "code", "seq", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
        given = given.join(views_of(pages, views).select(*VIEW), VIEW, "left_semi").filter(F.col("code").isin(codes))
        new = with_added(out, given, key, "seq", s.reject, "cx", "cy")
        out = out.unionByName(new.select(*key, "cx", "cy", F.lit(0.0).alias("size"), F.lit(-1).cast("long").alias("char_index"), F.lit(True).alias("user_added")))
    return out


def counts(found: DataFrame, pages: DataFrame, codes: Sequence[str], views: DataFrame | None = None) -> DataFrame:
    """(page_id, view, code, n): every code of every view, 0 where it was not found."""
    every = views_of(pages, views).select(*VIEW, F.explode(F.array(*map(F.lit, dict.fromkeys(codes)))).alias("code"))
    held = found.groupBy(*VIEW, "code").agg(F.count("*").alias("n"))
    return every.join(held, [*VIEW, "code"], "left").select(*VIEW, "code", F.coalesce("n", F.lit(0)).alias("n"))
