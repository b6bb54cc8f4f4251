"""The greedy distance rule: of points too near each other the first one stands.

In order of priority a point is kept if no kept point is nearer than the distance. Groups of
a bounded size (a page's matches of a code) are decided in order, each in one task. A larger
group is decided in rounds over all of Spark, until what is left of it is small enough:
whether a point stands depends only on earlier ones near it, so a point stands when no
earlier undecided point is near, and what is near a standing point goes.

In rounds, points lie in grid cells so small that two of one cell are always too near. A cell
then has one candidate a round, its first undecided point, and only candidates are sent to the
cells around; a crowd in one cell is decided by its first point and never met in pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import dropped, written

#: Rows of a group that one task decides.
FEW = 20_000


def _cells(reach: int) -> Column:
    """Steps to the cells that a near point may lie in."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    return F.array(*[F.struct(F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy")) for a, b in steps])


def apart(points: DataFrame, keys: list[str], order: list[str], distance: float, x: str = "x", y: str = "y", few: int = FEW) -> DataFrame:
    """The rows of ``points`` that stand, each group of ``keys`` for itself.

    ``order`` decides who comes first and must tell all rows of a group apart, or rows that
    agree in it stand or go together. Coordinates that are null, infinite or no numbers are near
    nothing; null keys are a group like others; an empty table stays empty. ``points`` is
    read twice: pass a table, not a long plan.
    """
    side = distance * 0.7071  # below the square root of a half: no two points of a cell are apart
    names = [f"_o{k}" for k in range(len(order))]
    rank = [F.col(c).alias(n) for c, n in zip(order, names)]
    at = F.col(x).cast("double"), F.col(y).cast("double")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    known = finite(at[0]) & finite(at[1])
    # one column tells the groups apart, also where a key is null
    group = F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("")
    state = written(points.filter(known).select(group.alias("_g"), *rank, at[0].alias("_x"), at[1].alias("_y")), "undecided")
    decided: list[DataFrame] = []
    while True:
        large = state.groupBy("_g").count().filter(F.col("count") > few).select("_g")
        small = state.join(large, "_g", "left_anti")
        decided.append(written(small.groupBy("_g").applyInPandas(_in_order(names, distance), small.schema).select("_g", *names), "standing"))
        rest = state.join(large, "_g", "left_semi")
        if rest.isEmpty():
            break
        near = written(_met(rest, names, distance, side), "near")
        blocked = near.filter(F.struct(*names) < F.col("_f")).select("_g", "_f").distinct()
        stands = near.join(blocked, ["_g", "_f"], "left_anti")
        decided.append(written(stands.select("_g", "_f.*").distinct(), "standing"))
        gone = stands.select("_g", *names).distinct()
        left = written(rest.join(gone, (rest["_g"] == gone["_g"]) & F.struct(*[rest[n] for n in names]).eqNullSafe(F.struct(*[gone[n] for n in names])), "left_anti"), "undecided")
        dropped(state, near)
        state = left
    dropped(state)
    stays = decided[0]
    for more in decided[1:]:
        stays = stays.unionByName(more)
    marked = points.withColumns({"_g": group, "_known": known, "_o": F.struct(*rank)})
    stays = stays.select(F.col("_g").alias("_sg"), F.struct(*names).alias("_so"))
    found = marked.filter("_known").join(stays.hint("merge"), (F.col("_g") == F.col("_sg")) & F.col("_o").eqNullSafe(F.col("_so")), "left_semi")
    return found.unionByName(marked.filter("NOT _known")).select(*points.columns)


def _in_order(names: list[str], distance: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One group, point after point."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(names, kind="stable", na_position="first")
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        chosen = []
        for x, y in zip(group["_x"], group["_y"]):
            c = (int(x // distance), int(y // distance))
            close = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in cells.get((c[0] + i, c[1] + j), ()))
            ok = not any((x - a) ** 2 + (y - b) ** 2 < distance * distance for a, b in close)
            chosen.append(ok)
            if ok:
                cells.setdefault(c, []).append((x, y))
        return group[chosen]

    return keep


def _met(state: DataFrame, names: list[str], distance: float, side: float) -> DataFrame:
    """(group, point, candidate) for points and the candidates of cells around that are near,
    of its own cell too: every point meets one candidate at least."""
    cell = ["_g", "_cx", "_cy"]
    placed = state.withColumns({"_cx": F.floor(F.col("_x") / side), "_cy": F.floor(F.col("_y") / side)})
    first = placed.groupBy(*cell).agg(F.min(F.struct(F.struct(*names).alias("f"), "_x", "_y")).alias("_c"))
    sent = first.withColumn("_s", F.explode(_cells(2))).select("_g", (F.col("_cx") + F.col("_s.dx")).alias("_cx"), (F.col("_cy") + F.col("_s.dy")).alias("_cy"), F.col("_c.f").alias("_f"), F.col("_c._x").alias("_fx"), F.col("_c._y").alias("_fy"))
    square = (F.col("_x") - F.col("_fx")) ** 2 + (F.col("_y") - F.col("_fy")) ** 2
    return placed.join(sent, cell).filter(square < distance * distance).select("_g", *names, "_f")


def with_added(points: DataFrame, added: DataFrame, keys: list[str], seq: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """The rows of ``added`` that count: not within ``radius`` of a point of their group, nor
    of one added before them (by ``seq``) that counts."""
    from .spatial import near_pairs

    mine = added.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
    there = points.select(*keys, F.col(x).cast("double").alias("rx"), F.col(y).cast("double").alias("ry"))
    known = near_pairs(mine.select(*keys, seq, "x", "y"), there, radius, keys).select(*keys, seq).distinct()
    return apart(added.join(known.hint("merge"), [*keys, seq], "left_anti"), keys, [seq], radius, x, y)
