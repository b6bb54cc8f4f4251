"""Connected components of a graph of links, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``id``, ``component``) for every end of a link; the component is its smallest id.

    In each round every vertex moves to the vertex with the smallest hash within two
    links, twice over, and the links move with their ends: a star is done in one round,
    and as hashes, not ids, order the vertices, a long chain shrinks by a constant
    factor. Rounds are written to the shared folder.
    """
    edges = saved(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    labels = None
    number = 0
    while not edges.isEmpty():
        number += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(number)).alias("h"), F.col("v").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(number)).alias("h"), F.col("u").alias("id"))
        near = best.select(F.col("u").alias("v"), F.least("m", own).alias("m"))
        hop = saved(both.join(near, "v").groupBy("u").agg(F.min("m").alias("m")).select("u", F.col("m.id").alias("to")), "hop")
        then = hop.select(F.col("u").alias("to"), F.col("to").alias("end"))
        one, hop = hop, saved(hop.join(then, "to").select("u", F.col("end").alias("to")), "hop")
        discard(one)
        old = labels
        if labels is None:
            labels = saved(hop.select(F.col("u").alias("id"), F.col("to").alias("label")), "labels")
        else:
            labels = saved(labels.join(hop, labels["label"] == hop["u"], "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        left = edges.join(hop.select("u", F.col("to").alias("x")), "u").join(hop.select(F.col("u").alias("v"), F.col("to").alias("y")), "v")
        last, edges = edges, saved(left.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        discard(old, hop, last)
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    out = saved(labels.join(least, "label").select("id", "component"), "components")
    discard(labels, edges)
    return out
