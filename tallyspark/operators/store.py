"""Tables with keys on plain files: latest row wins, tenants apart, usage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key; one aggregation of both tables, no join."""
    every = existing.unionByName(changes)
    rest = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def of_tenant(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    return df.filter(F.col(column) == tenant)


def recent(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*[c.desc() for c in order]))).filter(F.col("_k") <= n).drop("_k")


def review_status(plans: DataFrame, reviews: DataFrame, corrections: DataFrame) -> DataFrame:
    """(plan, status, corrections): plans without a review are pending."""
    counted = corrections.groupBy("plan").agg(F.count("*").alias("n"))
    return plans.join(reviews, "plan", "left").join(counted, "plan", "left").select("plan", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("n", F.lit(0)).alias("corrections"))
