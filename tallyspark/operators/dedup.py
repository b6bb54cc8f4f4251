"""Which row of several stands: first, last, most complete or longest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str | Column], order: list[Column], null_keys_stay: bool = False) -> DataFrame:
    """The first row of each key in ``order``. Rows with a null key can be let through."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("_rank", rank)
    keep = F.col("_rank") == 1
    if null_keys_stay:
        for k in keys:
            keep = keep | (F.col(k) if isinstance(k, str) else k).isNull()
    return ranked.filter(keep).drop("_rank")


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    return keep_one(df, [key], [F.col(seq).asc()])


def keep_last(df: DataFrame, key: str | Column, seq: str) -> DataFrame:
    """The last revision of a code; rows without a code all stay."""
    return keep_one(df, [key], [F.col(seq).desc()], null_keys_stay=True)


def filled(fields: list[str]) -> Column:
    """How many of the fields are not blank."""
    return sum((F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))


def keep_most_complete(df: DataFrame, key: str, fields: list[str], seq: str) -> DataFrame:
    return keep_one(df, [key], [filled(fields).desc(), F.col(seq).asc()])


def keep_longest(df: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    return keep_one(df, [key], [F.length(text).desc(), F.col(seq).asc()])
