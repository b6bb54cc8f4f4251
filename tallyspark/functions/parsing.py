"""JSON out of model answers: fenced, bare, or cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_body(answer: Column) -> Column:
    """The outermost object of an answer, with or without a fence around it."""
    return F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))


def counts_of(answer: Column, codes: list[str]) -> Column:
    """array<struct<code, n>>: keys without regard to case; what is missing or no number is 0."""
    held = F.map_entries(F.from_json(json_body(answer), "map<string,string>"))

    def number(code: Column) -> Column:
        same = F.filter(held, lambda e: F.lower(e["key"]) == F.lower(code))
        return F.coalesce(F.get(same, F.lit(0))["value"].try_cast("int"), F.lit(0))

    return F.transform(F.array(*map(F.lit, codes)), lambda c: F.struct(c.alias("code"), number(c).alias("n")))


def number_of(answer: Column, key: str) -> Column:
    """One whole number of a JSON object, 0 if missing or no number."""
    return F.coalesce(F.get_json_object(json_body(answer), f"$.{key}").try_cast("int"), F.lit(0))


def recovered_objects(answer: Column) -> Column:
    """The flat objects with a number that a cut-off answer still holds whole."""
    found = F.regexp_extract_all(answer, F.lit(r"(\{[^{}]*\})"), 1)
    return F.filter(found, lambda o: F.get_json_object(o, "$.number").isNotNull())


def page_labels(answer: Column, labels: list[str]) -> Column:
    """map<page, label> of an answer: whole page numbers and known labels only."""
    held = F.from_json(json_body(answer), "map<string,string>")
    return F.map_filter(held, lambda k, v: k.rlike("^[0-9]+$") & F.lower(v).isin(labels))
