"""Ordered keyword rules as one CASE expression: the first rule that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[list[str], str]]

# Page types with the words that decide for them, in order of priority.
TYPE_OF_DESCRIPTION: Rules = [
    (["demolition", "demo plan", "demo "], "demolition_plan"),
    (["lighting plan", "lighting layout", "lighting area", "electrical lighting", "electrical plan"], "lighting_plan"),
    (["schedule"], "schedule"),
    (["symbol", "abbreviation", "legend"], "symbols_legend"),
    (["power plan", "power layout", "power area"], "power_plan"),
    (["signal plan", "signal layout"], "other"),
    (["site plan", "site layout"], "site_plan"),
    (["fire alarm"], "fire_alarm"),
    (["riser"], "riser"),
    (["detail"], "detail"),
    (["cover sheet", "title sheet", "coversheet"], "cover"),
]
TYPE_OF_TITLE: Rules = [
    (["demolition", "demo plan"], "demolition_plan"),
    (["site plan", "site layout", "photometric"], "site_plan"),
    (["roof electrical plan", "electrical roof plan"], "other"),
    (["cover sheet", "title sheet", "coversheet"], "cover"),
    (["electrical symbols", "abbreviation", "legend"], "symbols_legend"),
    (["panel schedule", "panelboard schedule"], "schedule"),
    (["security plan", "technology plan"], "fire_alarm"),
    (["lighting plan", "lighting layout", "electrical lighting plan"], "lighting_plan"),
    (["luminaire schedule", "light fixture schedule", "lighting schedule", "fixture schedule", "electrical schedules"], "schedule"),
    (["enlarged electrical room", "electrical room plan"], "other"),
    (["power plan", "power layout", "power &", "systems plan", "electrical plan"], "power_plan"),
    (["fire alarm"], "fire_alarm"),
    (["riser diagram", "riser"], "riser"),
    (["detail"], "detail"),
]
TYPE_OF_CONTENT: Rules = [
    (["luminaire schedule", "light fixture schedule", "lighting schedule", "fixture schedule"], "schedule"),
    (["lighting plan", "lighting layout"], "lighting_plan"),
    (["demolition plan", "demolition layout", "demo plan"], "demolition_plan"),
    (["power plan", "power layout", "receptacle plan"], "power_plan"),
    (["electrical symbols", "abbreviations", "legend"], "symbols_legend"),
    (["site plan", "site layout"], "site_plan"),
    (["fire alarm"], "fire_alarm"),
    (["riser diagram", "riser schedule"], "riser"),
    (["detail"], "detail"),
]
#: (prefix of the sheet code, page type, words of the title that decide otherwise), in order.
TYPE_OF_PREFIX: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("^E0", "symbols_legend", []),
    ("^CS$", "cover", []),
    ("^E1", "lighting_plan", [("demo", "demolition_plan")]),
    ("^E2", "lighting_plan", [("power", "power_plan"), ("signal", "other"), ("demo", "demolition_plan")]),
    ("^E3", "power_plan", [("lighting", "lighting_plan")]),
    ("^E4", "power_plan", []),
    ("^E[567]", "schedule", [("roof", "other"), ("riser", "riser")]),
    ("^E8", "detail", []),
]
#: Sentences that only point at another sheet's schedule.
CROSS_REFERENCE = r"(?:see|refer\s+to)\s+(?:sheet\s+)?(?:for\s+)?.{0,120}schedule[^.]*\.?"


def first_match(text: Column, rules: Rules) -> Column:
    """The label of the first rule one of whose words the lower-cased text holds; else null."""
    low, out = F.lower(text), None
    for words, label in rules:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def type_of_prefix(code: Column, title: Column) -> Column:
    low, out = F.lower(F.coalesce(title, F.lit(""))), None
    for pattern, label, others in TYPE_OF_PREFIX:
        value = None
        for word, other in others:
            value = F.when(low.contains(word), other) if value is None else value.when(low.contains(word), other)
        value = F.lit(label) if value is None else value.otherwise(label)
        hit = F.upper(code).rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def without_cross_references(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), CROSS_REFERENCE, "")


def page_type(index_type: Column, code: Column, title: Column, content: Column) -> Column:
    """The cascade: index entry, title, code prefix, content, other."""
    return F.coalesce(index_type, first_match(title, TYPE_OF_TITLE), type_of_prefix(code, title), first_match(without_cross_references(content), TYPE_OF_CONTENT), F.lit("other"))


def sql_first_match(text: str, rules: Rules) -> str:
    """The same rules for another SQL engine."""
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{label}'" for words, label in rules)
    return f"CASE {cases} END"


def sql_type_of_prefix(code: str, title: str) -> str:
    cases = []
    for pattern, label, others in TYPE_OF_PREFIX:
        inner = " ".join(f"WHEN contains(lower(coalesce({title}, '')), '{w}') THEN '{o}'" for w, o in others)
        cases.append(f"WHEN regexp_matches(upper({code}), '{pattern}') THEN " + (f"CASE {inner} ELSE '{label}' END" if inner else f"'{label}'"))
    return f"CASE {' '.join(cases)} END"
