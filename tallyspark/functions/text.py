"""Scalar text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of sheet codes and file names, words of chat intents, words before a cross-reference.
SHEET_CODES = [r"\b(E[0-9]{1,3}(?:\.[0-9]{1,3})?[A-Za-z]?)\b", r"\b([A-Z]{1,3}[0-9]{3,}-[0-9]{2,3})\b", r"\b([A-Z]{1,2}[0-9]{1,4}[A-Za-z]?)\b"]
FILE_NAME = r"(?i)^([0-9]+)---([A-Za-z0-9.]+)\s+(.+)\.pdf$"
NOT_A_CODE = r"^(FE|SS|TR|JR|LP|CS|DP|VFD|UPS)[0-9]"
PLAN_CODE = r"\b([A-Za-z]{1,3}[0-9]+[A-Za-z]?)\b"
FIXTURE_REFERENCE = r"\b([A-Z]{1,2}[0-9]{1,2})\b"
INTENTS = {
    "correction": [
        "should be", "is wrong", "incorrect", "fix ", "fix it", "change to", "correct ", "not right", "missing", "remove", "add fixture", "count should", "actually", "overcounted", "undercounted",
        "too many", "too few", "reprocess", "recount", "re-run", "redo", "run again", "process only", "only process", "not a lighting", "not lighting", "is a lighting", "is lighting", "demolition",
        "skip page", "skip these", "don't process", "do not process", "ignore page", "we have to process", "need to process", "subplan", "sub-plan", "sub plan", "viewport", "find inventory",
        "find fixture", "find the inventory", "embedded plan", "embedded lighting", "process this", "count this", "count these", "count the", "this is a", "this page is", "this page has",
        "schedule is on", "schedule on page", "schedule on this", "has a schedule", "has schedule", "has fixtures", "look at", "check this", "check page", "combo page", "combo", "both schedule and",
        "reclassify", "classify as", "mark as", "split this", "split page", "has two", "has multiple", "is not a", "is not lighting", "not a schedule", "these are", "those are", "that is", "highlight",
        "show me where", "show position", "show marker", "locate", "find on plan", "where is fixture", "where are", "toggle is wrong", "markers are wrong", "positions are wrong", "inventory is right",
        "inventory is wrong", "count is right", "count is wrong", "toggle is right", "not showing", "not displayed", "doesn't show", "does not show", "can't see", "cannot see", "not visible",
        "not appearing", "left panel", "leftpanel", "pdf viewer", "selected fixture", "show the", "display the", "show fixture", "show inventory",
    ],
    "param_change": ["tolerance", "threshold", "dpi", "increase", "decrease", "set", "parameter", "font size", "sensitivity", "keynote max", "vision counting", "render"],
    "question": ["why", "how many", "what is", "explain", "which", "where", "tell me", "show me", "can you", "did you", "?"],
}
CROSS_WORDS = ["see", "sheet", "refer", "reference", "plan", "dwg", "drawing"]
#: (pattern of a viewport's title, label; {0} stands for the pattern's group)
VIEWPORT_LABELS = [
    (r"level\s+([0-9]+)", "L{0}"),
    (r"(mezzanine|mezz)", "MEZ"),
    (r"(basement|bsmt)", "BSM"),
    (r"([0-9]+)\s*(st|nd|rd|th)\s*floor", "FL{0}"),
    (r"floor\s+([0-9]+)", "FL{0}"),
    (r"(roof|rooftop)", "RF"),
    (r"(penthouse|penth)", "PH"),
    (r"(garage|parking)", "GAR"),
    (r"area\s+['\"]?([A-Za-z0-9]+)['\"]?", "A{0}"),
]
PLAIN_TITLE_WORDS = ["enlarged", "lighting", "plan", "electrical", "layout", "partial"]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def safe_name(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), 1, most)


def source_key(path: Column) -> Column:
    """A readable name with the first digits of the path's hash."""
    return F.concat(safe_name(F.regexp_extract(path, r"([^/]*)$", 1)), F.lit("_"), F.substring(F.md5(path.cast("binary")), 1, 8))


def file_order(name: Column) -> Column:
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(name, r"^([0-9]+)", 1), F.lit("")).cast("int"), F.lit(999999)), F.lower(name))


def file_parts(name: Column) -> Column:
    """struct<code, title> of ``NNN---CODE TITLE.pdf``, or a sheet code anywhere in the name."""
    code = F.nullif(F.regexp_extract(name, FILE_NAME, 2), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(name, r"(E[0-9]{1,3}(?:\.[0-9]{1,3})?[A-Za-z]?)", 1), F.lit(""))
    return F.struct(F.upper(F.coalesce(code, anywhere)).alias("code"), F.nullif(F.regexp_extract(name, FILE_NAME, 3), F.lit("")).alias("title"))


def last_sheet_code(text: Column) -> Column:
    """Tier by tier, the code of the last line that has one."""
    lines = F.reverse(F.split(text, "\n"))
    tiers = [F.get(F.filter(F.transform(lines, _extract(p)), lambda x: x != ""), F.lit(0)) for p in SHEET_CODES]
    return F.upper(F.coalesce(*tiers))


def _extract(pattern: str):
    return lambda line: F.regexp_extract(F.trim(line), pattern, 1)


def longest_line(text: Column) -> Column:
    """The longest line that is no code; the first on ties."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[A-Za-z]{1,3}[0-9]+(\.[0-9]+)?[A-Za-z]{0,2}$"))
    ranked = F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("t")))
    return F.array_max(ranked)["t"]


def plan_codes(text: Column) -> Column:
    """Distinct codes in a text: short, and none of the equipment names."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PLAN_CODE), 1), lambda c: F.upper(c)))
    return F.array_sort(F.filter(found, lambda c: (F.length(c) <= 6) & ~c.rlike(NOT_A_CODE)))


def index_line(line: Column) -> Column:
    """struct<code, title> of a line of a sheet index, in its three forms."""
    forms = [(r"^([A-Za-z]{1,3}[0-9]+(?:\.[0-9]+)?[A-Za-z]{0,2})\s{2,}(.+)$", 1, 2), (r"^([A-Za-z]{1,3}[0-9]{3,}-[0-9]{2,3})\s{2,}(.+)$", 1, 2), (r"^(.+?)\s{2,}([A-Za-z]{1,3}[0-9]+(?:\.[0-9]+)?[A-Za-z]{0,2})$", 2, 1)]
    out = None
    for pattern, code, title in forms:
        hit = F.struct(F.upper(F.regexp_extract(line, pattern, code)).alias("code"), F.trim(F.regexp_extract(line, pattern, title)).alias("title"))
        out = F.when(line.rlike(pattern), hit) if out is None else out.when(line.rlike(pattern), hit)
    return out


def code_of_cell(cell: Column) -> Column:
    """A code that stands alone in a cell or before a short quantity."""
    c = F.trim(cell)
    first, rest = F.regexp_extract(c, r"^(\S+)", 1), F.trim(F.regexp_extract(c, r"^\S+\s+(.*)$", 1))
    ok = first.rlike(r"^[A-Za-z][A-Za-z0-9./-]{0,9}$")
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9./-]{0,9}$"), c).when(ok & (rest != "") & ((F.length(rest) <= 5) | rest.rlike("^[0-9]+$")), first).otherwise("")


def intent_scores(text: Column) -> Column:
    low = F.lower(text)
    return F.struct(*[sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias(name) for name, words in INTENTS.items()])


def intent(scores: Column) -> Column:
    """Two words of a correction or a parameter change decide, then a question, then single words."""
    c, p, q = scores["correction"], scores["param_change"], scores["question"]
    return F.when(c >= 2, "correction").when(p >= 2, "param_change").when((q >= 1) & (c == 0), "question").when(c >= 1, "correction").when(p >= 1, "param_change").otherwise("general")


def viewport_label(title: Column) -> Column:
    out = None
    for pattern, label in VIEWPORT_LABELS:
        value = F.concat(F.lit(label.replace("{0}", "")), F.regexp_extract(title, f"(?i){pattern}", 1)) if "{0}" in label else F.lit(label)
        hit = title.rlike(f"(?i){pattern}")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    words = F.filter(F.split(F.trim(title), r"\s+"), lambda w: ~F.lower(w).isin(PLAIN_TITLE_WORDS) & (F.length(w) > 1))
    return out.when(F.size(words) > 0, F.upper(F.substring(F.get(words, F.lit(0)), 1, 3))).otherwise("VP")
