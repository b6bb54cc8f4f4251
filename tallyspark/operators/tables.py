"""Semi-structured tables as cells: heading rows, table kinds, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heading words of each field, and words of tables that are (no) luminaire schedules.
HEADINGS = {
    "code": ["fixture id", "ltr type", "id", "mark", "fixture type", "fixture letter", "type", "fixture", "symbol", "designation"],
    "description": ["fixture description", "luminaire type", "description", "desc"],
    "mounting": ["mounting type", "mounting style", "mounting", "mount", "mtg"],
    "fixture_style": ["fixture style", "fixture type", "style", "catalog"],
    "voltage": ["voltage", "volts"],
    "lumens": ["rated lumen", "lumen output", "light output", "lumens", "lumen/watts", "lum", "lamps"],
    "cct": ["color temperature", "color temp", "color", "cct", "kelvin"],
    "dimming": ["ballast/driver", "ballast driver", "dimming", "dim", "driver", "ballast"],
    "max_va": ["max wattage", "max va", "input watts", "wattage", "watts", "va"],
}
STRONG = ["code", "description", "voltage", "mounting", "lumens"]
LUMINAIRE = ["luminaire schedule", "light fixture schedule", "lighting schedule", "fixture schedule", "ceiling fan schedule", "fan schedule"]
OTHER_TABLES = ["lighting control", "control device", "override switch", "floorbox", "poke thru", "panel schedule", "panelboard", "branch panel", "breaker function", "breaker schedule", "motor schedule", "equipment schedule", "equipment connection", "mechanical equipment", "branch circuit", "panel totals", "connected load", "revision", "energy compliance", "circuit description"]
# Fixed patterns: a panel's name, and what the cells of tables without headings hold.
PANEL = r"(?<!\bflat\s)(?<!\bled\s)(?<!\bat\s)\bpanel\s+(?!led\b|recessed\b|light\b|lamp\b|troffer\b|luminaire\b)[a-z0-9]"
CELL_KINDS = [
    ("cct", r"(?i)(?:\b\d{4}\s*K\b|\b(?:30|35|40|50)00\s*(?:K|LED)\b)", None),
    ("voltage", r"(?i)(?:^|\b)(?:120|277|120/277|347|480|347/600|universal|univ)(?:\b|$)", 20),
    ("dimming", r"(?i)\b(?:dimm|0-10\s*V|DALI|ELV|triac|non[- ]?dim|lutron)\b", None),
    ("lumens", r"(?i)\b(?:lumen|lum|lumens)\b|\b\d+\s*lm\b", None),
    ("mounting", r"(?i)\b(?:recessed|surface|pendant|wall|ceiling|lay[- ]?in|grid|stem|chain|track|pole|bracket|flush)\b", 30),
    ("max_va", r"(?i)\b\d+\s*(?:VA|W|watts?|watt)\b", 15),
]


def clean_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def is_data_code(c: Column) -> Column:
    """A short code of letters, digits, dots, dashes and slashes that is no plain word."""
    return F.coalesce((F.length(c) <= 15) & c.rlike(r"^[A-Za-z0-9][A-Za-z0-9./-]*$") & ~c.rlike("^[A-Za-z]{4,}$") & ~F.upper(F.rtrim(c, F.lit("."))).isin("NO", "#", "QTY", "CKT"), F.lit(False))


def holds_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def table_kind(cells: DataFrame, rows: int = 3) -> DataFrame:
    """(table_id, luminaire): by the words of its first rows; what is ambiguous passes."""
    head = cells.filter(F.col("row_idx") < rows).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    text = F.lower(F.array_join(F.transform("c", lambda x: x["text"]), " "))
    return head.select("table_id", F.when(holds_any(text, LUMINAIRE), True).when(holds_any(text, OTHER_TABLES), False).when(text.rlike(PANEL), False).otherwise(True).alias("luminaire"))


def panel_tables(records: DataFrame) -> DataFrame:
    """Tables whose codes are mostly numbers: circuits, no fixtures."""
    share = F.avg(F.when(F.trim("code").rlike("^[0-9]+$"), 1.0).otherwise(0.0))
    return records.groupBy("table_id").agg(F.count("*").alias("n"), share.alias("share")).filter("n > 5 and share >= 0.6").select("table_id")


def field_of_heading(text: Column) -> Column:
    """The field that a heading cell names: fields in order, long cells and other words none."""
    low, out = F.lower(clean_cell(text)), None
    for field, words in HEADINGS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | ((low == w) if len(w) <= 3 else low.contains(w))
        hit = hit & (F.length(low) <= 35)
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def header_rows(cells: DataFrame, rows: int = 10) -> DataFrame:
    """(table_id, row_idx, score): the row with the best heading score of the first ones; it must name a code and two fields."""
    named = cells.filter(F.col("row_idx") < rows).withColumn("field", field_of_heading(F.col("text"))).filter("field is not null")
    bit = F.coalesce(*[F.when(F.col("field") == f, F.lit(1 << k)) for k, f in enumerate(HEADINGS)])
    # dealt out by table first: a task that reads cells would hold a row of nearly each of them, as none repeats
    dealt = named.select("table_id", "row_idx", bit.alias("_bit")).repartition("table_id")
    held = dealt.groupBy("table_id", "row_idx").agg(F.bit_or("_bit").alias("_b"))
    strong = sum(1 << k for k, f in enumerate(HEADINGS) if f in STRONG)
    ok = held.withColumn("_n", F.bit_count("_b").cast("long")).filter((F.col("_b").bitwiseAND(1 << list(HEADINGS).index("code")) != 0) & (F.col("_n") >= 2))
    scored = ok.select("table_id", "row_idx", (F.col("_n") + 2 * F.bit_count(F.col("_b").bitwiseAND(strong))).alias("score"))
    best = scored.groupBy("table_id").agg(F.max(F.struct("score", (-F.col("row_idx")).alias("_at"), "row_idx")).alias("_s"))
    return best.select("table_id", "_s.row_idx", "_s.score")


def column_fields(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col_idx, field): the first column that names a field has it."""
    named = cells.join(headers.select("table_id", "row_idx"), ["table_id", "row_idx"]).withColumn("field", field_of_heading(F.col("text"))).filter("field is not null")
    return named.groupBy("table_id", "field").agg(F.min("col_idx").alias("col_idx"))


def records(cells: DataFrame, headers: DataFrame, fields: list[str]) -> DataFrame:
    """One row per data row below the header, one column per field."""
    columns = column_fields(cells, headers).groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "field"))).alias("_fields"))
    # one row a table: its heading and the field of each column; rows move by table and are put together there
    known = headers.select("table_id", F.col("row_idx").alias("_head")).join(columns, "table_id")
    named = cells.join(known.hint("merge"), "table_id").filter("row_idx > _head").select("table_id", "row_idx", F.col("_fields")[F.col("col_idx")].alias("field"), clean_cell(F.col("text")).alias("_t")).filter("field IS NOT NULL")
    wide = named.groupBy("table_id", "row_idx").agg(*[F.first(F.when(F.col("field") == f, F.col("_t")), ignorenulls=True).alias(f) for f in fields])
    return wide.filter(is_data_code(F.col("code")) if "code" in fields else F.lit(True))


def cell_kind(text: Column) -> Column:
    """What a cell of a table without headings holds; a cell that matches a pattern but is too long for it is nothing."""
    t, out = F.trim(text), None
    for kind, pattern, most in CELL_KINDS:
        value = F.lit(kind) if most is None else F.when(F.length(t) < most, kind)
        out = F.when(t.rlike(pattern), value) if out is None else out.when(t.rlike(pattern), value)
    return out


def keynotes_of_lines(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, number, text): a numbered line begins a keynote, the lines after it belong to it."""
    order = Window.partitionBy(page).orderBy("line_no")
    number = F.nullif(F.regexp_extract("text", r"^\s*([0-9]{1,2})[.)]?\s+\S", 1), F.lit(""))
    marked = lines.withColumn("_n", number).withColumn("_item", F.sum(F.when(number.isNotNull(), 1).otherwise(0)).over(order)).filter("_item > 0 and trim(text) <> ''")
    body = F.when(F.col("_n").isNotNull(), F.regexp_replace("text", r"^\s*[0-9]{1,2}[.)]?\s+", "")).otherwise(F.col("text"))
    listed = marked.groupBy(page, "_item").agg(F.max("_n").alias("number"), F.array_sort(F.collect_list(F.struct("line_no", F.trim(body).alias("t")))).alias("l"))
    return listed.select(page, F.col("_item").cast("long").alias("item"), "number", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("text"))


def merged_headers(first: Column, second: Column) -> Column:
    """Two heading rows (arrays of cells) as one: cells that both have text are put together."""
    return F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda x: F.concat_ws(" ", F.nullif(F.trim(x["a"]), F.lit("")), F.nullif(F.trim(x["b"]), F.lit(""))))


def embedded_value(text: Column, field: Column) -> Column:
    """What a heading cell of a known field holds behind its heading; null if nothing.

    With a line break, what stands behind the first; else what follows the longest of the
    field's heading words in the cell.
    """
    low, out = F.lower(clean_cell(text)), None
    for name, words in HEADINGS.items():
        rests = []
        for order, w in enumerate(words):
            if len(w) <= 3:
                rest = F.when(low.startswith(w + " "), F.trim(F.substring(text, len(w) + 1, 10_000))).when(low == w, "")
            else:
                rest = F.when(low.contains(w), F.trim(F.substr(text, F.instr(low, w) + len(w))))
            rests.append(F.when(rest.isNotNull(), F.struct(F.lit(len(w)).alias("size"), F.lit(-order).alias("order"), rest.alias("rest"))))
        best = F.array_max(F.array(*rests))["rest"]
        out = F.when(field == name, best) if out is None else out.when(field == name, best)
    behind = F.trim(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1))
    return F.nullif(F.when(text.contains("\n"), behind).otherwise(out), F.lit(""))
