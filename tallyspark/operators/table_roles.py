"""Tables without usable headings: what their columns and cells are is read from the cells.

Cells are rows (table_id, row_idx, col_idx, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from .tables import CELL_KINDS, clean_cell

# Words that a luminaire schedule holds (two of them at least), labels of an
# index's columns, the pattern of a sheet code, and words in the heading of a schedule on a plan.
SCHEDULE_WORDS = ["led", "fixture", "luminaire", "lamp", "lumen", "watt", "volt", "dimm", "recessed", "surface", "pendant", "mount", "ceiling", "wall", "fluorescent", "light", "troffer", "downlight", "schedule", "description", "type"]
CODE_LABELS = ["sheet", "number", "no", "code", "dwg", "drawing"]
TITLE_LABELS = ["description", "name", "title", "sheet name"]
INDEX_CODE = r"^[A-Za-z]{1,3}[0-9]+([.\-][0-9]+)?[A-Za-z]{0,2}$"
GUESS_CODE = r"^[A-Za-z]{1,3}[0-9]+(\.[0-9]+)?[A-Za-z]{0,2}$"
PLAN_TABLE_WORDS = ["luminaire", "fixture", "mark", "lamp", "lumen", "voltage", "mounting", "watt"]
KINDS = [k for k, _, _ in CELL_KINDS]


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _holds_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def fields_of_row(cells: Column) -> Column:
    """The fields that an array of trimmed, non-empty cells (t, hits) fills.

    Cells are taken in order; each asks the kinds in their order for the first that it matches
    and that is still free, and fills it unless it is too long for it. Of the cells left the
    longest one (the first of them) is the description if it has over 10 characters, and then the first with
    a dash or slash, over 5 characters and no digit in front is the style.
    """
    none = F.lit(None).cast("string")
    start = F.struct(*[none.alias(k) for k in KINDS], F.array().cast("array<string>").alias("rest"))

    def step(held: Column, cell: Column) -> Column:
        chosen = F.lit(-1)
        for k in reversed(range(len(KINDS))):
            chosen = F.when(cell["hits"][k] & held[KINDS[k]].isNull(), k).otherwise(chosen)
        fits = F.lit(False)
        for k, (_, _, most) in enumerate(CELL_KINDS):
            fits = F.when(chosen == k, F.lit(True) if most is None else F.length(cell["t"]) < most).otherwise(fits)
        return F.struct(*[F.when((chosen == k) & fits, cell["t"]).otherwise(held[name]).alias(name) for k, name in enumerate(KINDS)], F.when(fits, held["rest"]).otherwise(F.concat(held["rest"], F.array(cell["t"]))).alias("rest"))

    return F.aggregate(cells, start, step)


def headerless_records(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, code, description, fixture_style, voltage, mounting, lumens, cct, dimming, max_va).

    A row counts if its first cell holds a code (no plain word of over three letters) and another cell
    is not empty; a table counts if it holds two schedule words. What is missing is "".
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    sane = cells.groupBy("table_id").agg(sum((F.max(low.contains(w).cast("int")) for w in SCHEDULE_WORDS), F.lit(0)).alias("n")).filter("n >= 2").select("table_id")
    mine = cells.join(sane, "table_id", "left_semi").withColumn("t", _stripped(F.col("text"))).filter("t <> ''")
    hits = F.array(*[F.col("t").rlike(p) for _, p, _ in CELL_KINDS])
    one = F.struct("col_idx", "t", F.when(F.col("col_idx") > 0, hits).alias("hits"))
    rows = mine.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(one)).alias("c"))
    first = rows.filter((F.col("c")[0]["col_idx"] == 0) & (F.size("c") > 1)).withColumn("code", texts.code_of_cell(F.col("c")[0]["t"]))
    named = first.filter((F.col("code") != "") & ~F.col("code").rlike(r"^\p{L}{4,}$"))
    found = named.withColumn("f", fields_of_row(F.slice("c", 2, F.size("c") - 1)))
    longest = F.aggregate("f.rest", F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))
    said = found.withColumn("description", F.when(F.length(longest) > 10, longest))
    others = F.when(F.col("description").isNull(), F.col("f.rest")).otherwise(F.concat(F.slice("f.rest", 1, F.array_position("f.rest", F.col("description")).cast("int") - 1), F.slice("f.rest", F.array_position("f.rest", F.col("description")).cast("int") + 1, F.size("f.rest"))))
    style = F.get(F.filter(others, lambda t: (F.length(t) > 5) & t.rlike("[-/]") & ~t.rlike(r"^\p{Nd}")), 0)
    full = said.withColumn("fixture_style", style)
    fields = {"description": F.col("description"), "fixture_style": F.col("fixture_style"), **{k: F.col(f"f.{k}") for k in ("voltage", "mounting", "lumens", "cct", "dimming", "max_va")}}
    return full.select("table_id", "row_idx", "code", *[F.coalesce(v, F.lit("")).alias(k) for k, v in fields.items()])


def index_columns(cells: DataFrame) -> DataFrame:
    """(table_id, code_col, title_col) of tables that may be a sheet index.

    By the heading row: the rightmost column labelled as a code and the nearest labelled title
    right of it (else the rightmost one). Where one is missing both are guessed: the column
    with the most codes and short texts, and of the others that with the most long texts.
    """
    low = F.lower(clean_cell(F.col("text")))
    heads = cells.filter((F.col("row_idx") == 0) & (low != "")).select("table_id", "col_idx", _holds_any(low, CODE_LABELS).alias("c"), _holds_any(low, TITLE_LABELS).alias("t"))
    code = heads.filter("c").groupBy("table_id").agg(F.max("col_idx").alias("code_col"))
    titles = heads.filter("t").join(code, "table_id").groupBy("table_id", "code_col")
    labelled = titles.agg(F.coalesce(F.min(F.when(F.col("col_idx") > F.col("code_col"), F.col("col_idx"))), F.max("col_idx")).alias("title_col"))
    shape = cells.groupBy("table_id").agg((F.max("col_idx") + 1).alias("width"), (F.max("row_idx") + 1).alias("height")).filter("width >= 2 AND height >= 2")
    t = _stripped(F.col("text"))
    score = F.when(t == "", 0).when(t.rlike(GUESS_CODE), 2).when(F.length(t) <= 10, 1).otherwise(0)
    body = cells.join(labelled, "table_id", "left_anti").filter("row_idx > 0").groupBy("table_id", "col_idx").agg(F.sum(score).alias("codes"), F.count_if(F.length(t) > 15).alias("longs"))
    columns = shape.join(labelled, "table_id", "left_anti").select("table_id", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("col_idx"))
    scored = columns.join(body, ["table_id", "col_idx"], "left").na.fill(0, ["codes", "longs"])
    best = scored.groupBy("table_id").agg(F.max_by("col_idx", F.struct("codes", -F.col("col_idx"))).alias("code_col"), F.max("codes").alias("most")).filter("most > 0")
    guessed = scored.join(best, "table_id").filter("col_idx <> code_col").groupBy("table_id", "code_col").agg(F.max_by("col_idx", F.struct("longs", -F.col("col_idx"))).alias("title_col"))
    return labelled.select("table_id", "code_col", "title_col").unionByName(guessed.select("table_id", "code_col", "title_col")).join(shape.select("table_id"), "table_id", "left_semi")


def index_entries(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(table_id, row_idx, part, code, title): the sheet index that tables hold.

    The first row is an entry too if its code cell holds one. Cells of as many lines, more than one, are
    one entry a line pair; others are one entry with their white space as single spaces.
    """
    columns = index_columns(cells) if columns is None else columns
    mine = cells.join(columns, "table_id").filter((F.col("col_idx") == F.col("code_col")) | (F.col("col_idx") == F.col("title_col")))
    value = _stripped(F.col("text"))
    pick = lambda c: F.max(F.when(F.col("col_idx") == F.col(c), value))
    rows = mine.groupBy("table_id", "row_idx").agg(pick("code_col").alias("c"), pick("title_col").alias("t")).filter("c <> '' AND t <> ''")
    codes, titles = F.split("c", "\n"), F.split("t", "\n")
    many = (F.size(codes) > 1) & (F.size(codes) == F.size(titles))
    pairs = F.transform(F.arrays_zip(codes.alias("a"), titles.alias("b")), lambda x: F.struct(_stripped(x["a"]).alias("code"), _stripped(x["b"]).alias("title")))
    one = F.array(F.struct(F.regexp_replace("c", r"\s+", " ").alias("code"), F.regexp_replace("t", r"\s+", " ").alias("title")))
    split = rows.select("table_id", "row_idx", many.alias("many"), F.posexplode(F.when(many, pairs).otherwise(one)).alias("part", "e"))
    valid = F.col("e.code").rlike(INDEX_CODE) & (F.col("e.title") != "") & ((F.col("row_idx") > 0) | ~F.col("many"))
    return split.filter(valid).select("table_id", "row_idx", "part", F.upper("e.code").alias("code"), "e.title")


def schedule_boxes(boxes: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, table_id, sx0, sy0, sx1, sy1): the luminaire schedule on each plan.

    ``boxes``: page_id, table_id, x0, y0, x1, y1. The table whose first row holds the most
    schedule words, three at least; of equal ones the first. A page has none if that table covers over half of it
    or its first row has over 500 characters, as a drawing's frame does.
    """
    text = F.coalesce("text", F.lit(""))
    head = cells.filter((F.col("row_idx") == 0) & (text != "")).groupBy("table_id").agg(sum((F.max(F.lower(text).contains(w).cast("int")) for w in PLAN_TABLE_WORDS), F.lit(0)).alias("n"), (F.sum(F.length(text)) + F.count("*") - 1).alias("chars"))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "table_id"))
    chosen = boxes.join(head, "table_id").withColumn("_k", best).filter("_k = 1 AND n >= 3 AND chars <= 500")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    page = (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0"))
    return chosen.join(pages.select("page_id", "bx0", "by0", "bx1", "by1"), "page_id").filter((page <= 0) | (area / page <= 0.5)).select("page_id", "table_id", *[F.col(c).cast("double").alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
