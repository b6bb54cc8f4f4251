"""Keynotes: the section of a page's text, its header among words, references, corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of the section, the first that occurs counts; fixed values.
HEADERS = [r"KEY\s*NOTES\s*:", r"KEY\s*NOTES\b", r"KEYED\s+SHEET\s+NOTES?\s*:", r"KEYED\s+SHEET\s+NOTES?\b", r"KEYED\s+PLAN\s+NOTES?\s*:", r"KEYED\s+PLAN\s+NOTES?\b", r"KEYED\s+NOTES\s*:", r"KEYED\s+NOTES\b", r"KEYNOTES\s*:", r"KEYNOTES\b"]
#: Lines that end the section; fixed values.
ENDS = [r'^\d+/\d+"\s*=', r"^\s*[A-Z]{2,}\s+[A-Z]{2,}\s+[A-Z]{2,}\s+(LEVEL|PLAN|LAYOUT)", r"^\s*N\s+\d+$", r"^\s*OF$"]
#: A numbered entry and a fixture named in a text; fixed patterns.
ENTRY = r"^\s*(\d+)\s*[.):\-]?\s+([A-Z].+)"
FIXTURE_REFERENCE = r"(?i)(?:TYPE\s+|FIXTURE\s+)?([A-Z]{1,2}\d{1,2})\b"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def section(text: Column) -> Column:
    """The text from its keynotes header on, cut after the section; null without a header.

    The section ends at an end line, or at the second line in a row that is neither an
    entry nor (with over 10 characters) the continuation of one.
    """
    rest = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?is)({p}.*)$", 1), F.lit("")) for p in HEADERS])
    empty = F.array().cast("array<string>")

    def step(a: Column, line: Column) -> Column:
        plain = F.trim(line)
        over = F.lit(False)
        for p in ENDS:
            over = over | plain.rlike(p)
        entry = line.rlike(ENTRY)
        kept = entry | (a["started"] & (F.length(plain) > 10))
        misses = F.when(kept, 0).otherwise(a["misses"] + 1)
        started = a["started"] | entry
        done = a["done"] | over | ((misses >= 2) & started)
        return F.struct(done.alias("done"), started.alias("started"), misses.alias("misses"), F.when(~done & kept, F.concat(a["out"], F.array(line))).otherwise(a["out"]).alias("out"))

    def walked(lines: Column) -> Column:
        start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("started"), F.lit(0).alias("misses"), empty.alias("out"))
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.aggregate(F.slice(lines, 2, F.size(lines)), start, step)["out"]), "\n")

    return let(F.split(rest, "\n"), lambda lines: F.when(lines.isNotNull(), walked(lines)))


def header_of(words: Column) -> Column:
    """As ``with_header_x``, of one array of words (word_index, text, x0, x1, top)."""
    placed = lambda w: F.struct(*[w[c].alias(c) for c in ("word_index", "text", "x0", "x1", "top")])
    said = lambda w: F.upper(F.trim(w["text"]))

    def first(w: Column) -> Column:
        def begins(i: Column) -> Column:
            hit, so_far = F.lit(False), F.lit(True)
            for k in (1, 2, 3):
                n = F.get(w, i + k)
                so_far = so_far & F.coalesce((F.abs(n["top"] - F.get(w, i)["top"]) < 5) & (n["x0"] - F.get(w, i)["x1"] < 30), F.lit(False))
                hit = hit | (so_far & F.coalesce(said(n).contains("NOTE"), F.lit(False)))
            t = said(F.get(w, i))
            return t.isin("KEYNOTES", "KEYNOTES:") | (t.isin("KEY", "KEYED") & hit)

        return F.get(w, F.get(F.filter(F.sequence(F.lit(0), F.size(w) - 1), begins), F.lit(0)))["x0"]

    return let(F.sort_array(F.transform(words, placed)), first)


def with_header_x(words: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_hx``, where the first header of the word's page stands: one word, or KEY or KEYED
    with NOTES within three words on its line, each less than 30 behind it; null without one."""
    order = Window.partitionBy(*keys).orderBy("word_index")
    one = F.struct(F.upper(F.trim("text")).alias("t"), "x0", "top")
    ahead = words.withColumns({"_t": F.upper(F.trim("text")), **{f"_n{k}": F.lead(one, k).over(order) for k in (1, 2, 3)}})
    hit, so_far = F.lit(False), F.lit(True)
    for k in (1, 2, 3):
        n = F.col(f"_n{k}")
        so_far = so_far & F.coalesce((F.abs(n["top"] - F.col("top")) < 5) & (n["x0"] - F.col("x1") < 30), F.lit(False))
        hit = hit | (so_far & F.coalesce(n["t"].contains("NOTE"), F.lit(False)))
    first = F.when(F.col("_t").isin("KEYNOTES", "KEYNOTES:") | (F.col("_t").isin("KEY", "KEYED") & hit), F.struct("word_index", "x0"))
    marked = ahead.withColumn("_h", first).withColumn("_hx", F.min("_h").over(Window.partitionBy(*keys))["x0"])
    return marked.select(*words.columns, "_hx")


def header_x(words: DataFrame, page: str) -> DataFrame:
    """(page, x0): where the first header of each page that has one stands."""
    return with_header_x(words, [page]).filter("_hx IS NOT NULL").groupBy(page).agg(F.first("_hx").alias("x0"))


def references(text: Column) -> Column:
    """The fixture codes that a text names, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FIXTURE_REFERENCE), 1), lambda c: F.upper(c)))


def known_references(keynotes: DataFrame, codes: DataFrame, id_col: str) -> DataFrame:
    """(id, code): the named codes that are known, by a join with the codes."""
    named = keynotes.select(id_col, F.explode(references(F.col("text"))).alias("code"))
    return named.join(codes.select(F.upper("code").alias("code")).distinct(), "code", "left_semi").select(id_col, "code")


def folded(corrections: DataFrame) -> DataFrame:
    """(source_key, number, removed, text, counts) from ordered keynote corrections.

    ``corrections``: source_key, seq, action, code, number, text, sheet, n. A remove
    without a number takes it from a code ``KN-...``; it drops what was added before, and
    a later add takes the remove back. Of counts of one sheet the last stands, and the
    text is that of the first add after the last remove.
    """
    number = F.coalesce(F.nullif("number", F.lit("")), F.nullif(F.regexp_extract("code", "^KN-(.+)$", 1), F.lit("")))
    keyed = corrections.withColumn("number", F.when(F.col("action") == "keynote_remove", number).otherwise(F.nullif("number", F.lit("")))).filter("number is not null and action in ('keynote_add', 'keynote_remove')")
    last = keyed.groupBy("source_key", "number").agg(F.max(F.when(F.col("action") == "keynote_remove", F.col("seq"))).alias("_at"))
    live = keyed.join(last, ["source_key", "number"]).filter("action = 'keynote_add' and (_at is null or seq > _at)")
    sheets = live.filter("sheet <> ''").groupBy("source_key", "number", "sheet").agg(F.max_by("n", "seq").alias("n"))
    counts = sheets.groupBy("source_key", "number").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sheet", "n")))).alias("counts"))
    texts = live.groupBy("source_key", "number").agg(F.min_by("text", "seq").alias("text"))
    out = last.join(texts, ["source_key", "number"], "left").join(counts, ["source_key", "number"], "left")
    return out.select("source_key", "number", F.isnull("text").alias("removed"), "text", F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"))


def corrected(keynotes: DataFrame, hints: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source_key, number, plan, n): counts with overrides of known plans, without removed
    keynotes, with those of added ones.

    ``keynotes``: source_key, number, plan, n; ``overrides``: the same for counts that a
    user gave; an override of a plan that the keynote has no count for does nothing.
    """
    key = ["source_key", "number"]
    changed = keynotes.join(overrides.withColumnRenamed("n", "_o"), [*key, "plan"], "left").select(*key, "plan", F.coalesce("_o", "n").alias("n"))
    kept = changed.join(hints.filter("removed").select(*key), key, "left_anti")
    added = hints.filter("not removed").select(*key, F.explode("counts").alias("plan", "_a"))
    return kept.join(added, [*key, "plan"], "full").select(*key, "plan", F.coalesce("_a", "n").alias("n"))


def in_plan_order(keynotes: DataFrame, plans: DataFrame, id_col: str) -> DataFrame:
    """Adds ``place``: keynotes sorted by the position of their first plan (999 where it
    is unknown) and their number (0 where it is none), within each source."""
    order = Window.partitionBy("source_key").orderBy(F.coalesce("position", F.lit(999)), F.coalesce(F.expr("try_cast(number as int)"), F.lit(0)), "number", id_col)
    return keynotes.join(plans.select(F.col("plan").alias("first_plan"), "position"), "first_plan", "left").withColumn("place", F.row_number().over(order)).drop("position")
