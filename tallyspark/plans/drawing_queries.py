"""Driver queries over drawings: viewports, keynote sections and corrections, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corrections as corr
from ..operators import keynotes, tables, viewports
from .queries import query, table

# --- titles on pages 1000 wide and 1000 high, from order lines

TITLES = ["Lighting Plan Level 1", "Power Plan Level 1", "Enlarged Lighting Area B", "Demo Plan", "Lighting Plan", "Key Notes"]
_TITLES = f"""tt AS (SELECT l_orderkey AS page_id, l_linenumber AS n, ([{', '.join(repr(t) for t in TITLES)}])[1 + (l_partkey + l_linenumber) % 6] AS text, CAST(l_suppkey % 80 * 10 AS DOUBLE) AS x,
 CAST(CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 850 + CAST(l_quantity AS INT) % 5 * 10 ELSE CAST(l_quantity AS INT) * 15 END AS DOUBLE) AS y FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2))"""


def placed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    text = F.get(F.array(*map(F.lit, TITLES)), ((F.col("l_partkey") + F.col("l_linenumber")) % 6).cast("int"))
    y = F.when(q % 2 == 0, 850 + q % 5 * 10).otherwise(q * 15).cast("double")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    return lines.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), text.alias("text"), (F.col("l_suppkey") % 80 * 10).cast("double").alias("x"), y.alias("y"))


_LIGHT, _OTHER = "'lighting\\s+plan|enlarged\\s+lighting|lighting\\s+layout', 'i'", "'power\\s+plan|power\\s+&|systems\\s+plan|demolition|demo\\s+plan|signal\\s+plan|fire\\s+alarm|mechanical|plumbing', 'i'"


@query(f"""WITH {_TITLES}, w AS (SELECT page_id, n * 100 + j - 1 AS word_index, string_split(text, ' ')[j] AS text, x + (j - 1) * 30 AS x0, x + (j - 1) * 30 + 25 AS x1, y AS top, y + 10 AS bottom FROM (SELECT *, unnest(range(1, len(string_split(text, ' ')) + 1)) AS j FROM tt)),
a AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY page_id ORDER BY top, x0, word_index)) > 5 THEN 1 ELSE 0 END AS jump FROM w),
b AS (SELECT *, sum(jump) OVER (PARTITION BY page_id ORDER BY top, x0, word_index) AS line FROM a),
c AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, line ORDER BY x0, word_index) > 30 THEN 1 ELSE 0 END AS cut FROM b),
d AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, line ORDER BY x0, word_index) AS seg FROM c),
e AS (SELECT page_id, line, seg, string_agg(text, ' ' ORDER BY x0, word_index) AS text, avg((x0 + x1) / 2) AS cx, avg((top + bottom) / 2) AS cy FROM d GROUP BY 1, 2, 3)
SELECT page_id, text, round(cx, 4) AS cx, round(cy, 4) AS cy, NOT regexp_matches(text, {_OTHER}) AS lighting FROM e WHERE regexp_matches(text, {_LIGHT}) OR regexp_matches(text, {_OTHER})""")
def viewport_titles(spark, sf_dir):
    rows = placed_titles(spark, sf_dir).select("page_id", "n", "x", "y", F.posexplode(F.split("text", " ")).alias("j", "text"))
    words = rows.select("page_id", (F.col("n") * 100 + F.col("j")).alias("word_index"), "text", (F.col("x") + F.col("j") * 30).alias("x0"), (F.col("x") + F.col("j") * 30 + 25).alias("x1"), F.col("y").alias("top"), (F.col("y") + 10).alias("bottom"))
    return viewports.titles_of_words(words, "page_id", 1000.0).select("page_id", "text", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), "lighting")


_ENDS = f"""{_TITLES}, t AS (SELECT DISTINCT page_id, text, x AS cx, y AS cy, NOT regexp_matches(text, {_OTHER}) AS lighting FROM tt WHERE regexp_matches(text, {_LIGHT}) OR regexp_matches(text, {_OTHER})),
m AS (SELECT *, cx <= 750 AND cy BETWEEN 820 AND 970 AS b, cx <= 650 AND regexp_matches(text, 'level|floor|area|enlarged|partial|basement|mezzanine|roof|penthouse|garage|upper|lower|main', 'i') AS p FROM t),
k AS (SELECT *, count(*) FILTER (b AND lighting) OVER (PARTITION BY page_id) AS nb, count(*) FILTER (p AND lighting) OVER (PARTITION BY page_id) AS np FROM m),
ch AS (SELECT page_id, text, cx, cy, lighting, nb < 2 AS grid FROM k WHERE CASE WHEN nb >= 2 THEN b ELSE np >= 2 AND p END),
st AS (SELECT page_id, max(dx) AS dx, max(dy) AS dy FROM (SELECT page_id, abs(cx - lag(cx) OVER o) AS dx, abs(cy - lag(cy) OVER o) AS dy FROM ch WHERE lighting WINDOW o AS (PARTITION BY page_id ORDER BY cx, cy, text)) GROUP BY 1),
ok AS (SELECT ch.* FROM ch JOIN st USING (page_id) WHERE dx >= 100 OR dy >= 100),
rw AS (SELECT *, sum(jump) OVER (PARTITION BY page_id ORDER BY cy, cx, text) AS r FROM (SELECT *, CASE WHEN grid AND cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, cx, text) > 30 THEN 1 ELSE 0 END AS jump FROM ok)),
ce AS (SELECT page_id, r, avg(cy) AS c, bool_or(grid) AS g FROM rw GROUP BY 1, 2),
he AS (SELECT page_id, r, CASE WHEN g THEN (lag(c) OVER (PARTITION BY page_id ORDER BY r) + c) / 2 END AS y0, CASE WHEN g THEN (lead(c) OVER (PARTITION BY page_id ORDER BY r) + c) / 2 END AS y1 FROM ce),
li AS (SELECT *, lag(cx) OVER o AS l, lead(cx) OVER o AS nx FROM rw WHERE lighting WINDOW o AS (PARTITION BY page_id, r ORDER BY cx, cy, text))"""


@query(f"""WITH {_ENDS}, en AS (SELECT page_id, r, min(cx) AS f, max(cx) AS z FROM li GROUP BY 1, 2)
SELECT page_id, text, round(coalesce((l + cx) / 2, ((SELECT max(q.cx) FROM rw q WHERE q.page_id = li.page_id AND q.r = li.r AND NOT q.lighting AND q.grid AND q.cx < en.f) + cx) / 2, 0), 4) AS x0, round(coalesce(he.y0, 0), 4) AS y0,
 round(coalesce((cx + nx) / 2, (cx + (SELECT min(q.cx) FROM rw q WHERE q.page_id = li.page_id AND q.r = li.r AND NOT q.lighting AND q.cx > en.z)) / 2, 1000), 4) AS x1, round(coalesce(he.y1, 1000), 4) AS y1
FROM li JOIN he USING (page_id, r) JOIN en USING (page_id, r)""")
def viewport_boxes(spark, sf_dir):
    titles = placed_titles(spark, sf_dir).filter(F.col("text").rlike(viewports.LIGHTING) | F.col("text").rlike(viewports.NON_LIGHTING))
    titles = titles.select("page_id", "text", F.col("x").alias("cx"), F.col("y").alias("cy"), (~F.col("text").rlike(viewports.NON_LIGHTING)).alias("lighting")).distinct()
    boxes = viewports.boxes_of_titles(viewports.split_pages(titles, "page_id", 1000.0, 1000.0), "page_id", 1000.0, 1000.0)
    return boxes.select("page_id", "text", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


_OF_WORDS = f"""{_TITLES}, w AS (SELECT page_id, n * 100 + j - 1 AS word_index, string_split(text, ' ')[j] AS text, x + (j - 1) * 30 AS x0, x + (j - 1) * 30 + 25 AS x1, y AS top, y + 10 AS bottom FROM (SELECT *, unnest(range(1, len(string_split(text, ' ')) + 1)) AS j FROM tt)),
wr AS (SELECT *, unnest(list_filter([CASE WHEN x1 <= 750 AND top >= 820 AND bottom <= 970 THEN 'band' END, CASE WHEN x1 <= 650 AND bottom <= 1000 THEN 'whole' END], lambda r: r IS NOT NULL)) AS region FROM w),
wa AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY page_id, region ORDER BY top, x0, word_index)) > 5 THEN 1 ELSE 0 END AS jump FROM wr),
wb AS (SELECT *, sum(jump) OVER (PARTITION BY page_id, region ORDER BY top, x0, word_index) AS line FROM wa),
wc AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page_id, region, line ORDER BY x0, word_index) > 30 THEN 1 ELSE 0 END AS cut FROM wb),
wd AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, region, line ORDER BY x0, word_index) AS seg FROM wc),
we AS (SELECT page_id, region, string_agg(text, ' ' ORDER BY x0, word_index) AS text, avg((x0 + x1) / 2) AS cx, avg((top + bottom) / 2) AS cy FROM wd GROUP BY page_id, region, line, seg),
m AS (SELECT page_id, text, cx, cy, NOT regexp_matches(text, {_OTHER}) AS lighting, region = 'band' AS b, region = 'whole' AND regexp_matches(text, 'level|floor|area|enlarged|partial|basement|mezzanine|roof|penthouse|garage|upper|lower|main', 'i') AS p FROM we WHERE regexp_matches(text, {_LIGHT}) OR regexp_matches(text, {_OTHER})),
k AS """ + _ENDS.partition("\nk AS ")[2]


@query(f"""WITH {_OF_WORDS}, en AS (SELECT page_id, r, min(cx) AS f, max(cx) AS z FROM li GROUP BY 1, 2)
SELECT page_id, text, round(coalesce((l + cx) / 2, ((SELECT max(q.cx) FROM rw q WHERE q.page_id = li.page_id AND q.r = li.r AND NOT q.lighting AND q.grid AND q.cx < en.f) + cx) / 2, 0), 4) AS x0, round(coalesce(he.y0, 0), 4) AS y0,
 round(coalesce((cx + nx) / 2, (cx + (SELECT min(q.cx) FROM rw q WHERE q.page_id = li.page_id AND q.r = li.r AND NOT q.lighting AND q.cx > en.z)) / 2, 1000), 4) AS x1, round(coalesce(he.y1, 1000), 4) AS y1
FROM li JOIN he USING (page_id, r) JOIN en USING (page_id, r)""")
def viewport_boxes_of_words(spark, sf_dir):
    """From the words of a page to its viewports."""
    rows = placed_titles(spark, sf_dir).select("page_id", "n", "x", "y", F.posexplode(F.split("text", " ")).alias("j", "text"))
    words = rows.select("page_id", (F.col("n") * 100 + F.col("j")).alias("word_index"), "text", (F.col("x") + F.col("j") * 30).alias("x0"), (F.col("x") + F.col("j") * 30 + 25).alias("x1"), F.col("y").alias("top"), (F.col("y") + 10).alias("bottom"))
    titles = viewports.split_pages(viewports.cropped_titles(words, "page_id", 1000.0, 1000.0), "page_id", 1000.0, 1000.0)
    return viewports.boxes_of_titles(titles, "page_id", 1000.0, 1000.0).select("page_id", "text", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


# --- texts of pages with a keynotes section, from orders

_SECTION = """pg AS (SELECT o_orderkey AS page_id, 'General text' || chr(10) || ([' KEY NOTES:', 'KEYED SHEET NOTES', 'Key  Notes', 'KEYED NOTES: all', 'NOTES'])[1 + o_orderkey % 5] || chr(10) ||
 CASE WHEN o_custkey % 3 = 0 THEN chr(10) || o_orderstatus || chr(10) ELSE '' END || '1. Provide type a' || o_custkey % 30 || ' and B' || o_orderkey % 40 || chr(10) || CASE WHEN o_custkey % 4 = 0 THEN 'short' WHEN o_custkey % 4 = 1 THEN 'continued over ' || o_orderstatus ELSE '' END || chr(10) ||
 CASE WHEN o_custkey % 7 = 0 THEN '3/16" = 1 foot' WHEN o_custkey % 7 = 1 THEN ' ' WHEN o_custkey % 7 = 2 THEN 'N 105' ELSE '2) Fixture ' || o_orderstatus || ' C' || o_custkey % 20 END || chr(10) || '3 - See a' || o_custkey % 30 || chr(10) || 'OF' || chr(10) || '4. Not read' AS text FROM orders)"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    head = F.get(F.array(*map(F.lit, [" KEY NOTES:", "KEYED SHEET NOTES", "Key  Notes", "KEYED NOTES: all", "NOTES"])), (o % 5).cast("int"))
    text = F.concat(
        F.lit("General text\n"), head, F.lit("\n"), F.when(c % 3 == 0, F.concat(F.lit("\n"), "o_orderstatus", F.lit("\n"))).otherwise(""),
        F.lit("1. Provide type a"), c % 30, F.lit(" and B"), o % 40, F.lit("\n"), F.when(c % 4 == 0, "short").when(c % 4 == 1, F.concat(F.lit("continued over "), "o_orderstatus")).otherwise(""), F.lit("\n"),
        F.when(c % 7 == 0, '3/16" = 1 foot').when(c % 7 == 1, " ").when(c % 7 == 2, "N 105").otherwise(F.concat(F.lit("2) Fixture "), "o_orderstatus", F.lit(" C"), c % 20)),
        F.lit("\n3 - See a"), c % 30, F.lit("\nOF\n4. Not read"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), text.alias("text"))


@query(f"""WITH {_SECTION}, r AS (SELECT page_id, coalesce({', '.join("nullif(regexp_extract(text, '(?is)(" + p + ".*)$', 1), '')" for p in keynotes.HEADERS)}) AS rest FROM pg),
l AS (SELECT page_id, i, string_split(rest, chr(10))[i] AS line FROM (SELECT page_id, rest, unnest(range(1, len(string_split(rest, chr(10))) + 1)) AS i FROM r WHERE rest IS NOT NULL)),
e AS (SELECT *, trim(line) AS plain, i > 1 AND regexp_matches(line, '^\\s*(\\d+)\\s*[.):\\-]?\\s+([A-Z].+)') AS entry FROM l),
s AS (SELECT *, coalesce(bool_or(entry) OVER (PARTITION BY page_id ORDER BY i), false) AS started, i > 1 AND ({' OR '.join("regexp_matches(plain, '" + p + "')" for p in keynotes.ENDS)}) AS over FROM e),
k AS (SELECT *, entry OR (started AND length(plain) > 10) AS kept FROM s),
m AS (SELECT *, over OR (i > 2 AND started AND NOT kept AND NOT lag(kept) OVER (PARTITION BY page_id ORDER BY i)) AS stops FROM k),
f AS (SELECT page_id, coalesce(min(i) FILTER (stops), 999) AS stop FROM m GROUP BY 1)
SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS section FROM m JOIN f USING (page_id) WHERE i = 1 OR (kept AND i < stop) GROUP BY 1""")
def keynote_sections(spark, sf_dir):
    return page_texts(spark, sf_dir).select("page_id", keynotes.section(F.col("text")).alias("section")).filter("section is not null")


_REFS = "list_transform(regexp_extract_all(text, '(?i)(?:TYPE\\s+|FIXTURE\\s+)?([A-Z]{1,2}\\d{1,2})\\b', 1), lambda c: upper(c))"


@query(f"WITH {_SECTION} SELECT DISTINCT page_id, code FROM (SELECT page_id, unnest({_REFS}) AS code FROM pg) WHERE code IN (SELECT 'A' || p_size FROM part UNION SELECT 'B' || p_partkey % 50 FROM part)")
def keynote_known_references(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    codes = p.select(F.concat(F.lit("a"), "p_size").alias("code")).union(p.select(F.concat(F.lit("B"), F.col("p_partkey") % 50)))
    return keynotes.known_references(page_texts(spark, sf_dir), codes, "page_id")


@query(f"""WITH {_SECTION}, w AS (SELECT page_id, i - 1 AS k, string_split(line, ' ')[i] AS t, j - 1 AS line_no FROM (SELECT page_id, j, line, unnest(range(1, len(string_split(line, ' ')) + 1)) AS i FROM (SELECT page_id, j, string_split(text, chr(10))[j] AS line FROM (SELECT page_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS j FROM pg)))),
p AS (SELECT page_id, line_no * 100 + k AS idx, upper(trim(t)) AS t, CAST(k * (10 + page_id % 30) AS DOUBLE) AS x0, line_no * (CASE WHEN page_id % 2 = 0 THEN 12 ELSE 4 END) AS top FROM w),
n AS (SELECT *, x0 + 8 AS x1, lead(t) OVER o AS t1, lead(t, 2) OVER o AS t2, lead(t, 3) OVER o AS t3, lead(x0) OVER o AS a1, lead(x0, 2) OVER o AS a2, lead(x0, 3) OVER o AS a3, lead(top) OVER o AS b1, lead(top, 2) OVER o AS b2, lead(top, 3) OVER o AS b3 FROM p WINDOW o AS (PARTITION BY page_id ORDER BY idx)),
g AS (SELECT *, coalesce(abs(b1 - top) < 5 AND a1 - x1 < 30, false) AS g1, coalesce(abs(b2 - top) < 5 AND a2 - x1 < 30, false) AS g2, coalesce(abs(b3 - top) < 5 AND a3 - x1 < 30, false) AS g3 FROM n)
SELECT page_id, arg_min(x0, idx) AS x0 FROM g WHERE t IN ('KEYNOTES', 'KEYNOTES:') OR (t IN ('KEY', 'KEYED') AND ((g1 AND contains(coalesce(t1, ''), 'NOTE')) OR (g1 AND g2 AND contains(coalesce(t2, ''), 'NOTE')) OR (g1 AND g2 AND g3 AND contains(coalesce(t3, ''), 'NOTE')))) GROUP BY 1""")
def keynote_header_at(spark, sf_dir):
    rows = page_texts(spark, sf_dir).select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("page_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    x0 = (F.col("k") * (10 + F.col("page_id") % 30)).cast("double")
    words = rows.select("page_id", (F.col("line_no") * 100 + F.col("k")).alias("word_index"), "text", x0.alias("x0"), (x0 + 8).alias("x1"), (F.col("line_no") * F.when(F.col("page_id") % 2 == 0, 12).otherwise(4)).alias("top"))
    return keynotes.header_x(words, "page_id")


# --- corrections of keynotes and specs, from events

_KC = """kc AS (SELECT user_id % 500 AS source_key, event_id AS seq, (['keynote_add', 'keynote_add', 'keynote_remove', 'keynote_count'])[1 + event_id % 4] AS action, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 11 AS VARCHAR) END AS number,
 CASE WHEN event_id % 6 = 0 THEN 'KN-' || event_id % 11 ELSE 'F' || event_id % 20 END AS code, 'text ' || event_id AS text, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'S' || event_id % 3 END AS sheet, event_id % 17 AS n FROM events)"""


def keynote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    action = F.get(F.array(*map(F.lit, ["keynote_add", "keynote_add", "keynote_remove", "keynote_count"])), (e % 4).cast("int"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 500).alias("source_key"),
        e.alias("seq"),
        action.alias("action"),
        F.when(e % 3 == 0, "").otherwise((e % 11).cast("string")).alias("number"),
        F.when(e % 6 == 0, F.concat(F.lit("KN-"), e % 11)).otherwise(F.concat(F.lit("F"), e % 20)).alias("code"),
        F.concat(F.lit("text "), e).alias("text"),
        F.when(e % 10 == 0, "").otherwise(F.concat(F.lit("S"), e % 3)).alias("sheet"),
        (e % 17).alias("n"),
    )


_FOLD = f"""{_KC}, ky AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN action = 'keynote_remove' THEN coalesce(nullif(number, ''), nullif(regexp_extract(code, '^KN-(.+)$', 1), '')) ELSE nullif(number, '') END AS number) FROM kc) WHERE number IS NOT NULL AND action IN ('keynote_add', 'keynote_remove')),
la AS (SELECT source_key, number, coalesce(max(seq) FILTER (action = 'keynote_remove'), -1) AS gone FROM ky GROUP BY 1, 2),
lv AS (SELECT ky.* FROM ky JOIN la USING (source_key, number) WHERE action = 'keynote_add' AND seq > gone),
sh AS (SELECT source_key, number, sheet AS plan, arg_max(n, seq) AS n FROM lv WHERE sheet <> '' GROUP BY 1, 2, 3)"""


@query(f"WITH {_FOLD}, tx AS (SELECT source_key, number, arg_min(text, seq) AS text FROM lv GROUP BY 1, 2), cn AS (SELECT source_key, number, string_agg(plan || '=' || n, ',' ORDER BY plan) AS counts FROM sh GROUP BY 1, 2) SELECT source_key, number, text IS NULL AS removed, text, coalesce(counts, '') AS counts FROM la LEFT JOIN tx USING (source_key, number) LEFT JOIN cn USING (source_key, number)")
def keynote_hints(spark, sf_dir):
    hints = keynotes.folded(keynote_events(spark, sf_dir))
    return hints.withColumn("counts", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


_BASE = "bs AS (SELECT DISTINCT user_id % 500 AS source_key, CAST(event_id % 13 AS VARCHAR) AS number, 'S' || event_id % 4 AS plan, event_id % 13 + 2 AS n FROM events), ov AS (SELECT user_id % 500 AS source_key, CAST(event_id % 13 AS VARCHAR) AS number, 'S' || event_id % 6 AS plan, arg_max(CAST(trunc(value) AS BIGINT), event_id) AS n FROM events WHERE value > 50 GROUP BY 1, 2, 3)"


@query(f"WITH {_FOLD}, {_BASE}, c AS (SELECT source_key, number, plan, coalesce(ov.n, bs.n) AS n FROM bs LEFT JOIN ov USING (source_key, number, plan)), g AS (SELECT source_key, number FROM la WHERE (source_key, number) NOT IN (SELECT source_key, number FROM lv)), k AS (SELECT c.* FROM c ANTI JOIN g USING (source_key, number)) SELECT source_key, number, plan, coalesce(sh.n, k.n) AS n FROM k FULL JOIN sh USING (source_key, number, plan)")
def keynote_corrected(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = (F.col("user_id") % 500).alias("source_key"), (F.col("event_id") % 13).cast("string").alias("number")
    base = e.select(*key, F.concat(F.lit("S"), F.col("event_id") % 4).alias("plan"), (F.col("event_id") % 13 + 2).alias("n")).distinct()
    given = e.filter("value > 50").groupBy(*key, F.concat(F.lit("S"), F.col("event_id") % 6).alias("plan")).agg(F.max_by(F.col("value").cast("long"), "event_id").alias("n"))
    return keynotes.corrected(base, keynotes.folded(keynote_events(spark, sf_dir)), given)


@query("""WITH h AS (SELECT user_id AS source_key, 'F' || event_id % 8 AS code, (['voltage', 'lumens', 'other'])[1 + event_id % 3] AS field, max('v' || event_id) AS value FROM events GROUP BY 1, 2, 3),
f AS (SELECT c_custkey AS source_key, 'F' || c_nationkey % 8 AS code, c_mktsegment AS voltage, c_name AS lumens FROM customer)
SELECT f.source_key, f.code, coalesce(a.value, voltage) AS voltage, coalesce(b.value, lumens) AS lumens FROM f LEFT JOIN h a ON a.source_key = f.source_key AND a.code = f.code AND a.field = 'voltage' LEFT JOIN h b ON b.source_key = f.source_key AND b.code = f.code AND b.field = 'lumens'""")
def spec_patches(spark, sf_dir):
    e = F.col("event_id")
    field = F.get(F.array(*map(F.lit, ["voltage", "lumens", "other"])), (e % 3).cast("int"))
    hints = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_key"), F.concat(F.lit("F"), e % 8).alias("fixture_code"), field.alias("place")).agg(F.max(F.concat(F.lit("v"), e)).alias("value")).withColumn("action", F.lit("update_spec"))
    fixtures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_key"), F.concat(F.lit("F"), F.col("c_nationkey") % 8).alias("code"), F.col("c_mktsegment").alias("voltage"), F.col("c_name").alias("lumens"))
    return corr.apply_spec_patches(fixtures, hints, ["voltage", "lumens"])


@query("""WITH k AS (SELECT c_custkey AS id, c_nationkey % 7 AS source_key, 'P' || c_custkey % 30 AS first_plan, CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey % 5 ELSE CAST(c_custkey % 40 AS VARCHAR) END AS number FROM customer), p AS (SELECT 'P' || n_nationkey AS plan, CAST((n_nationkey * 7) % 25 AS INT) AS position FROM nation)
SELECT id, source_key, first_plan, number, row_number() OVER (PARTITION BY source_key ORDER BY coalesce(position, 999), coalesce(TRY_CAST(number AS INT), 0), number, id) AS place FROM k LEFT JOIN p ON plan = first_plan""")
def keynote_order(spark, sf_dir):
    c = F.col("c_custkey")
    k = table(spark, sf_dir, "customer").select(c.alias("id"), (F.col("c_nationkey") % 7).alias("source_key"), F.concat(F.lit("P"), c % 30).alias("first_plan"), F.when(c % 9 == 0, F.concat(F.lit("x"), c % 5)).otherwise((c % 40).cast("string")).alias("number"))
    p = table(spark, sf_dir, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("plan"), (F.col("n_nationkey") * 7 % 25).cast("int").alias("position"))
    return keynotes.in_plan_order(k, p, "id").select("id", "source_key", "first_plan", "number", "place")


# --- headings, from parts

_HEADS = "hd AS (SELECT p_partkey AS id, ['Type', '', p_brand, 'Lamp ', ''] AS a, [p_size || ' ', 'Voltage', CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, 'Watts', ' '] AS b FROM part)"


@query(f"WITH {_HEADS} SELECT id, array_to_string(list_transform(range(1, 6), lambda i: trim(trim(a[i]) || ' ' || trim(b[i]))), '|') AS heads FROM hd")
def header_merge(spark, sf_dir):
    s = F.col("p_size")
    a = F.array(F.lit("Type"), F.lit(""), F.col("p_brand"), F.lit("Lamp "), F.lit(""))
    b = F.array(F.concat(s, F.lit(" ")), F.lit("Voltage"), F.when(s % 2 == 0, "").otherwise(F.col("p_type")), F.lit("Watts"), F.lit(" "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(tables.merged_headers(a, b), "|").alias("heads"))


# --- small predicates over plans and projects


@query("SELECT l_orderkey AS project, (array_agg(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus))[1] AS plan, count(*) AS shown FROM lineitem WHERE CAST(l_quantity AS INT) % 4 > 0 GROUP BY 1")
def first_plan_with_count(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity").cast("int") % 4 > 0)
    return held.groupBy(F.col("l_orderkey").alias("project")).agg(F.min(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("plan")))["plan"].alias("plan"), F.count("*").alias("shown"))


@query("SELECT page_id, strlen(html) > 4000 AS dense FROM pages")
def dense_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") > 4000).alias("dense"))


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def summary_first_pages(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("k", first).filter("k <= 20").drop("k")
