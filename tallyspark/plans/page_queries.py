"""Driver queries over whole pages and tables: keynote panels and symbols, tables without headings,
sheet indexes, schedules on plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keynote_pages, keynotes, table_roles
from ..operators.tables import CELL_KINDS
from .drawing_queries import _SECTION, page_texts
from .queries import query, table


def _pick(values: list[str], k) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def _sql_pick(values: list[str], k: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + f"])[1 + {k}]"


# --- tables without headings, from parts: four rows a table, five cells a row

_CODES = ["F1 1", "A1", "LIGHTING", "AL2", "", "X1 long remainder", "B-6", "EXIT 12345", "led", "12"]
_CELLS = ["3000K lamp", "4000 K LED", "900 lm", "40 W", "0-10 V dimm", "277", "recessed", "wall 277 with much more text", "1200 lumens", "RM-4/FL-TR", "4-A/long", "plain words here", ""]
_TABLE = f"""tb AS (SELECT p_partkey // 4 AS table_id, p_partkey % 4 AS row_idx, {_sql_pick(_CODES, 'p_partkey % 10')} AS c0, {_sql_pick(_CELLS, f'p_size % {len(_CELLS)}')} AS c1, {_sql_pick(_CELLS, f'(p_size * 3 + p_partkey) % {len(_CELLS)}')} AS c2, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '  ' || p_brand || ' ' END AS c3, {_sql_pick(_CELLS, f'(p_size + p_partkey * 5) % {len(_CELLS)}')} AS c4 FROM part)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k, s = len(_CELLS), F.col("p_partkey"), F.col("p_size")
    last = F.when(k % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    row = F.array(_pick(_CODES, k % 10), _pick(_CELLS, s % n), _pick(_CELLS, (s * 3 + k) % n), last, _pick(_CELLS, (s + k * 5) % n))
    return table(spark, sf_dir, "part").select(F.floor(k / 4).alias("table_id"), (k % 4).alias("row_idx"), F.posexplode(row).alias("col_idx", "text"))


def _headerless_sql() -> str:
    steps, kinds = ["s0 AS (SELECT *, " + ", ".join(f"CAST(NULL AS VARCHAR) AS {k}" for k, _, _ in CELL_KINDS) + ", CAST([] AS VARCHAR[]) AS rest FROM rw)"], [k for k, _, _ in CELL_KINDS]
    for c in range(1, 5):
        chosen = "CASE WHEN t = '' THEN NULL " + " ".join(f"WHEN {k} IS NULL AND regexp_matches(t, '{p}') THEN {f"CASE WHEN length(t) < {most} THEN '{k}' ELSE 'none' END" if most else f"'{k}'"}" for k, p, most in CELL_KINDS) + " ELSE 'none' END"
        sets = ", ".join(f"CASE WHEN ch = '{k}' THEN t ELSE {k} END AS {k}" for k in kinds)
        steps.append(f"s{c} AS (SELECT table_id, row_idx, code, c1, c2, c3, c4, {sets}, CASE WHEN ch = 'none' THEN list_append(rest, t) ELSE rest END AS rest FROM (SELECT *, {chosen} AS ch FROM (SELECT *, trim(c{c}) AS t FROM s{c - 1})))")
    words = " + ".join(f"CAST(contains(w, '{x}') AS INT)" for x in table_roles.SCHEDULE_WORDS)
    return f"""WITH {_TABLE}, sn AS (SELECT table_id FROM (SELECT table_id, lower(string_agg(c0 || ' ' || c1 || ' ' || c2 || ' ' || c3 || ' ' || c4, ' ')) AS w FROM tb GROUP BY 1) WHERE {words} >= 2),
rw AS (SELECT * FROM (SELECT tb.*, CASE WHEN regexp_matches(c0, '^[A-Za-z][A-Za-z0-9./-]{{0,9}}$') THEN c0 WHEN regexp_matches(c0, '^[A-Za-z][A-Za-z0-9./-]{{0,9}}\\s+(.{{1,5}}|[0-9]+)$') THEN regexp_extract(c0, '^(\\S+)', 1) ELSE '' END AS code FROM tb SEMI JOIN sn USING (table_id)) WHERE code <> '' AND NOT regexp_matches(code, '^[A-Za-z]{{4,}}$') AND trim(c1 || c2 || c3 || c4) <> ''),
{', '.join(steps)},
lg AS (SELECT *, list_max(list_transform(rest, lambda t: length(t))) AS most FROM s4), d AS (SELECT *, CASE WHEN most > 10 THEN list_filter(rest, lambda t: length(t) = most)[1] END AS description FROM lg),
o AS (SELECT *, CASE WHEN description IS NULL THEN rest ELSE list_concat(rest[:list_position(rest, description) - 1], rest[list_position(rest, description) + 1:]) END AS others FROM d)
SELECT table_id, row_idx, code, coalesce(description, '') AS description, coalesce(list_filter(others, lambda t: length(t) > 5 AND regexp_matches(t, '[-/]') AND NOT regexp_matches(t, '^[0-9]'))[1], '') AS fixture_style, {', '.join(f"coalesce({k}, '') AS {k}" for k in ('voltage', 'mounting', 'lumens', 'cct', 'dimming', 'max_va'))} FROM o"""


@query(_headerless_sql())
def headerless_records(spark, sf_dir):
    return table_roles.headerless_records(_cells(spark, sf_dir))


# --- sheet indexes, from customers: six rows a table, four cells a row

_HEADS = [["No", "Sheet", "Title", "Sheet name"], ["", "", "", ""], ["x", "Drawing No", "Rev", "Description"], ["1", "E101", "Plan of a level and more", ""], ["Title", "Code", "", "q"], ["Name", "", "  Sheet  Number ", ""]]
_SHEETS = ["E{}", "FE{}-013", "e{}.1a", "E1\nE2", "none", "E7\nE8\nE9", "E{} R", ""]
_NAMES = ["Lighting plan of the lower level", "One\nTwo", "Notes", "a\nb\nc", "Roof  and\nmore", ""]
_INDEX = f"""ix AS (SELECT c_custkey // 6 AS table_id, c_custkey % 6 AS row_idx, c_custkey // 6 % 6 AS h, replace({_sql_pick(_SHEETS, 'c_nationkey % 8')}, '{{}}', CAST(c_custkey % 900 AS VARCHAR)) AS s, {_sql_pick(_NAMES, 'c_custkey % 6')} AS n, c_mktsegment AS m FROM customer),
ic AS (SELECT table_id, row_idx, col_idx, CASE WHEN row_idx = 0 THEN (CASE h {' '.join(f'WHEN {k} THEN {_sql_pick(v, "col_idx")}' for k, v in enumerate(_HEADS))} END) ELSE (CASE (col_idx + h) % 4 WHEN 0 THEN m WHEN 1 THEN s WHEN 2 THEN n ELSE ' ' END) END AS text FROM ix, (SELECT unnest(range(0, 4)) AS col_idx))"""


def _index_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    h = F.floor(c / 6) % 6
    sheet = F.replace(_pick(_SHEETS, F.col("c_nationkey") % 8), F.lit("{}"), (c % 900).cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.floor(c / 6).alias("table_id"), (c % 6).alias("row_idx"), h.alias("h"), sheet.alias("s"), _pick(_NAMES, c % 6).alias("n"), F.col("c_mktsegment").alias("m"))
    heads = F.get(F.array(*[F.array(*map(F.lit, v)) for v in _HEADS]), F.col("h").cast("int"))
    body = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(F.array(F.col("m"), F.col("s"), F.col("n"), F.lit(" ")), ((k + F.col("h")) % 4).cast("int")))
    return rows.select("table_id", "row_idx", F.posexplode(F.when(F.col("row_idx") == 0, heads).otherwise(body)).alias("col_idx", "text"))


def _labels(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_STRIP = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_INDEX_COLUMNS = f"""{_INDEX}, hd AS (SELECT table_id, col_idx, {_labels(table_roles.CODE_LABELS)} AS c, {_labels(table_roles.TITLE_LABELS)} AS d FROM (SELECT table_id, col_idx, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM ic WHERE row_idx = 0) WHERE t <> ''),
cc AS (SELECT table_id, max(col_idx) AS code_col FROM hd WHERE c GROUP BY 1), lb AS (SELECT table_id, code_col, coalesce(min(col_idx) FILTER (col_idx > code_col), max(col_idx)) AS title_col FROM hd JOIN cc USING (table_id) WHERE d GROUP BY 1, 2),
sz AS (SELECT table_id FROM ic GROUP BY 1 HAVING max(row_idx) > 0 AND max(col_idx) > 0),
sc AS (SELECT table_id, col_idx, sum(CASE WHEN row_idx = 0 OR t = '' THEN 0 WHEN regexp_matches(t, '^[A-Za-z]{{1,3}}[0-9]+(\\.[0-9]+)?[A-Za-z]{{0,2}}$') THEN 2 WHEN length(t) <= 10 THEN 1 ELSE 0 END) AS codes, count(*) FILTER (row_idx > 0 AND length(t) > 15) AS longs FROM (SELECT *, {_STRIP} AS t FROM ic) ANTI JOIN lb USING (table_id) GROUP BY 1, 2),
gc AS (SELECT table_id, arg_max(col_idx, codes * 100 - col_idx) AS code_col FROM sc GROUP BY 1 HAVING max(codes) > 0), gd AS (SELECT table_id, code_col, arg_max(col_idx, longs * 100 - col_idx) AS title_col FROM sc JOIN gc USING (table_id) WHERE col_idx <> code_col GROUP BY 1, 2),
cols AS (SELECT * FROM (SELECT * FROM lb UNION ALL SELECT * FROM gd) SEMI JOIN sz USING (table_id))"""


@query(f"WITH {_INDEX_COLUMNS} SELECT table_id, code_col, title_col FROM cols")
def index_columns(spark, sf_dir):
    return table_roles.index_columns(_index_cells(spark, sf_dir)).select("table_id", F.col("code_col").cast("long").alias("code_col"), F.col("title_col").cast("long").alias("title_col"))


@query(f"""WITH {_INDEX_COLUMNS}, pr AS (SELECT a.table_id, a.row_idx, a.t AS c, b.t AS d FROM (SELECT *, {_STRIP} AS t FROM ic) a JOIN cols ON cols.table_id = a.table_id AND a.col_idx = code_col JOIN (SELECT *, {_STRIP} AS t FROM ic) b ON b.table_id = a.table_id AND b.row_idx = a.row_idx AND b.col_idx = title_col WHERE a.t <> '' AND b.t <> ''),
pl AS (SELECT *, string_split(c, chr(10)) AS cl, string_split(d, chr(10)) AS dl FROM pr), e AS (SELECT table_id, row_idx, i - 1 AS part, trim(cl[i]) AS code, trim(dl[i]) AS title FROM (SELECT *, unnest(range(1, len(cl) + 1)) AS i FROM pl WHERE len(cl) > 1 AND len(cl) = len(dl) AND row_idx > 0)
 UNION ALL SELECT table_id, row_idx, 0, regexp_replace(c, '\\s+', ' ', 'g'), regexp_replace(d, '\\s+', ' ', 'g') FROM pl WHERE NOT (len(cl) > 1 AND len(cl) = len(dl)))
SELECT table_id, row_idx, part, upper(code) AS code, title FROM e WHERE title <> '' AND regexp_matches(code, '^[A-Za-z]{{1,3}}[0-9]+([.\\-][0-9]+)?[A-Za-z]{{0,2}}$')""")
def index_table_entries(spark, sf_dir):
    return table_roles.index_entries(_index_cells(spark, sf_dir)).withColumn("part", F.col("part").cast("long"))


# --- schedules on plans: parts as tables, ten a page

_HEAD_CELLS = ["Mark", "Luminaire type", "LAMP", "Volts", "mounting", "Wattage", "Notes", "Voltage"]
_BOXES = f"""bx AS (SELECT p_partkey // 10 AS page_id, p_partkey AS table_id, CAST(p_size * 3 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0, CAST(p_size * 3 + CASE WHEN p_size % 4 = 0 THEN 900 ELSE 300 END AS DOUBLE) AS x1, CAST(p_size + CASE WHEN p_size % 4 = 0 THEN 700 ELSE 100 END AS DOUBLE) AS y1, [{', '.join(_sql_pick(_HEAD_CELLS, f'(p_size * {a} + p_partkey * {b}) % 8') for a, b in ((1, 0), (2, 1), (0, 3), (5, 1)))}, CASE WHEN p_partkey % 17 = 0 THEN repeat('luminaire ', 60) ELSE '' END] AS heads FROM part)"""


@query(f"""WITH {_BOXES}, h AS (SELECT *, list_filter(heads, lambda t: t <> '') AS hs, lower(array_to_string(list_filter(heads, lambda t: t <> ''), ' ')) AS t FROM bx), k AS (SELECT *, {' + '.join(f"CAST(contains(t, '{w}') AS INT)" for w in table_roles.PLAN_TABLE_WORDS)} AS n FROM h),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, table_id) AS r FROM k) WHERE r = 1)
SELECT page_id, table_id, x0 AS sx0, y0 AS sy0, x1 AS sx1, y1 AS sy1 FROM b WHERE n >= 3 AND length(t) <= 500 AND (x1 - x0) * (y1 - y0) <= 0.5 * 1000 * 800""")
def schedule_boxes(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    large = s % 4 == 0
    p = table(spark, sf_dir, "part")
    boxes = p.select(F.floor(k / 10).alias("page_id"), k.alias("table_id"), (s * 3).cast("double").alias("x0"), s.cast("double").alias("y0"), (s * 3 + F.when(large, 900).otherwise(300)).cast("double").alias("x1"), (s + F.when(large, 700).otherwise(100)).cast("double").alias("y1"))
    heads = F.array(*[_pick(_HEAD_CELLS, (s * a + k * b) % 8) for a, b in ((1, 0), (2, 1), (0, 3), (5, 1))], F.when(k % 17 == 0, F.repeat(F.lit("luminaire "), F.lit(60))).otherwise(""))
    cells = p.select(k.alias("table_id"), F.lit(0).alias("row_idx"), F.posexplode(heads).alias("col_idx", "text"))
    pages = boxes.select("page_id", *[F.lit(v).alias(n) for n, v in (("bx0", 0.0), ("by0", 0.0), ("bx1", 1000.0), ("by1", 800.0))]).distinct()
    return table_roles.schedule_boxes(boxes, cells, pages)


# --- keynote panels of orders' texts, a word every 20 to 49 from one of six columns; symbols from order lines

_COLUMNS = [720, 670, 620, 100, 705, 5]
_WORDS = rf"""{_SECTION}, wl AS (SELECT page_id, j - 1 AS line_no, string_split(text, chr(10))[j] AS line FROM (SELECT page_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS j FROM pg)),
pw AS (SELECT page_id, line_no * 100 + k AS word_index, t AS text, {_sql_pick([str(c) for c in _COLUMNS], 'page_id % 6')}::DOUBLE + k * (20 + page_id % 30) AS x0, CAST(line_no * 12 AS DOUBLE) AS top FROM (SELECT page_id, line_no, unnest(string_split(line, ' ')) AS t, unnest(range(0, len(string_split(line, ' ')))) AS k FROM wl)),
li AS (SELECT *, CAST(l_suppkey % 70 * 10 AS DOUBLE) AS x, CAST(200 + l_partkey % 60 * 11 AS DOUBLE) AS y, CAST(l_quantity AS INT) % 6 AS q FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)),
words AS (SELECT page_id, word_index, text, x0, x0 + 8 AS x1, top, top + 8 AS bottom FROM pw WHERE text <> ''
 UNION ALL SELECT l_orderkey, 100000 + l_linenumber, CAST(l_linenumber % 3 + 1 AS VARCHAR), x - 4, x + 4, y - 4, y + CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE 4 END FROM li),
segs AS (SELECT l_orderkey AS page_id, x + s[1] AS ax, y + s[2] AS ay, x + s[3] AS bx, y + s[4] AS "by" FROM (SELECT *, unnest([[-5, -5, 5, -5], [5, -5, 5, 5], [5, 5, -5, 5], [-5, 5, -5, -5]][:q]) AS s FROM li)),
vw AS (SELECT page_id, '' AS view, 0 AS vx0, 0 AS vy0, 1000 AS vx1, 1000 AS vy1 FROM pg WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, v, a, 0, b, 1000 FROM pg, (VALUES ('L', 0, 500), ('R', 400, 1000)) z(v, a, b) WHERE page_id % 3 = 0)"""


def keynote_words(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = F.col("page_id")
    lines = page_texts(spark, sf_dir).select("page_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("page_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "text"))
    x0 = F.get(F.array(*[F.lit(float(c)) for c in _COLUMNS]), (p % 6).cast("int")) + F.col("k") * (20 + p % 30)
    top = (F.col("line_no") * 12).cast("double")
    words = lines.filter("text <> ''").select("page_id", (F.col("line_no") * 100 + F.col("k")).cast("long").alias("word_index"), "text", x0.alias("x0"), (x0 + 8).alias("x1"), top.alias("top"), (top + 8).alias("bottom"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    n = F.col("l_linenumber")
    li = li.select(F.col("l_orderkey").alias("page_id"), n, "l_partkey", (F.col("l_suppkey") % 70 * 10).cast("double").alias("x"), (200 + F.col("l_partkey") % 60 * 11).cast("double").alias("y"), (F.col("l_quantity").cast("int") % 6).alias("q"))
    numbers = li.select("page_id", (100_000 + n).cast("long").alias("word_index"), (n % 3 + 1).cast("string").alias("text"), (F.col("x") - 4).alias("x0"), (F.col("x") + 4).alias("x1"), (F.col("y") - 4).alias("top"), (F.col("y") + F.when(F.col("l_partkey") % 3 == 0, 5).otherwise(4)).alias("bottom"))
    sides = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in ((-5, -5, 5, -5), (5, -5, 5, 5), (5, 5, -5, 5), (-5, 5, -5, -5))])
    segs = li.select("page_id", "x", "y", F.explode(F.slice(sides, F.lit(1), F.col("q"))).alias("s"))
    box = lambda *v: [F.lit(float(x)).alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"))]
    ids = page_texts(spark, sf_dir).select("page_id")
    return {
        "words": words.unionByName(numbers),
        "segments": segs.select("page_id", (F.col("x") + F.col("s")[0]).alias("ax"), (F.col("y") + F.col("s")[1]).alias("ay"), (F.col("x") + F.col("s")[2]).alias("bx"), (F.col("y") + F.col("s")[3]).alias("by")),
        "pages": ids.select("page_id", *[F.lit(float(v)).alias(c) for c, v in (("bx0", 0), ("by0", 0), ("bx1", 1000), ("by1", 1000))]),
        "views": ids.filter(p % 3 == 0).select("page_id", F.inline(F.array(F.struct(F.lit("L").alias("view"), *box(0, 0, 500, 1000)), F.struct(F.lit("R").alias("view"), *box(400, 0, 1000, 1000))))),
    }


def _regions(views: str) -> str:
    """Texts of each view's rectangles, and the one that is taken."""
    header = " OR ".join(f"regexp_matches(text, '{p}', 'i')" for p in keynotes.HEADERS)
    return rf"""hw AS (SELECT w.*, v.view, vx0, vy0, vx1, vy1 FROM words w JOIN {views} v USING (page_id) WHERE v.view = '' OR (x0 >= vx0 AND x1 <= vx1 AND top >= vy0 AND bottom <= vy1)),
hn AS (SELECT *, upper(trim(text)) AS t, {', '.join(f'lead(upper(text), {k}) OVER o AS t{k}, lead(x0, {k}) OVER o AS a{k}, lead(top, {k}) OVER o AS b{k}' for k in (1, 2, 3))} FROM hw WINDOW o AS (PARTITION BY page_id, view ORDER BY word_index)),
hg AS (SELECT *, {', '.join(f'coalesce(abs(b{k} - top) < 5 AND a{k} - x1 < 30, false) AS g{k}' for k in (1, 2, 3))} FROM hn),
hx AS (SELECT page_id, view, arg_min(x0, word_index) AS hx FROM hg WHERE t IN ('KEYNOTES', 'KEYNOTES:') OR (t IN ('KEY', 'KEYED') AND ((g1 AND contains(coalesce(t1, ''), 'NOTE')) OR (g1 AND g2 AND contains(coalesce(t2, ''), 'NOTE')) OR (g1 AND g2 AND g3 AND contains(coalesce(t3, ''), 'NOTE')))) GROUP BY 1, 2),
rc AS (SELECT page_id, view, 0 AS region, greatest(vx0, hx - 30) AS ra, vx1 AS rb, vy0 AS rt, vy0 + (vy1 - vy0) * 0.85 AS ru FROM {views} JOIN hx USING (page_id, view) UNION ALL SELECT page_id, view, k, vx0 + (vx1 - vx0) * a, vx1, vy0, vy0 + (vy1 - vy0) * b FROM {views}, (VALUES (1, 0.70, 0.85), (2, 0.65, 0.85), (3, 0.60, 0.80)) z(k, a, b) UNION ALL SELECT page_id, view, 4, -1e9, 1e9, -1e9, 1e9 FROM {views}),
rw AS (SELECT hw.page_id, hw.view, region, word_index, text, x0, top FROM hw JOIN rc ON rc.page_id = hw.page_id AND rc.view = hw.view AND x0 >= ra AND x1 <= rb AND top >= rt AND bottom <= ru),
rj AS (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY page_id, view, region ORDER BY top, x0, word_index)) > 3 THEN 1 ELSE 0 END AS j FROM rw), rl AS (SELECT *, sum(j) OVER (PARTITION BY page_id, view, region ORDER BY top, x0, word_index) AS line FROM rj),
rt AS (SELECT page_id, view, region, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT page_id, view, region, line, string_agg(text, ' ' ORDER BY x0, word_index) AS t FROM rl GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
rx AS (SELECT page_id, view, min(region) AS region, arg_min(text, region) AS text FROM rt WHERE region = 4 OR (({header}) AND regexp_matches(text, '(^|\n)\s*(\d{{1,2}})\s*[.):\-]?\s+([A-Z].+)')) GROUP BY 1, 2)"""


@query(f"WITH {_WORDS}, {_regions('vw')} SELECT page_id, view, CAST(region AS INT) AS region, text FROM rx")
def keynote_regions(spark, sf_dir):
    k = keynote_words(spark, sf_dir)
    return keynote_pages.region_texts(k["words"], k["pages"], k["views"])


_PAGE_SECTION = f"""wp AS (SELECT page_id, '' AS view, 0 AS vx0, 0 AS vy0, 1000 AS vx1, 1000 AS vy1 FROM pg), {_regions('wp')},
sr AS (SELECT page_id, coalesce({', '.join("nullif(regexp_extract(text, '(?is)(" + p + ".*)$', 1), '')" for p in keynotes.HEADERS)}) AS rest FROM rx),
sl AS (SELECT page_id, i, string_split(rest, chr(10))[i] AS line FROM (SELECT page_id, rest, unnest(range(1, len(string_split(rest, chr(10))) + 1)) AS i FROM sr WHERE rest IS NOT NULL)),
se AS (SELECT *, trim(line) AS plain, i > 1 AND regexp_matches(line, '^\\s*(\\d+)\\s*[.):\\-]?\\s+([A-Z].+)') AS entry FROM sl),
ss AS (SELECT *, coalesce(bool_or(entry) OVER (PARTITION BY page_id ORDER BY i), false) AS started, i > 1 AND ({' OR '.join("regexp_matches(plain, '" + p + "')" for p in keynotes.ENDS)}) AS over FROM se),
sk AS (SELECT *, entry OR (started AND length(plain) > 10) AS kept FROM ss),
sm AS (SELECT *, over OR (i > 2 AND started AND NOT kept AND NOT lag(kept) OVER (PARTITION BY page_id ORDER BY i)) AS stops FROM sk),
sf AS (SELECT page_id, coalesce(min(i) FILTER (stops), 9999) AS stop FROM sm GROUP BY 1),
en AS (SELECT sm.*, regexp_extract(line, '^\\s*(\\d+)\\s*[.):\\-]?\\s+([A-Z].+)', 1) AS num, regexp_extract(line, '^\\s*(\\d+)\\s*[.):\\-]?\\s+([A-Z].+)', 2) AS said FROM sm JOIN sf USING (page_id) WHERE i > 1 AND kept AND i < stop),
eg AS (SELECT *, count(*) FILTER (entry) OVER (PARTITION BY page_id ORDER BY i) AS item FROM en),
et AS (SELECT page_id, item, max(num) AS number, string_agg(trim(CASE WHEN entry THEN said ELSE line END), ' ' ORDER BY i) AS text FROM eg WHERE item > 0 AND trim(line) <> '' GROUP BY 1, 2),
kn AS (SELECT page_id, number, arg_max(text, length(text) * 1000 - item) AS text, CAST(min(item) AS INT) AS at FROM et WHERE TRY_CAST(number AS INT) <= 20 AND length(text) >= 15 GROUP BY 1, 2)"""
_SYMBOLS = '''cd AS (SELECT w.page_id, v.view, trim(w.text) AS number, word_index, (x0 + x1) / 2 AS cx, (top + bottom) / 2 AS cy, round(bottom - top, 1) AS high FROM words w JOIN kn ON kn.page_id = w.page_id AND kn.number = trim(w.text) JOIN vw v ON v.page_id = w.page_id WHERE (x0 + x1) / 2 <= vx0 + (vx1 - vx0) * 0.70 AND (top + bottom) / 2 <= vy0 + (vy1 - vy0) * 0.90 AND (v.view = '' OR ((x0 + x1) / 2 BETWEEN vx0 AND vx1 AND (top + bottom) / 2 BETWEEN vy0 AND vy1))),
ends AS (SELECT page_id, ax AS x, ay AS y FROM segs UNION ALL SELECT page_id, bx, "by" FROM segs),
qd AS (SELECT page_id, view, word_index, count(DISTINCT CASE WHEN x >= cx THEN CASE WHEN y <= cy THEN 1 ELSE 2 END ELSE CASE WHEN y > cy THEN 3 ELSE 4 END END) AS q FROM cd JOIN ends USING (page_id) WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) > 4 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) < 100 GROUP BY 1, 2, 3),
ds AS (SELECT page_id FROM segs GROUP BY 1 HAVING count(*) > 12),
ps AS (SELECT page_id, view, word_index, ax, ay, bx, "by", sqrt(((ax + bx) / 2 - cx) ** 2 + ((ay + "by") / 2 - cy) ** 2) AS m FROM cd JOIN segs USING (page_id) SEMI JOIN ds USING (page_id) WHERE (ax - cx) ** 2 + (ay - cy) ** 2 < 169 AND (bx - cx) ** 2 + ("by" - cy) ** 2 < 169),
pc AS (SELECT page_id, view, word_index, count(*) FILTER (n = 2) AS corners FROM (SELECT page_id, view, word_index, u, v, count(*) AS n FROM (SELECT page_id, view, word_index, round(ax) AS u, round(ay) AS v FROM ps UNION ALL SELECT page_id, view, word_index, round(bx), round("by") FROM ps) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3),
vf AS (SELECT page_id, view, word_index FROM ps JOIN pc USING (page_id, view, word_index) GROUP BY 1, 2, 3, corners HAVING count(*) BETWEEN 4 AND 12 AND corners >= 2 AND stddev_pop(m) < 2),
cq AS (SELECT cd.*, coalesce(q, 0) AS q, vf.page_id IS NOT NULL AND coalesce(q, 0) >= 3 AS poly FROM cd LEFT JOIN qd USING (page_id, view, word_index) LEFT JOIN vf USING (page_id, view, word_index)),
hh AS (SELECT page_id, view, high, count(*) FILTER (poly) AS p, min(word_index) FILTER (poly) AS pf, count(*) FILTER (q >= 4) AS f, min(word_index) FILTER (q >= 4) AS ff, count(*) FILTER (q >= 3) AS t, min(word_index) FILTER (q >= 3) AS tf FROM cq GROUP BY 1, 2, 3),
us AS (SELECT page_id, view, coalesce(CASE WHEN sum(p) >= 2 THEN arg_max(high, p * 1000000000 - pf) END, arg_max(high, f * 1000000000 - ff), arg_max(high, t * 1000000000 - tf)) AS usual FROM hh GROUP BY 1, 2),
sy AS (SELECT cq.* FROM cq JOIN us USING (page_id, view) WHERE usual IS NULL OR (q >= 3 AND high = usual))'''


@query(f"WITH {_WORDS}, {_PAGE_SECTION}, {_SYMBOLS} SELECT page_id, view, number, word_index FROM sy")
def keynote_symbols(spark, sf_dir):
    k = keynote_words(spark, sf_dir)
    found = keynote_pages.entries(keynote_pages.sections(k["words"], k["pages"]), ["page_id"])
    return keynote_pages.symbols(k["words"], k["segments"], found, k["pages"], k["views"], dense=12)


@query(f"""WITH {_WORDS}, {_PAGE_SECTION}, {_SYMBOLS.replace('count(*) > 12', 'count(*) > 10000')}, nn AS (SELECT kn.page_id, kn.number, vw.view, count(sy.number) AS n FROM kn JOIN vw USING (page_id) LEFT JOIN sy ON sy.page_id = kn.page_id AND sy.view = vw.view AND sy.number = kn.number GROUP BY 1, 2, 3)
SELECT kn.page_id, kn.number, kn.text, kn.at, CAST(sum(n) AS BIGINT) AS total, string_agg(view || '=' || n, ',' ORDER BY view) AS counts, array_to_string(list_distinct_in_order, ',') AS refs FROM (SELECT *, list_filter(r, lambda x, i: list_position(r, x) = i) AS list_distinct_in_order FROM (SELECT *, list_transform(regexp_extract_all(text, '(?i)(?:TYPE\\s+|FIXTURE\\s+)?([A-Z]{{1,2}}\\d{{1,2}})\\b', 1), lambda c: upper(c)) AS r FROM kn)) kn JOIN nn USING (page_id, number) GROUP BY kn.page_id, kn.number, kn.text, kn.at, refs""")
def keynotes_of_pages(spark, sf_dir):
    k = keynote_words(spark, sf_dir)
    found = keynote_pages.all_keynotes(k["words"], k["segments"], k["pages"], k["views"])
    return found.select("page_id", "number", "text", "at", "total", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"), F.array_join("references", ",").alias("refs"))
