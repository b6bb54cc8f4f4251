"""Further driver queries: matching of codes and pages, outlines, keynotes, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import corrections as corr
from ..operators import matching, quality, reports, spatial
from .queries import _CAT, _MINE, CELLS, CORR, FIX, LINES, POINTS, SHEETS, cells, events_as_corrections, fixtures, lines, points, query, sheets, table

_CODES = """fx AS (SELECT p_partkey AS id, substr('ABW', 1 + p_size % 3, 1) || CASE WHEN p_size % 4 = 0 THEN '-' ELSE '' END || (p_partkey % 40) AS code, CASE WHEN p_size % 2 = 0 THEN 'Battery pack lamp' ELSE 'lamp' END AS description, p_size FROM part),
pc AS (SELECT DISTINCT code FROM (SELECT substr('ABW', 1 + l_linenumber % 3, 1) || CASE WHEN l_partkey % 3 = 0 THEN 'L' ELSE '' END || (l_partkey % 60) || CASE WHEN l_suppkey % 5 = 0 THEN 'E' ELSE '' END AS code FROM lineitem))"""


@query(f"""WITH {_CODES}, s AS (SELECT *, replace(code, '-', '') AS clean FROM fx), o AS (SELECT code AS pcode, regexp_extract(code, '([0-9]+[A-Z]*)$', 1) AS d, regexp_extract(code, '^([A-Z]+)', 1) AS l FROM pc),
u AS (SELECT clean, min(pcode) AS only FROM (SELECT DISTINCT clean FROM s) s JOIN o ON o.d = regexp_extract(clean, '([0-9]+[A-Z]*)$', 1) AND starts_with(o.l, regexp_extract(clean, '^([A-Z]+)', 1)) WHERE regexp_extract(clean, '([0-9]+[A-Z]*)$', 1) <> '' GROUP BY 1 HAVING count(*) = 1),
f AS (SELECT s.id, s.code, s.description, CASE WHEN s.code IN (SELECT code FROM pc) THEN s.code WHEN s.clean IN (SELECT code FROM pc) THEN s.clean ELSE coalesce(u.only, s.code) END AS c FROM s LEFT JOIN u USING (clean))
SELECT id, code, description, CASE WHEN NOT ends_with(upper(c), 'E') AND c || 'E' IN (SELECT code FROM pc) AND c || 'E' NOT IN (SELECT c FROM f) AND contains(upper(description), 'BATTERY PACK') THEN c || 'E' ELSE c END AS new_code FROM f""")
def code_crossref(spark, sf_dir):
    s = F.col("p_size")
    fx = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.substring(F.lit("ABW"), 1 + s % 3, F.lit(1)), F.when(s % 4 == 0, "-").otherwise(""), F.col("p_partkey") % 40).alias("code"), F.when(s % 2 == 0, "Battery pack lamp").otherwise("lamp").alias("description"))
    rows = table(spark, sf_dir, "lineitem")
    pc = rows.select(F.concat(F.substring(F.lit("ABW"), (1 + F.col("l_linenumber") % 3).cast("int"), F.lit(1)), F.when(F.col("l_partkey") % 3 == 0, "L").otherwise(""), F.col("l_partkey") % 60, F.when(F.col("l_suppkey") % 5 == 0, "E").otherwise("")).alias("code"))
    return matching.corrected_codes(fx, pc)


@query(f"""WITH {POINTS}, i AS (SELECT p.vec_id, s.vec_id AS sid, p.x, p.y, s.x AS ax, s.y AS ay, s.x2 AS bx, s.y2 AS b_y FROM pts p JOIN pts s ON p.label = s.label AND (s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) < 22500 AND (s.x2 - p.x) * (s.x2 - p.x) + (s.y2 - p.y) * (s.y2 - p.y) < 22500)
SELECT vec_id, count(*) AS segments, round(CASE WHEN count(*) >= 2 THEN stddev_pop(sqrt(((ax + bx) / 2 - x) * ((ax + bx) / 2 - x) + ((ay + b_y) / 2 - y) * ((ay + b_y) / 2 - y))) ELSE 999.0 END, 4) AS spread FROM i GROUP BY 1""")
def polygon_quality(spark, sf_dir):
    p = points(spark, sf_dir)
    segments = p.select("label", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"))
    return spatial.polygon_quality(p.select("vec_id", "label", "x", "y"), segments, ["label"], "vec_id", reach=150.0).select("vec_id", "segments", F.round("spread", 4).alias("spread"))


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, k, ws[k] AS t FROM (SELECT doc_id, line_no, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM doc_lines))
SELECT a.doc_id AS page_id, a.line_no AS line, CAST(a.k - 1 AS INT) AS k FROM w a WHERE a.t = 'the' AND EXISTS (SELECT 1 FROM w b WHERE b.doc_id = a.doc_id AND b.line_no = a.line_no AND b.k < a.k AND b.k > a.k - 3 AND b.t IN ('for', 'for,', 'for.', 'with', 'with,', 'with.'))""")
def crossref_words(spark, sf_dir):
    words = lines(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("line"), F.posexplode(F.split("text", " ")).alias("k", "text")).withColumns({"x": F.col("k") * 20.0, "y": F.col("line") * 20.0})
    return spatial.near_words(words.filter("text = 'the'"), words.filter(F.col("text").rlike("^(for|with)[,.]?$")), "page_id", ["for", "with"]).select("page_id", "line", "k")


@query(f"WITH {SHEETS}, r AS (SELECT DISTINCT page_id AS id, upper(unnest(regexp_extract_all('see page ' || (page_id % 50) || ' and E' || ((page_id * 11) % 990), '\\b(E?[0-9]+)\\b', 1))) AS ref FROM pages) SELECT DISTINCT id, s.page_id FROM r JOIN sheets s ON upper(s.code) = ref OR CAST(s.page_id AS VARCHAR) = ref")
def chat_page_refs(spark, sf_dir):
    s = sheets(spark, sf_dir)
    asked = s.select(F.col("page_id").alias("id"), F.concat(F.lit("see page "), F.col("page_id") % 50, F.lit(" and E"), (F.col("page_id") * 11) % 990).alias("text"))
    return matching.page_references(asked, s.select("page_id", "code"), "id", r"\b(E?[0-9]+)\b").select("id", "page_id")


@query("SELECT n_regionkey, n_name AS plan, coalesce(lag(n_name) OVER w, last_value(n_name) OVER z) AS previous, coalesce(lead(n_name) OVER w, first_value(n_name) OVER z) AS \"next\" FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey), z AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def plan_neighbours(spark, sf_dir):
    return matching.neighbours(table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("plan"), "n_nationkey"), "n_regionkey", "n_nationkey").drop("n_nationkey")


_KC = """g AS (SELECT event_type AS plan, user_id AS number, count(*) - 2 AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), v AS (SELECT event_type AS plan, user_id AS number, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)"""


def _keynote_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("plan"), F.col("user_id").alias("number"), "event_id")
    return e.filter("event_id % 2 = 0").groupBy("plan", "number").agg((F.count("*") - 2).alias("n")), e.filter("event_id % 3 = 0").groupBy("plan", "number").agg(F.count("*").alias("n"))


@query(f"WITH {_KC} SELECT plan, number, CASE WHEN coalesce(g.n, 0) > 0 THEN g.n ELSE coalesce(v.n, 0) END AS n FROM g FULL JOIN v USING (plan, number)")
def keynote_preferred(spark, sf_dir):
    return matching.preferred_counts(*_keynote_counts(spark, sf_dir))


@query(f"WITH {_KC} SELECT number, plan, coalesce(g.n, v.n) AS n FROM v FULL JOIN g USING (number, plan) WHERE v.n IS NOT NULL OR g.n > 0")
def keynote_sync(spark, sf_dir):
    new, held = _keynote_counts(spark, sf_dir)
    return matching.synced_counts(held, new)


@query("SELECT 'check' || n_nationkey AS \"check\", CASE WHEN n_nationkey % 3 = 0 AND n_nationkey < 20 THEN 'info' ELSE 'warning' END AS severity FROM nation")
def verdict_downgrade(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("check"), "n_nationkey").alias("check"), "n_nationkey", F.lit("warning").alias("severity"))
    verdicts = n.filter("n_nationkey < 20").select("check", F.when(F.col("n_nationkey") % 3 == 0, "false_alarm").otherwise("confirmed").alias("verdict"))
    return matching.downgraded(n.select("check", "severity"), verdicts)


@query(f"WITH {CORR} SELECT source_key, string_agg(n || ' ' || action, ', ' ORDER BY action) AS actions FROM (SELECT source_key, action, count(*) AS n FROM corr GROUP BY 1, 2) GROUP BY 1")
def corr_by_action(spark, sf_dir):
    n = events_as_corrections(spark, sf_dir).groupBy("source_key", "action").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("action", "n"))), lambda x: F.concat_ws(" ", x["n"], x["action"]))
    return n.groupBy("source_key").agg(F.array_join(listed, ", ").alias("actions"))


@query(f"WITH {FIX} SELECT id, code, CASE WHEN c >= 0.95 THEN 'green' WHEN c >= 0.8 THEN 'yellow' ELSE 'red' END AS band FROM (SELECT id, code, 1 - (p_size % 30) / 100.0 AS c FROM fix)")
def qa_bands(spark, sf_dir):
    return fixtures(spark, sf_dir).select("id", "code", quality.band(1 - (F.col("p_size") % 30) / F.lit(100.0)).alias("band"))


@query("WITH t AS (SELECT p_brand, p_size % 3 AS total, length('x' || repeat('y', p_size % 2)) AS n FROM part), a AS (SELECT p_brand, avg(total) FILTER (WHERE n = 1) AS short, avg(total) FILTER (WHERE n > 1) AS multi FROM t GROUP BY 1) SELECT p_brand, round(short, 4) AS short, round(multi, 4) AS multi, coalesce(short > 5 * multi, false) AS suspicious FROM a")
def short_code_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).alias("total"), (F.col("p_size") % 2 == 0).alias("one"))
    a = t.groupBy("p_brand").agg(F.avg(F.when(F.col("one"), F.col("total"))).alias("short"), F.avg(F.when(~F.col("one"), F.col("total"))).alias("multi"))
    return a.select("p_brand", F.round("short", 4).alias("short"), F.round("multi", 4).alias("multi"), F.coalesce(F.col("short") > 5 * F.col("multi"), F.lit(False)).alias("suspicious"))


@query(f"WITH {SHEETS} SELECT page_id, row_number() OVER (PARTITION BY page_id // 500 ORDER BY CASE WHEN page_id % 500 = 0 THEN 0 ELSE 1 END, page_id) AS ord FROM sheets WHERE page_id % 500 = 0 OR contains(lower(title), 'symbol') OR contains(lower(title), 'cover')")
def page_candidates(spark, sf_dir):
    """Pages of each drawing set (500 pages) worth searching for an index, the first page in front."""
    s = sheets(spark, sf_dir)
    hit = s.filter((F.col("page_id") % 500 == 0) | F.lower("title").contains("symbol") | F.lower("title").contains("cover"))
    from pyspark.sql import Window

    return hit.select("page_id", F.row_number().over(Window.partitionBy(F.expr("page_id div 500")).orderBy(F.when(F.col("page_id") % 500 == 0, 0).otherwise(1), "page_id")).alias("ord"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') || '_' || substr(md5('data/' || p_name), 1, 8) AS source_key FROM part")
def source_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.source_key(F.concat(F.lit("data/"), "p_name")).alias("source_key"))


_CELL = "cl AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || substr(p_type, 1, 2 + p_size % 3) || p_size || ' ' || p_partkey % 3000 || ' ' WHEN 1 THEN substr(p_name, 1, 4 + p_size % 12) WHEN 2 THEN 'F' || p_size || '  ' || substr(p_type, 1, p_size % 9) ELSE p_brand || p_size END AS cell FROM part)"


@query(f"""WITH {_CELL}, c AS (SELECT p_partkey, trim(cell) AS c FROM cl), f AS (SELECT *, regexp_extract(c, '^(\\S+)', 1) AS first, trim(regexp_extract(c, '^\\S+\\s+(.*)$', 1)) AS rest FROM c)
SELECT p_partkey, CASE WHEN regexp_full_match(c, '[A-Za-z][A-Za-z0-9./-]{{0,9}}') THEN c WHEN regexp_full_match(first, '[A-Za-z][A-Za-z0-9./-]{{0,9}}') AND rest <> '' AND (length(rest) <= 5 OR regexp_full_match(rest, '[0-9]+')) THEN first ELSE '' END AS code FROM f""")
def merged_cell_codes(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    cell = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.expr("substr(p_type, 1, 2 + p_size % 3)"), s, F.lit(" "), k % 3000, F.lit(" ")))
        .when(k % 4 == 1, F.expr("substr(p_name, 1, 4 + p_size % 12)"))
        .when(k % 4 == 2, F.concat(F.lit("F"), s, F.lit("  "), F.expr("substr(p_type, 1, p_size % 9)")))
        .otherwise(F.concat("p_brand", s))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.code_of_cell(cell).alias("code"))


_NAMES = ["LEVEL %s ENLARGED LIGHTING PLAN", "Mezzanine %s plan", "%sTH FLOOR LIGHTING PLAN", "Rooftop %s", "Area %s lighting", "Enlarged Lobby lighting plan %s", "Lighting plan", "electrical x %s", "%s mezz level 2", "parking area '%s'"]
_LABELS = " ".join(f"WHEN regexp_matches(title, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN replace('{label}', '{{0}}', regexp_extract(title, '(?i){p.replace(chr(39), chr(39) * 2)}', 1))" for p, label in text.VIEWPORT_LABELS)


@query(f"""WITH n AS (SELECT o_orderkey, replace(([{', '.join("'" + x.replace("'", "''") + "'" for x in _NAMES)}])[1 + o_orderkey % {len(_NAMES)}], '%s', CAST(o_custkey % 40 AS VARCHAR)) AS title FROM orders),
w AS (SELECT *, list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda x: lower(x) NOT IN ({', '.join(repr(x) for x in text.PLAIN_TITLE_WORDS)}) AND length(x) > 1) AS words FROM n)
SELECT o_orderkey, CASE {_LABELS} WHEN len(words) > 0 THEN upper(substr(words[1], 1, 3)) ELSE 'VP' END AS label FROM w""")
def viewport_labels(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % len(_NAMES)).cast("int"))
    title = F.replace(name, F.lit("%s"), (F.col("o_custkey") % 40).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.viewport_label(title).alias("label"))


@query("WITH k AS (SELECT c_custkey, 'src' || (c_custkey % 20) || ' main' AS name FROM customer) SELECT DISTINCT name, 'Src' || regexp_extract(name, '([0-9]+)', 1) AS source FROM k WHERE CAST(regexp_extract(name, '([0-9]+)', 1) AS INT) BETWEEN 10 AND 19 UNION ALL SELECT DISTINCT name, NULL FROM k WHERE CAST(regexp_extract(name, '([0-9]+)', 1) AS INT) < 10")
def source_match(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("src"), F.col("c_custkey") % 20, F.lit(" main")).alias("name")).distinct()
    known = spark.range(10, 20).select(F.concat(F.lit("Src"), "id").alias("source"), F.col("id").alias("ord"))
    return matching.resolved_source(names, known)


_SAY = " ".join("WHEN '" + c + "' THEN '" + t.replace("'", "''").replace("%s", "' || fixture_code || '") + "'" for c, t in reports.SAYINGS.items())


@query(f"WITH {CORR}, {_CAT}, {_MINE} SELECT category, fixture_code, CASE category {_SAY} END || ' (' || source_count || ' sources)' AS description, CASE category WHEN 'phantom_fixture_type' THEN 'remove' WHEN 'missing_fixture_type' THEN 'add' ELSE 'warn' END AS action FROM mined")
def pattern_descriptions(spark, sf_dir):
    return reports.described(corr.mine_patterns(events_as_corrections(spark, sf_dir))).select("category", "fixture_code", "description", "action")


@query("""WITH i AS (SELECT p_brand, p_name || '/' || p_partkey AS code, (p_size % 40) / 64.0 AS confidence FROM part WHERE p_size % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY confidence, code) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM i)
SELECT p_brand, CAST(k AS INT) AS line_no, code AS line FROM r WHERE k <= 10 UNION ALL SELECT p_brand, 11, '... and ' || (n - 10) || ' more' FROM r WHERE k = 1 AND n > 10""")
def qa_flagged_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select("p_brand", F.concat_ws("/", "p_name", "p_partkey").alias("code"), ((F.col("p_size") % 40) / F.lit(64.0)).alias("confidence"))
    return reports.report_lines(p, "p_brand").withColumn("line", F.regexp_replace("line", ": [0-9]+%$", ""))


@query("SELECT event_id, CASE WHEN k = 1 THEN b ELSE b || '_' || (k - 1) END AS id FROM (SELECT event_id, event_type || '_' || user_id AS b, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events)")
def unique_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", "user_id").alias("name"))
    return reports.unique_ids(e, "name", "event_id").select("event_id", "id")


@query(f"WITH {LINES}, {CELLS}, s AS (SELECT table_id, col_idx, sum(CASE WHEN regexp_matches(trim(text), '^[A-Za-z]{{1,3}}[0-9]+(\\.[0-9]+)?[A-Za-z]{{0,2}}$') THEN 2 WHEN length(trim(text)) BETWEEN 1 AND 8 THEN 1 ELSE 0 END) AS score FROM cells GROUP BY 1, 2) SELECT table_id, CAST(col_idx AS INT) AS col_idx, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, col_idx) AS k FROM s) WHERE k = 1")
def header_column_guess(spark, sf_dir):
    return reports.column_scores(cells(spark, sf_dir))


@query(f"""WITH {SHEETS}, t AS (SELECT page_id, title, 'E' || (page_id % 30) AS code, coalesce({rules.sql_first_match('title', rules.TYPE_OF_TITLE)}, 'other') AS ty FROM sheets), u AS (SELECT page_id, title, code, CASE WHEN ty = 'demolition_plan' AND page_id % 2 = 0 THEN 'lighting_plan' ELSE ty END AS ty FROM t),
d AS (SELECT count(DISTINCT ty) AS n FROM (SELECT ty FROM u GROUP BY ty, code HAVING count(*) > 1)), c AS (SELECT count(*) FILTER (WHERE ty = 'lighting_plan' AND contains(lower(title), 'demo')) AS demo FROM u)
SELECT * FROM (SELECT 'no_sheet_index' AS "check", 'warning' AS severity, CAST(0.1 AS DOUBLE) AS deduction UNION ALL SELECT 'possible_misclassification', 'warning', round(CAST(0.1 * demo AS DOUBLE), 4) FROM c UNION ALL SELECT 'duplicate_sheet_codes', 'warning', round(CAST(0.05 * n AS DOUBLE), 4) FROM d) WHERE deduction > 0""")
def verify_search(spark, sf_dir):
    s = sheets(spark, sf_dir)
    kind = F.coalesce(rules.first_match(F.col("title"), rules.TYPE_OF_TITLE), F.lit("other"))
    pages = s.select(F.concat(F.lit("E"), F.col("page_id") % 30).alias("sheet_code"), F.col("title").alias("sheet_title"), F.when((kind == "demolition_plan") & (F.col("page_id") % 2 == 0), "lighting_plan").otherwise(kind).alias("page_type"))
    return reports.verify_pages(pages, has_index=False)


@query("""WITH f AS (SELECT o_orderpriority AS stage, o_orderkey AS seq, 'Issue with order ' || o_orderkey AS message FROM orders WHERE o_orderkey % 5 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq) AS k FROM f) SELECT stage, message FROM k WHERE k <= 2 ORDER BY stage, message LIMIT 8""")
def suggestions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("Issue with order "), "o_orderkey").alias("message"), (F.col("o_orderkey") % 5 != 0).alias("passed"))
    return reports.suggestions(o, "stage")
