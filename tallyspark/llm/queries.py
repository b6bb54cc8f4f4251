"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    pieces = packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import licences

    found = licences(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "licence", F.array_join("line_licences", ",").alias("line_licences"), F.size("line_licences").cast("long").alias("n_line_licences"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, joined, of_kinds, personal_data

    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [k.name for k in BASE]
    counts = [F.size(of_kinds(F.col("spans"), [n])).cast("long").alias(f"n_{n}") for n in names]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans"), names).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 1)), ",").alias("scores"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, similarity=(85, 100))


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .binary_output import round_trip

    back = round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_covered", "n_words")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identified, learned_from

    found = identified(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked

    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroid_clustering import clustered

    return clustered(read(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed="3")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learned_from, scored

    found = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_decontamination": op2_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_pii": op4_pii,
        "op5_ngram_join": op5_ngram_join,
        "op6_binary_output": op6_binary_output,
        "op7_html_extraction": op7_html_extraction,
        "op8_language_id": op8_language_id,
        "op9_url_filter": op9_url_filter,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_toxicity": op13_toxicity,
    }


UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP2_SQL = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + 9), ' ') AS t FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win))),
m AS (SELECT doc_id, i, win.n, item_id FROM d JOIN win ON d.n = win.n AND d.t = win.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP5_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON x = cx.doc_id JOIN c cy ON y = cy.doc_id WHERE 100 * k >= 85 * (cx.n + cy.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN c USING (doc_id)"""

OP10_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) >= 0.9 * a.norm * b.norm),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, CAST((SELECT count(*) FROM l WHERE x = vec_id) AS BIGINT) AS n_links, least(vec_id, coalesce((SELECT min(y) FROM r WHERE x = vec_id), vec_id)) AS component_id FROM embeddings)"""


OP11_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
t AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) SEMI JOIN t USING (w) GROUP BY 1, 2, 3),
f AS (SELECT w, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY w, big_n),
x AS (SELECT item_id, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score FROM t JOIN p USING (w) JOIN f USING (w), s GROUP BY 1, 2)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM x WHERE score > 0) WHERE k <= 20"""


def _op12_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Every round as three common tables: distances, choices, means."""
    steps = [
        f"x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, cluster, d FROM (SELECT x.vec_id, x.v, c.cluster, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY d, c.cluster) AS k FROM x, c{r} c) WHERE k = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, CAST(floor(CAST(sum(e) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT cluster, unnest(v) AS e, unnest(range(1, {size} + 1)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (cluster))")
    last = f"SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c USING (cluster)"
    return "WITH " + ",\n".join(steps) + "\n" + last


def _op3_sql() -> str:
    from .licence_texts import KNOWN
    from .license_scan import COPYRIGHT_LINE, SPELLINGS

    def form(c: str) -> str:
        out = f"regexp_replace(translate({c}, {UPPER}, {LOWER}), '{COPYRIGHT_LINE}', ' ', 'g')"
        for other, one in SPELLINGS:
            out = f"replace({out}, '{other}', '{one}')"
        return f"nullif(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')), '')"

    known = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in KNOWN)
    return f"""WITH known AS (SELECT sha256({form("t")}) AS k, min(n) AS licence FROM (VALUES {known}) v(n, t) GROUP BY 1),
lines AS (SELECT doc_id, sha256({form("line")}) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names, count(DISTINCT licence) AS n FROM lines JOIN known USING (k) GROUP BY 1)
SELECT d.doc_id, sha256({form("d.text")}) AS digest, known.licence, coalesce(names, '') AS line_licences, CAST(coalesce(n, 0) AS BIGINT) AS n_line_licences FROM documents d LEFT JOIN known ON known.k = sha256({form("d.text")}) LEFT JOIN found ON found.doc_id = d.doc_id"""


def _op9_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract({rest}, '^[^/?#]*'), {UPPER}, {LOWER}) AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, u.host, u.path, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS k FROM u JOIN (VALUES {rules}) r(h, p, v) ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator's query."""
    return {
        "op2_decontamination": OP2_SQL,
        "op3_license_scan": _op3_sql(),
        "op5_ngram_join": OP5_SQL,
        "op9_url_filter": _op9_sql(),
        "op10_embedding_dedup": OP10_SQL,
        "op11_lexical_search": OP11_SQL,
        "op12_centroid_clustering": _op12_sql(),
    }
