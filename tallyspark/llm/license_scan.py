"""Licence texts by canonical digest, in DataFrame functions only.

A text's canonical form has A-Z lower-cased, copyright lines dropped, equivalent
spellings made one and everything but letters and digits turned into single
spaces. The digest of the form is joined with the digests of known licences: for
the entire text, and for each of its lines as a text of its own (notices stand in
one line). Lines whose canonical length no known licence has are dropped before
the join, which Spark plans by the tables' sizes.

Defined results: null, empty and punctuation-only texts have no digest and no
licence; rows are judged one by one, whatever their ids, as the lines' licences are joined
back by the digest of the raw text, of which they are a function; repeated known texts
count once (smallest name); other columns of the input are not read; empty tables give empty results or no licences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import KNOWN

#: Spellings made one, in order; fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("http://", "https://"),
    ("&", " and "),
    ("version 2.0", "2.0"),
    ("version 3", "v3"),
]
#: Lines that state a copyright only.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright( \(c\)| ©)?|\(c\)|©) [^\n]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    form = F.translate(text, UPPER, LOWER)
    form = F.regexp_replace(form, COPYRIGHT_LINE, " ")
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(other), F.lit(one))
    form = F.regexp_replace(form, "[^a-z0-9]+", " ")
    return F.nullif(F.btrim(form), F.lit(""))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """The short licences and notices of ``licence_texts``."""
    rows = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in KNOWN])
    return spark.range(1).select(F.inline(rows))


def read_licences(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files, one licence each, named after its licence: any number, of any length."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("licence"), F.col("value").alias("text"))


def licences(documents: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``digest`` of the entire text, ``licence``
    that the entire text is, and ``line_licences`` found in lines (sorted)."""
    spark = documents.sparkSession
    known = known_licences(spark) if known is None else known
    table = known.select("licence", canonical(F.col("text")).alias("_form")).filter("_form is not null").groupBy(digest(F.col("_form")).alias("_known"), F.length("_form").alias("_size")).agg(F.min("licence").alias("licence"))
    least = table.agg(F.min("_size")).first()[0] or 0
    sizes = [r[0] for r in table.select("_size").distinct().limit(10_000).collect()]
    source = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.sha2(F.col(text_col).cast("binary"), 256).alias("_raw"))
    # a canonical form has at most five letters for one of the text ("&" becomes " and ")
    long_enough = source.select("_raw", F.explode(F.split("_text", "\n")).alias("_line")).filter(F.length("_line") * 5 >= least)
    lines = long_enough.select("_raw", canonical(F.col("_line")).alias("_form"))
    lines = lines.filter(F.length("_form").isin(sizes) if len(sizes) < 10_000 else F.length("_form") >= least)
    found = (
        lines.select("_raw", digest(F.col("_form")).alias("_known"))
        .join(table.select("_known", "licence"), "_known")
        .groupBy("_raw")
        .agg(F.array_sort(F.collect_set("licence")).alias("_lines"))
    )
    whole = source.select("_id", "_raw", digest(canonical(F.col("_text"))).alias("_digest"))
    # texts without a digest have a key each, so that a shuffled join does not gather them
    key = F.coalesce("_digest", F.concat(F.lit("none "), F.xxhash64("_id")))
    out = whole.withColumn("_key", key).join(table.select(F.col("_known").alias("_key"), "licence"), "_key", "left").join(found, "_raw", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_digest").alias("digest"), "licence", F.coalesce("_lines", F.array().cast("array<string>")).alias("line_licences"))
