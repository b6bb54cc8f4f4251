"""Readers and writers: drawing folders, result documents, matrices, stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_order, file_parts
from ..operators.dedup import keep_last

RESULT = """project_name string, total_pages int,
pages array<struct<page_number:int,sheet_code:string,description:string,type:string,source_path:string,pdf_page_index:int>>,
sheet_index array<struct<sheet_code:string,description:string,type:string>>, lighting_plans array<string>, schedule_pages array<string>,
fixtures array<struct<code:string,description:string,fixture_style:string,voltage:string,mounting:string,lumens:string,cct:string,dimming:string,max_va:string,schedule_page:string,counts_per_plan:map<string,int>,total:int>>,
keynotes array<struct<keynote_number:string,keynote_text:string,counts_per_plan:map<string,int>,total:int,fixture_references:array<string>>>,
qa_report struct<overall_confidence:double,passed:boolean,threshold:double,stage_scores:map<string,double>,warnings:array<string>,recommendations:array<string>>"""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one JSON object a file."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path).withColumn("source", F.input_file_name())


def fixtures_of(results: DataFrame) -> DataFrame:
    """(project, code, specs…, plan, n, total): the long form of the fixtures' counts."""
    one = results.select(F.col("project_name").alias("project"), F.explode("fixtures").alias("f")).select("project", "f.*")
    return one.select("*", F.explode_outer("counts_per_plan").alias("plan", "n")).drop("counts_per_plan")


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of a drawing folder in order, the last revision of each code, renumbered; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "length")
    return in_order(files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).filter("length > 0 and name not like '.%'"))


def in_order(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds code, title and page_number to files; a later file with the same code replaces an earlier one.

    One folder is one drawing set; its order needs its few names together.
    """
    from pyspark.sql import Window

    parts = files.withColumn("_o", file_order(F.col(name))).withColumn("_p", file_parts(F.col(name))).select("*", F.col("_p.code").alias("code"), F.col("_p.title").alias("title")).drop("_p")
    kept = keep_last(parts, F.upper("code"), "_o")
    return kept.withColumn("page_number", F.row_number().over(Window.orderBy("_o", name))).drop("_o")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """The fixture matrix as one table of CSV files with a header."""
    matrix.write.mode("overwrite").option("header", True).csv(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("table_id string, row_idx int, col_idx int, text string").parquet(path)


def register_pdf_source(spark: SparkSession) -> bool:
    """Registers the page reader where a PDF decoder is installed."""
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        return False
    from .pdf_pages import PdfPages

    spark.dataSource.register(PdfPages)
    return True
