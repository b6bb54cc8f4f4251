"""Glyphs of PDF pages as a Spark data source, one partition a file. Needs a PDF decoder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_glyphs"

    def schema(self) -> str:
        return "source_path string, page_number int, char_index long, text string, x0 double, top double, x1 double, bottom double, size double"

    def reader(self, schema) -> DataSourceReader:
        return PdfReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class PdfFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PdfReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [PdfFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pdfplumber

        with pdfplumber.open(partition.path) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                for k, c in enumerate(page.chars):
                    yield (partition.path, number, k, c["text"], float(c["x0"]), float(c["top"]), float(c["x1"]), float(c["bottom"]), float(c["size"]))
