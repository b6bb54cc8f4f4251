"""Stages of a take-off as written tables, and which of them a correction makes stale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


class StageTables:
    """Runs named stages in order and keeps each one's table under ``root``.

    A stage that is not stale is read back instead of computed; what follows a
    stale stage only because of its order is not recomputed unless it is named.
    """

    def __init__(self, spark: SparkSession, root: str, stages: list[tuple[str, Stage]]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def run(self, version: int, stale: set[str] | None = None, before: dict[str, int] | None = None) -> dict[str, int]:
        """Returns the version of each stage's table. ``stale`` None: all."""
        held = dict(before or {})
        tables: dict[str, DataFrame] = {}
        for name, stage in self.stages:
            if stale is None or name in stale or name not in held:
                stage(self.spark, tables).write.mode("overwrite").parquet(self.path(name, version))
                held[name] = version
            tables[name] = self.spark.read.parquet(self.path(name, held[name]))
        return held

    def table(self, name: str, held: dict[str, int]) -> DataFrame:
        return self.spark.read.parquet(self.path(name, held[name]))
