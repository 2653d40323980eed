"""Writers of reports, label tables, rejects and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segment import preview
from ..functions.values import PREVIEW_CHARS


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a line, letters as they are."""
    reports.select(F.to_json("report", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Labels, episodes and scene tables; ``mode`` append for annotations, which are a table of their own."""
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("overwrite").partitionBy("reason").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def dump_lines(scenes: DataFrame) -> DataFrame:
    """One line per scene: its number from 0, and the beginning of its text."""
    return scenes.select(F.format_string("%04d: %s", F.col("scene_index") - 1, preview(F.col("text"), PREVIEW_CHARS)).alias("value"))
