"""Scenes rated as they arrive. Every operator on scenes works in its row, so a stream takes the same plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratings import age_name
from ..operators.rating import rate_scenes


def rate_stream(scenes: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The stream with a rating for each scene; no state is kept."""
    return rate_scenes(scenes, text_col, **options).withColumn("scene_rating", age_name(F.col("age_rank")))


def running_ratings(scenes: DataFrame, id_col: str = "script_id", text_col: str = "text", **options) -> DataFrame:
    """The highest age so far of each script; the state is one number a script. Write it with output mode ``update``."""
    rated = rate_scenes(scenes, text_col, **options)
    return rated.groupBy(id_col).agg(F.max("age_rank").alias("age_rank"), F.count("*").alias("scenes")).select(
        id_col, age_name(F.col("age_rank")).alias("rating"), "scenes"
    )
