"""Tokens to vectors of windows and scenes (with a cache), and windows' episode scores to scenes' features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import CATEGORIES, EPISODE_CHARS, EPISODE_TOKENS, TOP_WINDOWS
from .models import head_value


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def aggregate_windows(windows: DataFrame, scene_col: str, window_col: str, vector_col: str, top: int = TOP_WINDOWS) -> DataFrame:
    """One row per scene and position: mean, max and the mean of the ``top`` windows with the largest norm (ties: later windows)."""
    w = windows.select(scene_col, window_col, vector_col, norm(F.col(vector_col)).alias("size"))
    place = F.expr(f"row_number() OVER (PARTITION BY {scene_col} ORDER BY size DESC, {window_col} DESC)")
    largest = w.withColumn("place", place).where(F.col("place") <= top).select(scene_col, F.posexplode(vector_col).alias("pos", "x"))
    largest = largest.groupBy(scene_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("top_mean"))
    each = windows.select(scene_col, F.posexplode(vector_col).alias("pos", "x"))
    each = each.groupBy(scene_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.max(F.col("x").cast("double")).alias("max"))
    return each.join(largest, [scene_col, "pos"])


def scene_vectors(windows: DataFrame, scene_col: str, window_col: str, vector_col: str, top: int = TOP_WINDOWS) -> DataFrame:
    """One row per scene: the array mean, then max, then top mean (three times the vectors' width)."""
    rows = aggregate_windows(windows, scene_col, window_col, vector_col, top)
    parts = F.array_sort(F.collect_list(F.struct("pos", "mean", "max", "top_mean")))
    part = lambda name: F.transform(F.col("parts"), lambda x: x[name])
    return rows.groupBy(scene_col).agg(parts.alias("parts")).select(scene_col, F.concat(part("mean"), part("max"), part("top_mean")).alias("vector"))


def episode_aggregates(scored: DataFrame, scene_col: str, category_col: str = "category", top: int = TOP_WINDOWS) -> DataFrame:
    """One row per scene and category from windows' ``bin`` and ``sev``: max, mean and mean of the largest ``top`` of each."""
    parts = []
    for name in ("bin", "sev"):
        place = F.expr(f"row_number() OVER (PARTITION BY {scene_col}, {category_col} ORDER BY {name} DESC)")
        largest = scored.withColumn("place", place).where(F.col("place") <= top).groupBy(scene_col, category_col)
        parts.append(largest.agg(F.avg(name).alias(f"{name}_top")))
    whole = scored.groupBy(scene_col, category_col).agg(*(f(n).alias(f"{n}_{k}") for n in ("bin", "sev") for k, f in (("max", F.max), ("mean", F.avg))))
    return whole.join(parts[0], [scene_col, category_col]).join(parts[1], [scene_col, category_col])


def linear_scores(vectors: DataFrame, vector_col: str, heads: dict[str, dict]) -> DataFrame:
    """One row per window and category: ``bin`` (a classifier's probability) and ``sev`` (a regression's value, 0 to 1), from
    the heads of each category under these names."""
    value = lambda head: head_value(head, F.col(vector_col))
    rows = F.array(*(F.struct(F.lit(c).alias("category"), value(own["bin"]).alias("bin"), value(own["sev"]).alias("sev")) for c, own in heads.items()))
    keep = [c for c in vectors.columns if c != vector_col]
    return vectors.select(*keep, F.explode(rows).alias("s")).select(*keep, "s.*")


def episode_max(aggregates: DataFrame, scene_col: str, category_col: str = "category") -> DataFrame:
    """One row per scene: the largest ``bin`` of each category, as columns episode_<category>; nothing found is 0."""
    each = (F.max(F.when(F.col(category_col) == c, F.col("bin_max"))) for c in CATEGORIES)
    return aggregates.groupBy(scene_col).agg(*(F.coalesce(x, F.lit(0.0)).alias(f"episode_{c}") for c, x in zip(CATEGORIES, each, strict=True)))


def masked_mean_pool(tokens: DataFrame, key_col: str, vector_col: str, mask_col: str) -> DataFrame:
    """One row per key and position: the mean of the token vectors whose mask is 1; without any, 0."""
    each = tokens.select(key_col, F.col(mask_col).cast("double").alias("m"), F.posexplode(vector_col).alias("pos", "x"))
    whole = F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))
    return each.groupBy(key_col, "pos").agg(whole.alias("mean"))


def cache_key(text: Column, length: int, stride: int) -> Column:
    """The key under which a text's vector is kept."""
    return F.sha1(F.concat(F.coalesce(text, F.lit("")), F.lit(f"|{length}|{stride}")))


def cached_vectors(scenes: DataFrame, text_col: str, path: str, compute: Callable[[DataFrame], DataFrame], length: int, stride: int) -> DataFrame:
    """``scenes`` with ``vector``, from the table of vectors at ``path``.

    Only texts whose key the table lacks are encoded, each once: ``compute`` gets (key, text) and gives (key, vector),
    which is appended to the table.
    """
    spark = scenes.sparkSession
    keyed = scenes.withColumn("key", cache_key(F.col(text_col), length, stride))
    form = "key string, vector array<double>"
    try:
        there = spark.read.schema(form).parquet(path)
    except AnalysisException:
        there = spark.createDataFrame([], form)
    new = keyed.select("key", F.col(text_col).alias("text")).dropDuplicates(["key"]).join(there.select("key"), "key", "left_anti")
    compute(new).select("key", F.col("vector").cast("array<double>")).write.mode("append").parquet(path)
    held = spark.read.schema(form).parquet(path).dropDuplicates(["key"])
    return keyed.join(held, "key", "left").drop("key")


def episode_text(text: Column) -> Column:
    """What of an episode is encoded for training."""
    return F.substring(F.coalesce(text, F.lit("")), 1, EPISODE_CHARS)


def episode_tokens(tokens: Column) -> Column:
    return F.slice(tokens, 1, EPISODE_TOKENS)


def episode_vectors(episodes: DataFrame, tokenize: Callable[[Column], Column], make: Callable[[], Encoder], text_col: str = "text") -> DataFrame:
    """``episodes`` with ``vector``, for training: one window of their first characters and tokens; a null text is empty."""
    tokens = episode_tokens(tokenize(episode_text(F.col(text_col))))
    return encode_windows(episodes.withColumn("tokens", tokens), "tokens", make).drop("tokens")


Encoder = Callable[[list[list[int]]], np.ndarray]


def hashing_encoder(width: int = 64) -> Encoder:
    """A stand-in for a language model, alike on every machine: each token adds a fixed pseudo-random direction."""

    def encode(windows: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(windows), width), np.float32)
        for i, tokens in enumerate(windows):
            for t in tokens:
                x = (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((int(t) & 0xFFFFFFFF) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
                x ^= x >> np.uint64(29)
                out[i] += ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.float32) / 2**24 - 0.5
            out[i] /= max(len(tokens), 1)
        return out

    return encode


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each row's token vectors [row, token, width] where the mask is 1; without any, 0."""
    m = (np.asarray(mask) > 0).astype(np.float32)[:, :, None]
    return (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)


def session_encoder(session, pad: int = 0) -> Encoder:
    """An encoder from a model session whose ``run(None, {input_ids, attention_mask})`` gives the last hidden states first."""

    def encode(windows: list[list[int]]) -> np.ndarray:
        longest = max((len(w) for w in windows), default=0)
        ids = np.full((len(windows), max(longest, 1)), pad, np.int64)
        mask = np.zeros_like(ids)
        for i, w in enumerate(windows):
            ids[i, : len(w)] = w
            mask[i, : len(w)] = 1
        return masked_mean(session.run(None, {"input_ids": ids, "attention_mask": mask})[0], mask).astype(np.float32)

    return encode


def onnx_encoder(path: str, pad: int = 0) -> Callable[[], Encoder]:
    """A factory of encoders for a transformer exported as ONNX, readable at ``path`` on every executor; needs the optional
    package onnxruntime there. It runs on a GPU where the package finds one."""

    def make() -> Encoder:
        import onnxruntime

        return session_encoder(onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers()), pad)

    return make


def encode_windows(windows: DataFrame, tokens_col: str, make: Callable[[], Encoder], batch: int = 8) -> DataFrame:
    """``windows`` with a ``vector`` column; ``make`` is called once for each Python worker's run, and loads the model there."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in parts:
            rows = [list(t) if t is not None else [] for t in part]
            yield pd.Series([v for i in range(0, len(rows), batch) for v in encode(rows[i : i + batch])])

    return windows.withColumn("vector", run(F.col(tokens_col)))


def feature_columns(width: int) -> list[str]:
    """The names of a feature row's numbers: the scene's vector, rule counts, tag features, episode aggregates."""
    return (
        [f"{k}_{i}" for k in ("mean", "max", "top") for i in range(width)]
        + [f"count_{c}" for c in CATEGORIES]
        + [f"{k}_{c}" for k in ("tag", "tags") for c in CATEGORIES]
        + [f"{c}_{k}" for c in CATEGORIES for k in ("bin_max", "bin_mean", "bin_top", "sev_max", "sev_mean", "sev_top")]
    )
