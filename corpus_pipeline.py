"""A training-data pipeline made of the operators of ``reelgrade.llm``.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's ``docs``. Rows with the same doc_id count as one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrade.llm.decontam import find_contamination
from reelgrade.llm.langid import fit_languages, language_of
from reelgrade.llm.neardup import near_duplicates
from reelgrade.llm.pieces import encode_pieces, piece_digests
from reelgrade.llm.store import Workspace


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, those without letters and those in no learned language go."""
    found = _free(docs, "language")
    judged = docs.withColumn(found, language_of(docs, fit_languages(docs)))
    return judged.where(~F.col(f"{found}.rejected")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each near-duplicate group; documents without an id stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    once = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns)
    nth = _free(docs, "nth")
    once = once.withColumn(nth, F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY text)")).where(F.col(nth) == 1)
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    name = _free(docs, "key")
    keyed = docs.withColumn(name, key)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = find_contamination(keyed, items, id_col=name).where("contaminated").select(name).distinct()
    return keyed.join(hit.hint("merge"), name, "left_anti").select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of what is left."""
    return piece_digests(encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: The stages are not expressible in SQL as a whole; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
