"""Sharding by jump consistent hashing, in built-in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: Blocks into which each shard's rows are numbered separately; the table of block sizes has SHARDS * BLOCKS rows at most.
BLOCKS = 1024
#: Draws made in the common case; the expected number is the logarithm of the shard count.
DRAWS = 64


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a key. With one more shard, a key keeps its shard or moves to the new one.

    The i-th random number of a key is xxhash64(key, i), so that no state is kept. The bucket strictly rises with
    each draw: ``shards`` draws always suffice, and the draws after the first DRAWS are made only where needed.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def step(s: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33).cast("double") + F.lit(1.0)
        jump = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw))
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), jump.cast("long").alias("j"))).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, DRAWS))), start, step)
    if shards > DRAWS:
        more = F.aggregate(F.sequence(F.lit(DRAWS + 1), F.lit(shards)), state, step)
        state = F.when(state["j"] < shards, more).otherwise(state)
    return state["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's shard under the law ``key``: id and shard count alone decide.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (gapless from 0 in each
    shard) and grown_shard (with one shard more). A null or empty text has size 1 and checksum 0. Null ids are one
    key. Repeated rows share a shard and get slots of their own. Equal texts with different ids may part. No rows:
    no rows. Other columns are not read.

    Rows are numbered by block: each row falls into one of BLOCKS blocks by its place in the input, blocks are
    numbered on their own and shifted by the sizes of the blocks before. No shard or key is gathered in one task, and
    the texts are not shuffled.
    """
    space = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.monotonically_increasing_id(), F.lit(BLOCKS)).cast("int").alias("block"),
    )
    rows = rows.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn(
        "grown_shard", jump_shard(F.col("doc_id"), shards + 1)
    )
    rows = space.table(rows, "rows")  # the block is fixed from here on, whatever is computed again
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = sizes.select(
        "shard", "block", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY block) - n").alias("before")
    )
    slot = F.expr("row_number() OVER (PARTITION BY shard, block ORDER BY doc_id, text_crc32, size) - 1")
    placed = rows.withColumn("slot", slot.cast("long")).join(F.broadcast(before), ["shard", "block"])  # at most shards * BLOCKS rows
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("before")).alias("slot"), "grown_shard"
    )


def op2_jump_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, under the law ``key``."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
