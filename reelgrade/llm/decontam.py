"""Benchmark decontamination by a prefix-filtered set join, in built-in SQL functions only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 10, 3
#: Shingles (8 bytes each), and windows with their words (some 300 bytes each), that one pass over the documents' words
#: sends to every task; a larger benchmark takes more passes.
SENT_SHINGLES, SENT_WINDOWS = 1_000_000, 100_000


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; other letters keep their case. A null text has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _shingle(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(w, i + (j - 1)) for j in range(k)))


def _starts(w: Column, k: int) -> Column:
    """1-based starts of the runs of k words."""
    n = F.size(w) - (k - 1)
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows (words), and which item (its id as a string; null: empty) holds which window."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = F.when(F.size("w") >= WINDOW, F.transform(_starts(F.col("w"), WINDOW), lambda i: F.slice(F.col("w"), i, F.lit(WINDOW))))
    held = w.select("item", F.explode(cut.otherwise(F.array("w"))).alias("words")).distinct()
    return held.select("words").distinct(), held


def _shingles(rows: DataFrame, w: str, k: int) -> DataFrame:
    """A row for each run of k words: at, its 1-based place, and h, its hash; the columns of ``rows`` stay."""
    return rows.withColumn("at", F.explode(_starts(F.col(w), k))).withColumn("h", _shingle(F.col(w), F.col("at"), k))


def _blocks(table: DataFrame, n: int, size: int) -> Iterator[DataFrame]:
    """The table in parts of about ``size`` of its n rows, by its hash column h."""
    parts = -(-n // size)
    for i in range(parts):
        yield table if parts == 1 else table.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == i)


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 10 consecutive words of an item (a shorter item is one window). Its shingles (3 words, or all of a
    shorter window) are ordered by how often they stand in all documents; since a window must be contained whole, the
    one rarest is the prefix that every occurrence must hold. Shingles of the documents are joined with the prefixes;
    the window must fit into the document at that offset, and is then compared word by word.

    The documents are cut into words once, and that table is read twice: to count the benchmark's shingles, and to
    look for the prefixes. Both times a counted number of shingles or windows is sent to every task, and a larger
    benchmark takes more passes. Items are listed once for each different set of windows that documents hold.

    Documents and items with null or empty texts, or no words, have no words, windows or hits. A null document id is
    kept; a null item id counts as the empty string. Repeated documents come back as often as they went in; repeated
    items count once. Without items, nothing is hit. Other columns are not read, whatever their names.
    """
    space = Workspace(docs.sparkSession, "decontam")
    distinct, held = benchmark_windows(items, item_col, item_text)
    windows = space.table(distinct.select("words", F.size("words").alias("len"), F.monotonically_increasing_id().alias("win")), "windows")
    sizes = sorted(r["k"] for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect())  # of 1, 2, 3

    split = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    split = split.select(F.monotonically_increasing_id().alias("row"), "id", F.size("w").cast("long").alias("n_words"), "w")
    split = space.table(split, "words")  # rows are fixed by writing
    base = split.select("row", "id", "n_words")

    hits = None
    for k in sizes:
        parts = space.table(_shingles(windows.where(F.least("len", F.lit(SHINGLE)) == k), "words", k), f"shingles-{k}")
        wanted = parts.select("h").distinct()
        found = [
            _shingles(split.select("w"), "w", k).select("h").join(F.broadcast(block), "h").groupBy("h").agg(F.count("*").alias("n"))
            for block in _blocks(wanted, wanted.count(), SENT_SHINGLES)
        ]
        counts = [space.table(x, "counts") for x in found]
        first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("p")
        rare = parts.join(_union(counts), "h", "left").groupBy("win", "words", "len").agg(first)
        rare = space.table(rare.select("win", "words", "len", F.col("p.h").alias("h"), F.col("p.at").alias("off")), "prefixes")
        for block in _blocks(rare, rare.count(), SENT_WINDOWS):
            met = _shingles(split.where(F.size("w") >= k).select("row", "w"), "w", k).join(F.broadcast(block), "h")
            met = met.withColumn("b", F.col("at") - F.col("off") + 1).where((F.col("b") >= 1) & (F.col("b") + F.col("len") - 1 <= F.size("w")))
            met = met.where(F.slice("w", F.greatest("b", F.lit(1)), F.col("len")) == F.col("words"))
            met = space.table(met.select("row", "win", "b", (F.col("b") + F.col("len")).alias("e")), "hits")
            hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        hits = windows.select(F.col("win").alias("row"), "win", F.col("len").alias("b"), F.col("len").alias("e"))  # empty

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        "spans", zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["e"] - F.greatest(x["b"], s["end"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(s["end"], x["e"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    hit = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("b", "e"))).alias("spans"), F.array_sort(F.collect_set("win")).alias("wins")
    )
    hit = space.table(hit.select("row", total.alias("n_hit"), "wins", F.sha2(F.array_join(F.col("wins").cast("array<string>"), ","), 256).alias("set")), "hit")
    sets = hit.groupBy("set").agg(F.first("wins").alias("wins")).select("set", F.explode("wins").alias("win"))
    named = held.join(windows.select("words", "win").hint("merge"), "words").select("win", "item")
    listed = sets.join(named.hint("merge"), "win").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = space.table(hit.select("row", "n_hit", "set").join(listed.hint("merge"), "set"), "told")
    told = base.join(hit.hint("merge"), "row", "left")
    none = F.lit(0).cast("long")
    return told.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Which words of every document stand in windows of benchmark items."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
t AS (
  SELECT row, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT row, p, n, item FROM t JOIN v USING (n, win)),
c AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN i USING (row)
"""
