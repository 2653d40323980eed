"""URL rules by Bloom filter cascades: exact membership of listed keys, without joining pages to lists."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that pass a level wrongly, one of so many; the first level lets pass about as many keys as are listed, if that
#: are fewer. So level 1 has 1.44 * log2(universe / listed) bits for each listed key, and all later levels together some
#: 8 bits for each, whatever the universe's size.
RATE = 16
#: The most listed keys of one cascade; a longer list is dealt by hash to several, and the pages are read for each.
MAX_LISTED = 4_000_000

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """The keys (host suffix, then path prefix) of a url that a rule of that many labels and slashes can name, longest first."""
    names, parts = F.split(host, r"\.", -1), F.split(path, "/", -1)
    hosts = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda i: i <= F.size(names)),
        lambda i: F.array_join(F.slice(names, F.size(names) - i + 1, i), "."),
    )
    paths = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda i: i < F.size(parts)),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    order = lambda a, b: F.length(b) - F.length(a)  # noqa: E731  a host's keys of one length are the same
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(keys), order))


class BloomCascade:
    """Levels of bits. Level 1 holds the listed keys, level 2 the other keys of the universe that pass level 1, and so
    on in turn, until a level lets nothing of the other side pass: then every key of the universe is judged rightly.

    A level's bits are one array of 64-bit words in a row of a table, which expressions take as a scalar: the bits are data
    of the query, of a size that is known, and not part of its text."""

    def __init__(self, levels: list[tuple[int, int, DataFrame]]):
        self.levels = levels  # bits, hashes, table

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, space: Workspace) -> BloomCascade:
        """``listed`` and ``universe`` have one column ``key``. Nothing but counts comes to the driver."""
        inside = space.table(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        n = inside.count()
        made = cls([])
        if not n:
            return made
        outside = universe.select("key").where("key IS NOT NULL").distinct().join(inside.hint("merge"), "key", "left_anti")
        outside = space.table(outside, "others")
        others = outside.count()
        while n:
            rate = RATE if made.levels else max(RATE, others / n)
            made.levels.append(cls._level(inside, n, rate, len(made.levels), space))
            passed = space.table(outside.where(made._passes(F.col("key"), len(made.levels) - 1)), "passed")
            space.drop(outside)
            inside, outside = passed, inside
            n = inside.count()
        space.drop(inside, outside)
        return made

    @staticmethod
    def _bit(key: Column, level: int, i: int, m: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(m).cast("long"))

    @classmethod
    def _level(cls, keys: DataFrame, n: int, rate: float, level: int, space: Workspace) -> tuple[int, int, DataFrame]:
        hashes = max(1, round(math.log2(rate)))
        m = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
        bits = keys.select(F.explode(F.array(*(cls._bit(F.col("key"), level, i, m) for i in range(hashes)))).alias("bit"))
        one = F.expr("shiftleft(1L, cast(bit % 64 AS INT))")
        words = bits.select((F.col("bit") / 64).cast("int").alias("w"), one.alias("v"))
        every = keys.sparkSession.range(m // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("v"))
        words = words.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
        row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))
        return m, hashes, space.table(row, "level")

    def _passes(self, key: Column, level: int) -> Column:
        m, hashes, table = self.levels[level]
        held = table.scalar()
        test = F.lit(True)
        for i in range(hashes):
            bit = self._bit(key, level, i, m)
            test = test & (F.getbit(F.get(held, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1)
        return test

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides. Not for use in a lambda, where
        scalars can't stand."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._passes(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """verdict and key (host/path/) of a list of rules; of several for one key, the last one holds."""
    held = json.dumps([{"verdict": v, "key": k} for k, v in {key: verdict for verdict, key in rules}.items()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(held), "array<struct<verdict:string,key:string>>")))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule and verdict.

    A rule (verdict, host/path/) fits its host and all subdomains where the path starts with the rule's; the longest
    wins. Pages that no rule fits have a null rule and are allowed, as no list names them. A null url, or one without
    ``://``, has an empty host and path, and fits no rule. Rules for the same key: the last of a list holds; a table of
    rules (verdict, key) must not repeat keys. Repeated pages come back as often as they went in; their other columns
    are not read. The universe is every key of every url that a rule of this depth could name.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "urlfilter")
    rules = space.table(rules.select("verdict", "key") if isinstance(rules, DataFrame) else rule_table(spark, rules), "rules")
    bad = rules.where("NOT coalesce(key LIKE '%/' AND key NOT LIKE '/%' AND verdict IN ('block', 'allow'), false)").limit(3).collect()
    if bad:
        raise ValueError(f"a rule is host/path/ with block or allow: {bad}")
    if (twice := rules.groupBy("key").count().where("count > 1").first()) is not None:
        raise ValueError(f"two rules for {twice['key']}")
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/")))
    shape = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.max(slashes).alias("depth")).first()
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("keys", url_keys(F.col("host"), F.col("path"), shape["labels"] or 1, shape["depth"] or 1))
    universe = space.table(parts.select(F.explode("keys").alias("key")).distinct(), "universe")
    many = (shape["labels"] or 1) * (shape["depth"] or 1)
    for verdict in ("block", "allow"):
        listed = rules.where(F.col("verdict") == verdict).select("key")
        groups = max(1, -(-listed.count() // MAX_LISTED))
        group = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(groups))  # noqa: B023, E731
        parts = parts.withColumn(verdict, F.lit(None).cast("string"))
        for g in range(groups):
            made = BloomCascade.build(listed.where(group("key") == g), universe.where(group("key") == g), space)
            keys = [F.get("keys", F.lit(i)) for i in range(many)]  # longest first
            found = F.coalesce(*(F.when(k.isNotNull() & (group(k) == g) & made.contains(k), k) for k in keys))
            longer = F.coalesce(F.length(found), F.lit(-1)) > F.coalesce(F.length(verdict), F.lit(-1))
            parts = parts.withColumn(verdict, F.when(longer, found).otherwise(F.col(verdict)) if g else found)
            if groups > 1:  # so that no plan holds the bits of two groups
                parts = space.table(parts, "judged")
    space.drop(universe)
    longest = F.when(
        F.coalesce(F.length("block"), F.lit(-1)) > F.coalesce(F.length("allow"), F.lit(-1)), F.col("block")
    ).otherwise(F.col("allow"))
    out = parts.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull() | (F.col("rule") != F.coalesce("block", F.lit(""))), "allow").otherwise("block")
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
