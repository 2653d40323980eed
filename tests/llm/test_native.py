"""The operators that are built-in functions only, against brute force, and the cases that each must bear."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelgrade.llm import decontam, sharding, urlfilter

DOCS = "doc_id long, text string, shard string, n int"  # columns with names that operators use themselves


def test_shards_are_gapless_and_consistent(spark):
    rows = [(i, f"text {i % 7}" if i % 5 else None, "x", 1) for i in range(500)] + [(3, "text 3", "x", 1)] * 40 + [(None, "", "x", 1), (None, None, "x", 1)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).repartition(5), 16).collect()
    assert len(got) == len(rows)
    slots: dict[int, list[int]] = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 3}) == 1
    sample = next(r for r in got if r["doc_id"] == 1)
    assert (sample["size"], sample["text_crc32"]) == (7, zlib.crc32(b"text 1"))
    assert next(r for r in got if r["doc_id"] == 0)["size"] == 1


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_jump_hash_grows_by_the_new_shard_only(spark, n):
    rows = spark.range(2000).select(sharding.jump_shard(F.col("id"), n).alias("a"), sharding.jump_shard(F.col("id"), n + 1).alias("b")).collect()
    assert all(r["b"] in (r["a"], n) for r in rows)
    moved = sum(r["b"] != r["a"] for r in rows)
    assert abs(moved - 2000 / (n + 1)) < 6 * (2000 / (n + 1)) ** 0.5 + 2


def test_shards_of_nothing(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_contamination(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = []
    for i, t in items:
        w = low(t)
        windows += [(str(i), w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for i, win in windows:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_against_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["a", "b", "c", "É", "é", "日", "x1", "The"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([12, 12, 25, 10, 3, 2, 1, 9])] + [(8, "one two three"), (9, ""), (10, None), (3, say(14)), (None, "Zz yy xx")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)] + [
        (100, f"pre {items[2][1]} post".upper()), (101, items[0][1] + "," + items[0][1]), (102, None), (103, ""), (104, "!?"), (None, "zz YY xx"), (101, "one-two three one two, three"),
    ]
    got = decontam.find_contamination(
        spark.createDataFrame([(d, t, "q", 1) for d, t in docs], "doc_id long, text string, words string, row int"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    ).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    want = brute_contamination(docs, [("" if i is None else i, t) for i, t in items])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_contamination_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontam.find_contamination(docs, items).collect()] == [False]
    assert decontam.find_contamination(docs.where("false"), items).count() == 0


def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = {
        "http://A.Example.NET/en/x?y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/fr": ("example.net", "/fr", "net/", "block"),
        "https://example.net": ("example.net", "", None, "allow"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://m.example.com/de/?a#b": ("m.example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/den": ("example.com", "/den", None, "allow"),
        "https://x.org/fr//y": ("x.org", "/fr//y", "org/fr/", "allow"),
        "mailto:x": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "https://net/": ("net", "/", "net/", "block"), "a://b://net/": ("b:", "//net/", None, "allow"),
    }
    rows = [(i, u, "k") for i, u in enumerate(urls)] * 2
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, keys string"), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(urls.values())[r["page_id"]]
    with pytest.raises(ValueError):
        urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, keys string"), [("block", "net")])


def brute_url(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [k for k in rules if host and (host == k.split("/", 1)[0] or host.endswith("." + k.split("/", 1)[0])) and path.startswith("/" + k.split("/", 1)[1])]
    best = max(fits, key=len, default=None)
    return host, path, best, rules.get(best, "allow")


def test_url_rules_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "ba.com", "com", "é.org", "A.org", "org", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/de//", "/en/x/?q", "/#/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "x", "://a.com/en/", "a\nb://a.com/"]
    rules = {k: rng.choice(["block", "allow"]) for k in ["a.com/", "b.a.com/en/", "com/en/x/", "org/", "org/de//", "ba.com/en/", "é.org/"]}
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (urlfilter.MAX_LISTED, 2):  # the second: lists dealt to several cascades
        monkeypatch.setattr(urlfilter, "MAX_LISTED", most)
        for r in urlfilter.judge_urls(rows, [(v, k) for k, v in rules.items()]).collect():
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_url(urls[r["page_id"]], rules)
    assert urlfilter.judge_urls(rows.where("false"), [("block", "a.com/")]).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(rows, []).collect()} == {"allow"}


def test_a_long_list_of_rules(spark):
    rules = spark.range(100_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".com/")).alias("key"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), F.col("id") * 67, F.lit(".com/x")).alias("url"))
    got = urlfilter.judge_urls(pages, rules).collect()
    assert len(got) == 3000 and all((r["verdict"] == "block") == (r["page_id"] * 67 < 100_000) for r in got)


@pytest.mark.parametrize(("size", "share"), [(20_000, 9), (200_000, 4001)])
def test_cascade_is_exact_over_its_universe(spark, size, share):
    from reelgrade.llm.store import Workspace

    universe = spark.range(size).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(f"crc32(key) % {share} = 0")
    made = urlfilter.BloomCascade.build(listed, universe, Workspace(spark, "test"))
    n = listed.count()
    assert len(made.levels) > 1 and sum(m for m, _, _ in made.levels[1:]) <= 16 * n + 64 * len(made.levels)
    wrong = universe.where(made.contains(F.col("key")) != F.expr(f"crc32(key) % {share} = 0"))
    assert wrong.count() == 0


def jump(key_draws, shards):
    """The algorithm itself: jumps ahead until the next bucket lies beyond the last shard."""
    b, j, i = -1, 0, 0
    while j < shards:
        b = j
        j = int((b + 1) * (float(1 << 31) / float(key_draws[i] + 1)))
        i += 1
    return b


def test_shards_against_the_plain_algorithm(spark):
    draws = spark.range(400).select("id", F.array(*(F.shiftrightunsigned(F.xxhash64("id", F.lit(i)), 33) for i in range(1, 65))).alias("d"))
    for n in (1, 5, 16, 17, 64):
        got = draws.select("d", sharding.jump_shard(F.col("id"), n).alias("s")).collect()
        assert all(r["s"] == jump(r["d"], n) for r in got)


def test_benchmarks_beyond_a_pass(spark, monkeypatch):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 9, 14, 25]))) for i in range(30)]
    docs = [(i, say(30) + " " + (items[i % 30][1] if i % 3 else "") + " " + say(5)) for i in range(60)]
    monkeypatch.setattr(decontam, "SENT_SHINGLES", 40)
    monkeypatch.setattr(decontam, "SENT_WINDOWS", 30)
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute_contamination(docs, items))
