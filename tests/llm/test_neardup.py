"""Near duplicates against brute force over all pairs, and the pipeline's stages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from reelgrade.llm import components, hashing, neardup
from reelgrade.llm.store import Workspace


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return [(d, len(s), None if d is None else names[find(i)], d is None or d == names[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def documents():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 90, 200])))) for i in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(40))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(20)) + " " + shared) for i in range(40)]  # alike, but not enough
    hub = [rng.choice(words) for _ in range(120)]
    for i in range(60):  # copies near the middle one, less near each other
        copy = list(hub)
        for _ in range(3):
            copy[rng.randrange(120)] = f"x{i}{rng.random()}"
        docs.append((300 - i, " ".join(copy)))
    docs.append((270_000, " ".join(hub)))
    docs += [(400, docs[5][1].upper()), (401, "  " + docs[6][1] + "\t"), (402, None), (403, ""), (404, " \n"), (5, docs[5][1]), (5, docs[7][1]), (None, docs[8][1]), (None, None)]
    docs += [(500 + i, docs[20][1]) for i in range(30)]
    docs += [(600 + i, w) for i, w in enumerate(complementary(1024, "q", "e"))]
    return docs


def test_components_against_all_pairs(spark):
    docs = documents()
    rows = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, bucket string").repartition(6)
    got = neardup.near_duplicates(rows).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_components(docs)))


def near_copies(n):
    """Sets of n texts that all differ from one text, and so from each other, in a few words."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    return [np.unique(np.concatenate((np.delete(base, rng.choice(150, 8, replace=False)), rng.integers(0, 2**63, 8).astype(np.uint64)))) for _ in range(n)]


def test_pairs_of_a_group_of_near_copies(spark):
    """The first stars of a group propose a few pairs a member, however large it is and however many buckets it shares."""
    of = {}
    for n in (150, 600):
        rows = [(int(k), i) for i, s in enumerate(near_copies(n)) for k in neardup.band_keys(s).view(np.int64)]
        members = neardup._centered(spark.createDataFrame(rows, "bucket long, node long"))
        of[n] = neardup._ordered(members, "node", "center").count()
        assert members.select("node").distinct().count() == n
    assert of[150] <= 8 * 150 and of[600] <= 8 * 600


def test_workers_keep_nothing_after_their_batches():
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["one two three four five six", None])], names=["id", "text"])
    for over in (neardup._features(iter([batch])), neardup._sets(iter([batch.select(["text"])]))):
        next(over)
        assert hashing._words and hashing._holder
        assert not list(over) and not hashing._words and not hashing._holder


def test_no_documents(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["kept"]


def complementary(n, a, b):
    """Two different strings of n = 2**k letters with one polynomial hash modulo 2**64, whatever its odd base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_a_polynomial_hash_confuses():
    for n in (1024, 2048):
        one, two = (hashing.word_hashes(w.encode())[0] for w in complementary(n, "q", "e"))
        assert one != two
    text = b" ".join(f"word{i % 97}".encode() * (1 + i % 9) for i in range(4000))
    by = dict(zip(text.split(), hashing.word_hashes(text).tolist(), strict=True))
    assert len(set(by.values())) == len(by) and [by[w] for w in text.split()] == hashing.word_hashes(text).tolist()


def test_equal_hashes_do_not_make_pieces_equal():
    words = ["ab", "cd", "ab", "ef", "x" * (hashing.COMPARED + 3), "x" * (hashing.COMPARED + 2) + "y", "cd", "x" * (hashing.COMPARED + 3)]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    stop = np.cumsum([len(w) for w in words])
    start = stop - [len(w) for w in words]
    for hashed in (np.zeros(8, np.uint64), np.array([1, 1, 1, 2, 3, 3, 2, 3], np.uint64), np.arange(8, dtype=np.uint64)):
        first, kind = hashing.distinct(points, start, stop, hashed)
        assert [words[first[k]] for k in kind] == words


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 20, 300):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**63, n * 5 // 4 + 1).astype(np.uint64)
            a, b = np.unique(pool[: n + n // 8]), np.unique(pool[len(pool) - n - n // 8 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((neardup.signature(a) == neardup.signature(b)).mean() - true)
        assert abs(np.mean(agree)) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges, Workspace(spark, "test")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.connected_components(edges.where("false"), Workspace(spark, "test")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    say = "the cat and the other thing with that one over there "
    texts = [f"{say * 3}number {i} is {i * 7} of all {'and more ' * (i % 4)}" for i in range(40)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[3]), (51, f"{say * 3}{say * 2}with {item} and that"), (52, "123"), (53, None), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"language": F.lit("x"), "nth": F.lit(7), "Key": F.lit("k")})  # names that the stages might use
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    read = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, read, str(tmp_path))
        assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name))
    left = {name: sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / name)).collect()) for name, _ in corpus_pipeline.STAGES[:-1]}
    assert {52, 53}.isdisjoint(left["language_id"]) and 51 in left["language_id"]
    want = [d for d, _, _, kept in brute_components([r for r in rows if r[0] not in (52, 53)]) if kept]
    assert left["near_dedup"] == sorted(set(want))
    assert left["decontaminate"] == [d for d in left["near_dedup"] if d != 51]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == left["decontaminate"]
