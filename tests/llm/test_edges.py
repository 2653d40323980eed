"""Empty tables, repeated rows, null ids and very long texts, for the operators whose other tests lack them."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelgrade.llm import langid, neardup, packing, pieces, tokencount

LONG = "ab cd's 12 " * 150_000  # beyond one batch
ROWS = [(None, "a b c", "x"), (1, "x y z", "x"), (1, "x y z", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string").repartition(3)


def test_packed_rows(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = packing.pack_tokens(docs, path, pattern).collect()
    encoding = packing.token_ids(path, pattern, tokencount.character_classes()).encoding
    found = {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u4")
        for k, (doc, part) in enumerate(zip(r["doc_ids"], r["parts"], strict=True)):
            found.setdefault((doc, part), []).append(ids[slice(*r["cu_seqlens"][k : k + 2])].tolist())
    assert len(found[1, 0]) == 2 and found[None, 0] == [encoding.encode_ordinary("a b c")]
    assert [i for (doc, part), ids in sorted((k, v) for k, v in found.items() if k[0] == 4) for i in ids[0]] == encoding.encode_ordinary(LONG)
    assert {doc for doc, _ in found} == {None, 1, 4}
    assert packing.pack_tokens(docs.where("false"), path, pattern).count() == 0


def test_pieces_of_rows(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r["doc_id"] or 0), r["ids"], r["decoded"]) for r in pieces.encode_pieces(docs, path).collect())
    want = sorted((i or 0, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t, _ in ROWS)
    assert got == want
    assert pieces.piece_digests(pieces.encode_pieces(docs.where("false"), path)).count() == 0


def test_counts_of_long_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, library = tokencount.TokenCounter(path, tokencount.character_classes()), Tokenizer.from_file(path)
    texts = [LONG, "x" + "=" * 70_000 + " end", "ß" * 30_000 + "<|endoftext|>" + LONG[:1000], "日" * 20_000]
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_languages_of_long_texts(spark, docs):
    import pandas as pd

    model = langid.KneserNey.fit(pd.DataFrame([("aa", "ab", 3), ("aa", "cd", 2), ("bb", "s", 2)], columns=["lang", "word", "n"]))
    cost, size = model.costs([LONG, LONG[:11], "ab" * 700_000])
    assert np.allclose(cost[0], 150_000 * cost[1]) and size.tolist() == [150_000 * size[1], size[1], 1_400_001]
    got = langid.identify_languages(docs, model).collect()
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if r["doc_id"] == 4} == {"aa"}


def test_near_duplicates_of_long_texts(spark):
    rows = [(1, LONG, 1), (2, LONG + "and a few words more", 2), (3, "z" * 2_000_000, 3), (4, "z" * 2_000_000 + "y", 4), (None, LONG, 5)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component long")).collect()
    by = {r["doc_id"]: r for r in got}
    sets = {d: len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for d, w in ((d, t.split()) for d, t, _ in rows)}
    assert all(by[d]["n_shingles"] == n for d, n in sets.items()) and by[None]["component_id"] is None
    assert by[3]["component_id"] == 3 and by[4]["component_id"] == 4


def test_rows_with_other_columns_keep_their_meaning(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokencount.count_tokens(docs.withColumn("id", F.lit(9)).withColumn("n_bytes", F.lit("q")), path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.where("doc_id = 4").first()["n_bytes"] == len(LONG)
