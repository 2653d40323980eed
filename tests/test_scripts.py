"""Documents as scripts: the whole report, and a cost that follows the text's length."""

import json
import time

import pytest
from pyspark.sql import functions as F

from reelgrade.functions import scenes as S
from reelgrade.functions import text as X
from reelgrade.operators import lexicon as L
from reelgrade.operators import normalize as N
from reelgrade.plans import tables


def test_reports_of_documents_hold_their_headings(spark, tmp_path):
    rows = [(7, "five words are in here\nand the five words of another one"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["script_id"]: r for r in tables.document_scripts(spark, str(tmp_path)).collect()}
    report = json.loads(got["7"]["report"])
    parts = [tuple(d[f] for f in ("scene_index", S.NO, S.PER, S.TYP, S.LOC, S.TOD)) for d in report["details"]]
    assert parts == [(1, "1-2", "", "INT.", "ROOM 7", "НОЧЬ"), (2, "", "", "EXT.", "YARD", "ДЕНЬ")]
    assert [d["per_class"]["violence"]["episodes_count"] for d in report["details"]] == [0, 2]
    assert (report["rating"], report["summary"]["count_scenes"]) == (got["7"]["rating"], got["7"]["count_scenes"]) and got["7"]["count_scenes"] == 2
    assert got["8"]["rating"] == "0+" and json.loads(got["8"]["report"])["details"] == []


def test_headings_cost_what_the_length_asks(spark):
    took = {}
    texts = spark.createDataFrame([("some words of a line without any mark that goes on and on " * 8000,)], "text string").repartition(1).cache()
    texts.count()
    for name, column in (("plain", X.squeeze(F.col("text"))), ("headings", N.normalize_headings(F.col("text")))):
        for _ in range(2):
            began = time.time()
            texts.select(column).write.format("noop").mode("overwrite").save()
            took[name] = time.time() - began
    assert took["headings"] < 12 * took["plain"]


@pytest.mark.parametrize(
    "text, made",
    [
        ("KITCHEN. DAY", "KITCHEN - DAY"), ("x" * 300 + " : - Night", "x" * 300 + " - Night"), ("a-b. DAY", "a-b. DAY"), ("-b . DAY", "-b - DAY"),
        ("aa. DAY. NIGHT", "aa - DAY. NIGHT"), ("aa. DAYS", "aa. DAYS"), ("int  ROOM", "INT. ROOM"), ("one INT\n\nROOM", "one INT. ROOM"), ("PRINT ROOM", "PRINT ROOM"),
        ("a INT. : ROOM", "a INT. ROOM"), ("a INT.ROOM.DAY", "a INT. ROOM - DAY"), ("in DAY. \nNIGHT.", "in DAY - NIGHT"), ("MIDDAY.", "MIDDAY."),
    ],
)
def test_headings_in_one_form(spark, text, made):
    assert spark.createDataFrame([(text,)], "t string").select(N.normalize_headings(F.col("t"))).first()[0] == made


def test_few_and_many_words_have_the_same_hits(spark):
    few = [("violence", 0, "the", 1.2), ("scary", 0, "is", 0.9), ("scary", 1, "is in", 0.9)]
    many = few + [("profanity", i, f"unseen{i}", 1.0) for i in range(L.FEW_WORDS)]
    row = spark.createDataFrame([("The other is in this: the isle is.",)], "t string").select(L.hits(F.col("t"), few).alias("a"), L.hits(F.col("t"), many).alias("b")).first()
    assert row["a"] == row["b"] and [(h["match"], h["offset"]) for h in row["a"]] == [("the", 0), ("the", 22), ("is", 10), ("is", 31), ("is in", 10)]


def test_words_are_counted_as_far_as_asked(spark):
    texts = ["", " ", "a", "a b", " a  b\u00a0c ", "a b c\nd e", "a b c d", "x" * 300_000, "\u2003a\u2003b c\td\x85e f "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(*(F.expr("true") & X.has_words(F.col("t"), n) == (X.word_count(F.col("t")) >= n) for n in (1, 3, 5))).collect()
    assert all(all(r) for r in got)
