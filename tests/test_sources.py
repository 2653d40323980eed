import zipfile

import pytest
from pyspark.sql import functions as F

from reelgrade.sources import scripts, sinks
from reelgrade.streaming import rating as S

DOCX = """<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:r><w:t>**ИНТ. ДОМ** - ДЕНЬ{.underline}\\</w:t></w:r></w:p><w:p><w:r><w:t>[А, Б]</w:t></w:r></w:p><w:p><w:r><w:t>\\[ep: v=mild\\]</w:t></w:r></w:p>
</w:body></w:document>"""


def test_scripts_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("слово\r\nдва".encode() + b"\xff!")
    with zipfile.ZipFile(tmp_path / "b.DOCX", "w") as z:
        z.writestr("word/document.xml", DOCX)
    got = {r["script_id"][-5:].lower(): r["text"] for r in scripts.read_scripts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "слово\nдва!"
    assert got[".docx"] == "ИНТ. ДОМ - ДЕНЬ\n\n[ep: v=mild]"


def test_pdf_pages(spark, tmp_path, monkeypatch):
    """A stand-in for the optional package, where workers find it too."""
    (tmp_path / "pdfplumber.py").write_text(
        "import contextlib\nclass Page:\n    def __init__(self, t): self.t = t\n    def extract_text(self): return self.t\n"
        "class Doc:\n    def __init__(self, b): self.pages = [Page(x or None) for x in b.read().decode().split('|')]\n"
        "@contextlib.contextmanager\ndef open(f): yield Doc(f)\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    assert scripts.pdf_pages(b"one||two") == ["one", "", "two"]
    with pytest.raises(ValueError):
        scripts.pdf_pages(b"one||two", strict=True)
    spark.sparkContext.addPyFile(str(tmp_path / "pdfplumber.py"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"one||two")
    assert scripts.read_scripts(spark, str(tmp_path / "in")).first()["text"] == "one\n\ntwo\n"
    assert scripts.read_scripts(spark, str(tmp_path / "in"), older=True).first()["text"] == "one||two"  # its suffixes are in lower case


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "violence.txt").write_text("# no\nнож:1.5\n\n труп \nнож:2\n", encoding="utf-8")
    (tmp_path / "other.txt").write_text("x\n")
    assert scripts.lexicon_entries(scripts.read_lexicon(spark, str(tmp_path))) == [
        ("violence", 0, "нож", 2.0), ("violence", 1, "труп", 1.0), ("violence", 2, "нож", 2.0)
    ]


def test_csv_quotes(spark, tmp_path):
    row = ("1", "ИНТ.", 'КАФЕ "РОЗА", ЗАЛ', "ДЕНЬ", *(0, "None") * 5)
    sinks.write_csv(spark.createDataFrame([row], scripts.LABELS_SCHEMA), str(tmp_path / "l"))
    assert tuple(scripts.read_labels(spark, str(tmp_path / "l")).first()) == row


def test_stream_of_scenes(spark, tmp_path):
    scenes = spark.createDataFrame([("a", "нож труп убил кровь"), ("a", "тихо")], "script_id string, text string")
    scenes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scenes.schema).parquet(str(tmp_path / "in"))
    q = S.rate_stream(stream).select("script_id", "scene_rating").writeStream.format("memory").queryName("rated").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["scene_rating"] for r in spark.table("rated").collect()) == ["16+", "6+"]


def test_rejects_by_reason(spark, tmp_path):
    sinks.write_rejects(spark.createDataFrame([("a", 1, "skipped", "x", "x")], "script_id string, scene_index int, reason string, line string, strict string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where(F.col("reason") == "skipped").count() == 1


def plain(value):
    return "" if value is None else repr(value + 0.0) if isinstance(value, float) else str(value)


def registered():
    from reelgrade.plans import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", registered())
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from reelgrade.plans import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    made = QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        for t in "part events documents embeddings labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = con.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in made.columns) for r in found.fetchall())
    assert sorted(names) == sorted(made.columns) and sorted(tuple(map(plain, r)) for r in made.collect()) == want
