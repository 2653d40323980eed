"""Readers of scripts, lexicons and label tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import CATEGORIES
from ..operators import normalize as N

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that are none are dropped, and every line ends with \\n."""
    text = F.translate(F.make_valid_utf8(content.cast("string")), "�", "")
    return F.regexp_replace(text, "\r\n?", "\n")


def docx_paragraphs(blob: bytes) -> list[str]:
    """The texts of a document's own paragraphs, those in tables left out."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return out


def pdf_pages(blob: bytes, strict: bool = False) -> list[str]:
    """The pages' texts; needs the optional package pdfplumber on the executors. A page without text is empty, or, if
    ``strict``, an error, as for the older reader."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(blob)) as pdf:
        found = [page.extract_text() for page in pdf.pages]
    if strict and None in found:
        raise ValueError(f"page {found.index(None) + 1} has no text")
    return [text or "" for text in found]


def _lines_of(reader, **options):
    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: reader(bytes(b), **options))

    return run


def read_scripts(spark: SparkSession, path: str, clean: str = "rating", older: bool = False) -> DataFrame:
    """(script_id, text) of every file under ``path``: .docx, .pdf, and anything else as text.

    ``clean`` is what is done to DOCX texts: ``rating`` (marks and cast lines go), ``labels`` (label texts' cleanup,
    then headings) or ``none``. ``older``: suffixes in lower case only, and a PDF page without text fails. Each format is read by its own plan: text files never leave the JVM. A file without a single byte gives no row, as Spark's readers skip it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.col("path") if older else F.lower("path")
    docx, pdf = name.endswith(".docx"), name.endswith(".pdf")
    paragraphs = files.where(docx).withColumn("lines", _lines_of(docx_paragraphs)(F.col("content")))
    joined = N.clean_paragraphs(F.col("lines")) if clean == "rating" else F.array_join("lines", "\n")
    pages = files.where(pdf).withColumn("lines", _lines_of(pdf_pages, strict=older)(F.col("content")))
    whole = F.concat(F.array_join("lines", "\n"), F.when(F.size("lines") > 0, "\n").otherwise(""))
    parts = [
        files.where(~docx & ~pdf).select(F.col("path").alias("script_id"), decoded(F.col("content")).alias("text")),
        paragraphs.select(F.col("path").alias("script_id"), joined.alias("text")),
        pages.select(F.col("path").alias("script_id"), whole.alias("text")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if clean == "labels":
        out = out.withColumn("text", N.normalize_headings(N.clean_label_text(F.col("text"))))
    return out


def read_strict_text(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, text); a file that isn't UTF-8 fails the query."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("script_id"), F.regexp_replace(F.validate_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"))


def scene_from_text(spark: SparkSession, text: str) -> DataFrame:
    """A single scene given as text."""
    return spark.createDataFrame([("input", 1, text)], "script_id string, scene_index int, text string")


def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(category, ord, word, weight) from the files <category>.txt of a folder.

    A line is a word, or word:weight (1.0 without); blank lines and those that start with # don't count. A word that a
    file has twice appears twice, with its last weight. Files that are missing give no rows. Each file is read as one
    text, so that the order of its lines holds.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    category = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    lines = files.select(category.alias("category"), F.posexplode(F.split(decoded(F.col("content")), "\n")).alias("line", "raw"))
    lines = lines.where(F.col("category").isin(*CATEGORIES)).withColumn("raw", F.regexp_replace("raw", r"(?U)^\s+|\s+\z", ""))
    lines = lines.where("raw <> '' AND NOT startswith(raw, '#')")
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    word = trim(F.substring_index("raw", ":", 1))
    weight = F.when(F.contains("raw", F.lit(":")), trim(F.substring(F.col("raw"), F.instr("raw", ":") + 1, F.length("raw"))).cast("double")).otherwise(1.0)
    rows = lines.select("category", "line", word.alias("word"), weight.alias("weight"))
    last = rows.groupBy("category", "word").agg(F.max_by("weight", "line").alias("weight"))
    place = (F.expr("row_number() OVER (PARTITION BY category ORDER BY line)") - 1).alias("ord")
    return rows.select("category", "line", "word", place).join(last, ["category", "word"]).select("category", "ord", "word", "weight")


def lexicon_entries(lexicon: DataFrame) -> list[tuple[str, int, str, float]]:
    """A lexicon table for the lexicon operators. A lexicon is written by hand, and small."""
    order = {c: i for i, c in enumerate(CATEGORIES)}
    return sorted((tuple(r) for r in lexicon.select("category", "ord", "word", "weight").collect()), key=lambda r: (order[r[0]], r[1]))


LABELS_SCHEMA = "scene_no string, place_type string, location string, tod string, " + ", ".join(
    f"has_{c} int, sev_{c} string" for c in CATEGORIES
)
EPISODES_SCHEMA = (
    "text string, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", " + ", ".join(f"sev_{c} string" for c in CATEGORIES)
    + ", " + ", ".join(f"sev_{c}_num double" for c in CATEGORIES)
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A table of labels as CSV; doubled quotes inside quotes, and None as the word."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(LABELS_SCHEMA).csv(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(EPISODES_SCHEMA).csv(path)
    return rows.fillna("", ["text"])


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
