"""Normalisation of headings and extracted texts, as folds of ordered replacements.

A stage is (pattern, replacement), in Java's syntax with Python's meaning of the flags. Where letters must be raised,
one replacement for each word does it, as Java's replacements cannot call functions. The order is part of the meaning.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scenes as S
from ..functions import text as X

TYPES = "ИНТ|НАТ|INT|EXT"
TYPES_DOT = r"ИНТ\.|НАТ\.|INT\.|EXT\."
_B, _I, _M = X.BORDER, "(?iUd)", "(?iUdm)"
_W = f"(?<!{X.WORD})"  # the border before a letter
RAISED_TYPES = (("нат", "НАТ"), ("инт", "ИНТ"), ("nat", "NAT"), ("int", "INT"), ("ext", "EXT"))
RAISED_TIMES = "ДЕНЬ НОЧЬ ВЕЧЕР УТРО DAY NIGHT EVENING MORNING РЕЖИМ РАССВЕТ ЗАКАТ СУМЕРКИ".split()

# Dashes that are one, and marks that text extraction leaves.
DASHES = (("–", "-"), ("—", "-"), ("−", "-"))
MARKUP = (("{.smallcaps}", ""), ("{.underline}", ""))
BRACKETS = (("\\[", "["), ("\\]", "]"))
TRAILING_DOUBLE, TRAILING_SINGLE = r"(?Udm)[ \t]*\\\\\s*$", r"(?Udm)[ \t]*\\\s*$"

HEADINGS = (
    *((rf"{_M}^\s*{low}{_B}\.?", f"{high}.") for low, high in RAISED_TYPES),
    # Words are looked for behind the space or dot that ends them, which few characters are.
    (rf"{_M}\s(?<={_W}(?:{TYPES})\s)\s*", ". "),
    (rf"{_M}\.(?<={_W}(?:{TYPES_DOT}))\s*[-:]\s+", ". "),
    (rf"{_I}\.(?<={_W}(?:{TYPES_DOT}))([A-ZА-ЯЁ][^.\n]{{2,80}})\.(?=ДЕНЬ|НОЧЬ|ВЕЧЕР|УТРО|DAY|NIGHT|EVENING|MORNING{_B})", ". $1 - "),
    (rf"{_M}^(\d+\.\s*(?:{TYPES_DOT})\s+[^\n]{{2,120}}?)\.\s*({S.T8}){_B}", "$1 - $2"),
    (rf"{_M}^(\d+\.\s*{S.TYPE}\s*[A-ZА-ЯЁ]{{3,}})\.([A-ZА-ЯЁ]{{3,}})\s*\.\s*({S.T6_EN})", "$1 $2 - $3"),
    # At most 120 characters before a mark, matched lazily, end as the last two of them do: only these are looked at.
    (rf"{_M}([^-:\n]{{2}})\s*[:.]\s*-?\s*({S.T8_EN}){_B}", "$1 - $2"),
    (rf"{_M}\.(?<={_W}(?:{S.T8_EN})\.)\s*$", ""),
    (r"[ \t]{2,}", " "),
    (r"(?dm)[ \t]+$", ""),
    (r"(?U)\s*--+\s*", " - "),
    (r"\n{3,}", "\n\n"),
)

HEADING = (
    *((rf"{_I}{_B}{low}{_B}\.?", f"{high}.") for low, high in RAISED_TYPES),
    (rf"(?Ud){_B}({TYPES})(?!\.)\s+", "$1. "),
    (rf"(?Ud){_B}({TYPES_DOT})\s*([^\s\-])", "$1 $2"),
    (rf"(?Ud){_B}({TYPES_DOT})\s*[-:]\s*", "$1 "),
    (rf"(?Ud){_B}([A-ZА-ЯЁ]{{3,}})\.([A-ZА-ЯЁ][A-ZА-ЯЁ]{{2,}}){_B}", "$1. $2"),
    (rf"(?Ud){_B}({TYPES_DOT})\s*([A-ZА-ЯЁ]{{3,}})\.([A-ZА-ЯЁ]{{3,}})(?!\s*(?:ДЕНЬ|НОЧЬ|[-–—]))", "$1 $2. $3"),
    *((rf"{_I}{_B}{word}{_B}", word) for word in RAISED_TIMES),
    (rf"(?Ud)([^-:\n]{{2,120}}?)\s*:\s*-?\s*({S.T8}){S.ORDINAL}", "$1 - $2"),
    # The class is the range from \n to the colon, and the dot; kept as it is.
    (rf"(?Ud)([A-ZА-ЯЁ][^\n-:.]{{2,120}}?)\s{{2,}}({S.T7}){S.ORDINAL}(?!\s*[-.])", "$1 - $2"),
    (rf"(?Ud)([A-ZА-ЯЁ][^\n-]{{2,120}}?)\s+({S.T8}|ЗАКАТ|СУМЕРКИ){S.ORDINAL}(?!\s*-)", "$1 - $2"),
    (rf"(?Ud){_B}({S.T8_EN}){S.ORDINAL}\.", "$1"),
    (r"(?U)\s{2,}", " "),
    (r"(?U)^\s+|\s+\z", ""),
    (r"(?U)\s*--+\s*", " - "),
)

#: DOCX paragraphs, line by line, then the whole text.
PARAGRAPH = ((r"(?i)\{\.underline\}", ""), (r"\{\.smallcaps\}", ""), (r"\*\*(.*?)\*\*", "$1"), (r"(?Udm)\\\s*$", ""))
CAST_LINE = r"(?Udm)^\s*\[.*?\]\s*$"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode's composed form; Spark has no function for it."""
    return texts.str.normalize("NFC")


def replace_all(x: Column, stages: Iterable[tuple[str, str]]) -> Column:
    for regex, to in stages:
        x = F.regexp_replace(x, regex, to)
    return x


def replace_plain(x: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def composed(x: Column) -> Column:
    """NFC, where a text has characters beyond Latin-1 at all: everything else is composed as it is."""
    return F.when(x.rlike(r"[^\x00-ÿ]"), nfc(x)).otherwise(x)


def normalize_headings(text: Column, compose: bool = True) -> Column:
    """A whole script with its headings in one form."""
    x = composed(text) if compose else text
    x = replace_plain(x, DASHES)
    x = replace_all(x, ((TRAILING_DOUBLE, ""), (TRAILING_SINGLE, "")))
    x = replace_plain(x, MARKUP + BRACKETS)
    return replace_all(x, HEADINGS)


def normalize_heading(line: Column, compose: bool = True) -> Column:
    """One heading in its strict form."""
    x = composed(line) if compose else line
    x = replace_plain(x, DASHES + (("\\", ""),) + MARKUP)
    return replace_all(x, HEADING)


def clean_label_text(text: Column) -> Column:
    """Brackets, trailing backslashes and small capitals of texts with labels."""
    return replace_plain(clean_episode_text(text), MARKUP[:1])


def clean_episode_text(text: Column) -> Column:
    return F.regexp_replace(replace_plain(text, BRACKETS), TRAILING_DOUBLE, "")


def clean_paragraphs(paragraphs: Column) -> Column:
    """An array of DOCX paragraphs to the text that is rated: marks go, and lines that are only ``[...]``."""
    x = F.array_join(F.transform(paragraphs, lambda p: replace_all(F.coalesce(p, F.lit("")), PARAGRAPH)), "\n")
    x = replace_all(x, ((CAST_LINE, ""), (r"[ \t]+\n", "\n")))
    return F.regexp_replace(replace_plain(x, BRACKETS), TRAILING_DOUBLE, "")
