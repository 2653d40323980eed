"""String expressions with Python's meaning of white space, words and borders, in Java's pattern language."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
BORDER = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: Ignore case, Unicode classes, \n alone ends a line, ^ and $ at lines.
LINES = "(?iUdm)"
#: The same for a single line's text.
ANY_CASE = "(?iUd)"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pattern(p: str) -> str:
    """Fill in <b> (word border) and <w> (word character)."""
    if starts(p):  # between word characters, a border is what no word character stands next to
        p = f"(?<!{WORD}){p[3:-3]}(?!{WORD})"
    return p.replace("<b>", BORDER).replace("<w>", WORD)


def starts(p: str) -> list[str]:
    """Of a pattern that is a word, or a group of words and phrases, between borders: the first word of each; else none."""
    m = re.fullmatch(r"<b>(?:(\w+)|\(([\w <>+|]+)\)(?:<w>[+*])?)<b>", p)
    each = [m[1]] if m and m[1] else re.sub(r"<w>\+", "", m[2]).split("|") if m else []
    return [x.split()[0] for x in each] if all(re.fullmatch(r"\w+(?: \w+)*", x) for x in each) else []


def quoted(word: str) -> str:
    return word if word.isalnum() else "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_word(word: str) -> str:
    """The pattern of a literal between word borders; it begins with the literal, which is found fast."""
    inside = lambda c: c.isalnum() or c == "_"
    before = "!" if inside(word[:1]) else "="
    after = "!" if inside(word[-1:]) else "="
    return f"{quoted(word)}(?<{before}{WORD}{quoted(word)})(?{after}{WORD})"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def strip_chars(x: Column, chars: str) -> Column:
    return F.regexp_replace(x, f"^[{chars}]+|[{chars}]+\\z", "")


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def has_words(x: Column, n: int) -> Column:
    """Whether there are n words or more; what follows the n-th one's first character isn't read."""
    return x.rlike(rf"(?U)\A\s*+(?:\S++\s++){{{n - 1}}}\S")


def squeeze(x: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def first_line(x: Column) -> Column:
    """The text up to its first line end."""
    return F.regexp_extract(x, r"^[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*", 0)


def title_case(x: Column) -> Column:
    """Capitals after whatever isn't a letter, lower case elsewhere."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def mapped(x: Column, table: dict[str, str], otherwise: Column) -> Column:
    """A lookup in a small fixed table."""
    literal = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.try_element_at(literal, x), otherwise)


def match_offsets(x: Column, regex: Column, width: Column) -> Column:
    """0-based offsets of the matches of a pattern whose matches all have ``width`` characters.

    The text is split at the matches; a match begins where the parts before it, and the matches between them, end.
    """
    parts = F.split(x, regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p) + width).alias("at"), F.array_append(s["found"], s["at"] + F.length(p)).alias("found")
    )
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda s: s["found"])


def around(x: Column, start: Column, end: Column, radius: int) -> Column:
    """Characters from ``start`` - radius to ``end`` + radius (0-based, end exclusive)."""
    low = F.greatest(start - radius, F.lit(0))
    return F.substring(x, low + 1, end + radius - low)
