"""Scene headings to their parts: the first parser that finds something wins, else a heuristic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scenes as S
from ..functions import text as X
from ..functions.values import PLACE_TYPES, TIMES_OF_DAY

FIELDS = (S.NO, S.PER, S.TYP, S.LOC, S.TOD)


def place_type(raw: Column) -> Column:
    """The canonical place type; an unknown one in capitals; nothing of nothing."""
    known = lambda x: X.mapped(X.strip(F.replace(F.lower(x), F.lit("."), F.lit(""))), PLACE_TYPES, F.upper(x))
    return X.let(F.coalesce(raw, F.lit("")), lambda x: F.when(x == "", "").otherwise(known(x)))


def time_of_day(raw: Column) -> Column:
    known = lambda x: X.mapped(X.strip(F.lower(x)), TIMES_OF_DAY, F.upper(x))
    return X.let(F.coalesce(raw, F.lit("")), lambda x: F.when(x == "", "").otherwise(known(x)))


def _header(**parts: Column) -> Column:
    return F.struct(*(parts.get(f, F.lit("")).alias(f) for f in FIELDS))


def _parsed(line: Column, regex: str, groups: tuple[str, ...]) -> Column:
    regex = X.ANY_CASE + regex
    got = {name: F.coalesce(F.regexp_extract(line, regex, i), F.lit("")) for i, name in enumerate(groups, 1)}
    clean = {S.TYP: place_type, S.TOD: time_of_day, S.LOC: lambda x: X.strip_chars(X.strip(x), ". ")}
    found = _header(**{name: clean.get(name, X.strip)(x) for name, x in got.items()})
    return F.when(line.rlike(regex), found)


def heuristic(line: Column, wide: bool = False) -> Column:
    """A number, a word of a type's letters and a time anywhere; what stands between type and time is the location.

    ``wide``: the label extraction's times, which need no word end.
    """
    times = X.ANY_CASE + X.pattern(S.ANY_TIME_WIDE if wide else S.ANY_TIME)
    number = X.strip(F.regexp_extract(line, X.pattern("(?Ud)" + S.ANY_NUMBER), 1))
    kind = place_type(F.regexp_extract(line, X.ANY_CASE + X.pattern(S.ANY_TYPE), 1))
    tod = time_of_day(F.regexp_extract(line, times, 1))
    q = lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))

    def located(found: Column) -> Column:
        kind, tod = found["kind"], found["tod"]
        between = F.concat(F.lit("(?iUd)"), q(kind), F.lit(r"\s*(.+?)\s*[-–—:]\s*"), q(tod))
        before = F.concat(F.lit(r"(?iUd)(.+?)\s*[-–—:]\s*"), q(tod))
        regex = F.when(kind != "", between).otherwise(before)
        place = F.when(tod == "", "").otherwise(F.call_function("regexp_extract", line, regex, F.lit(1)))
        return _header(scene_no=found["number"], place_type=kind, location=X.strip_chars(X.strip(place), "."), tod=tod)

    return X.let(F.struct(number.alias("number"), kind.alias("kind"), tod.alias("tod")), located)


def parse_header(text: Column, wide: bool = False) -> Column:
    """struct(scene_no, period, place_type, location, tod) of the text's first line; what is missing is empty, never null."""
    parsed = lambda line: F.coalesce(*(_parsed(line, regex, groups) for regex, groups in S.PARSERS), heuristic(line, wide))
    return X.let(X.first_line(F.coalesce(text, F.lit(""))), parsed)


def is_empty(header: Column) -> Column:
    return (header[S.NO] == "") & (header[S.TYP] == "") & (header[S.LOC] == "") & (header[S.TOD] == "")
