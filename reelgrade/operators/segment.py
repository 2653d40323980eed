"""Texts to scenes, lines and windows. All are arrays made in the row; ``posexplode`` numbers them without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scenes as S
from ..functions import text as X
from ..functions.values import ACTION_VERBS, EPISODE_WINDOW, EPISODE_WINDOWS, EPISODE_STRIDE, SCENE_STRIDE, SCENE_WINDOW

# Where the older rating's scenes open.
MARKERS = r"СЦЕНА\s*\d*\.|INT\.|EXT\.|ИНТ\.|ЭКСТ\."
MARKER_WORDS = "СЦЕНА|INT|EXT|ИНТ|ЭКСТ"


def has_action(text: Column, verbs=ACTION_VERBS) -> Column:
    return text.rlike(X.pattern(f"(?iu)<b>(?:{'|'.join(verbs)})<b>"))


def keep_scenes(parts: Column, verbs=ACTION_VERBS) -> Column:
    """Parts without outer white space that have five words, or three of which one is a verb of action."""
    kept = lambda p: X.has_words(p, 5) | (X.has_words(p, 3) & has_action(p, verbs))
    return F.filter(F.transform(parts, X.strip), kept)


def scenes(text: Column) -> Column:
    """The scenes of a script: split before each line that opens one."""
    return keep_scenes(F.split(F.coalesce(text, F.lit("")), X.LINES + S.splitter(), -1))


def older_scenes(text: Column) -> Column:
    """The diagnostic splitter: other openings, and five words at least."""
    parts = F.split(F.coalesce(text, F.lit("")), X.LINES + S.splitter(S.OLDER_OPENINGS), -1)
    return F.filter(F.transform(parts, X.strip), lambda p: X.word_count(p) >= 5)


def counted_headings(text: Column) -> Column:
    """The headings that the diagnostic counts, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(X.LINES + S.COUNTED_HEADING), F.lit(0))
    return F.transform(found, X.strip)


def first_of_script(text: Column, n: int = 10) -> Column:
    """What the diagnostic shows of a script: its first n headings, and the first n scenes of the older splitter."""
    return F.struct(F.slice(counted_headings(text), 1, n).alias("headings"), F.slice(older_scenes(text), 1, n).alias("scenes"))


def marker_scenes(text: Column) -> Column:
    """The older rating's scenes: they open at a marker anywhere, or at its word before any; four words at least."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?iU)({MARKERS})", "\u0001$1\u0002")
    parts = F.split(marked, f"\u0001|\u0002(?=(?iU:{MARKER_WORDS}))", -1)
    whole = F.transform(parts, lambda p: X.strip(F.translate(p, "\u0002", " ")))
    return F.filter(whole, lambda p: X.word_count(p) > 3)


def line_scenes(text: Column, verbs=ACTION_VERBS) -> Column:
    """The same filter over a text's lines."""
    return keep_scenes(F.split(F.coalesce(text, F.lit("")), "\n", -1), verbs)


def explode_scenes(scripts: DataFrame, parts: Column, id_col: str = "script_id", outer: bool = False) -> DataFrame:
    """One row per scene, numbered from 1 within its script. ``outer``: without scenes, one row without number and text."""
    each = F.posexplode_outer if outer else F.posexplode
    return scripts.select(id_col, each(parts).alias("pos", "text")).select(id_col, (F.col("pos") + 1).alias("scene_index"), "text")


def window_starts(n: Column, length: int = SCENE_WINDOW, stride: int = SCENE_STRIDE, most: int | None = None) -> Column:
    """Starts of windows over n tokens: 0, stride, ..., and one that ends with the last token. Up to ``length`` tokens: 0."""
    last = n - length
    starts = F.when(last > 0, F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))).otherwise(F.array(F.lit(0)))
    return starts if most is None else F.slice(starts, 1, most)


def token_windows(tokens: Column, length: int = SCENE_WINDOW, stride: int = SCENE_STRIDE, most: int | None = None) -> Column:
    """Structs (start, tokens)."""
    starts = window_starts(F.size(tokens), length, stride, most)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, F.lit(length)).alias("tokens")))


def episode_windows(tokens: Column) -> Column:
    return token_windows(tokens, EPISODE_WINDOW, EPISODE_STRIDE, EPISODE_WINDOWS)


def preview(text: Column, n: int) -> Column:
    return F.substring(X.squeeze(F.coalesce(text, F.lit(""))), 1, n)
