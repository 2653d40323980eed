"""Inline annotations: ``[ep: k=v, ...]`` and ``[Labels: k=v, ...]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import (
    CATEGORIES, EPISODE_CONTEXT, LABEL_CATEGORIES, QUOTE_CHARS, SEVERITY_NUMBER, SEVERITY_WORDS, SHORT_CATEGORIES, UNKNOWN_SEVERITY_NUMBER,
)

EPISODE = r"(?iU)\[\s*ep\s*:\s*([^\]]+)\]"
LABELS = r"(?iU)\[\s*(?:Labels|МЕТКИ)\s*:\s*([^\]]+)\]"
_PAIRS = "array<struct<k:string,v:string>>"


def fields(payload: Column) -> Column:
    """The payload's pairs in order as structs (k in lower case, v); parts without ``=`` don't count."""
    parts = F.filter(F.transform(F.split(F.coalesce(payload, F.lit("")), ",", -1), X.strip), lambda p: F.contains(p, F.lit("=")))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.lower(X.strip(F.substring_index(p, "=", 1))).alias("k"), X.strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")
        ),
    ).cast(_PAIRS)


def value_of(pairs: Column, key: str) -> Column:
    """The last value of a key; null if it isn't there."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]


def severity_number(word: Column) -> Column:
    return X.mapped(X.title_case(word), {k: str(v) for k, v in SEVERITY_NUMBER.items()}, F.lit(str(UNKNOWN_SEVERITY_NUMBER))).cast("double")


def severity_word(word: Column, otherwise: Column) -> Column:
    return X.mapped(F.lower(word), SEVERITY_WORDS, otherwise)


def category_of(word: Column, names: dict[str, str] = SHORT_CATEGORIES) -> Column:
    return X.mapped(F.lower(word), names, F.lower(word))


def episode_payloads(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EPISODE), F.lit(1))


def _found(pairs: Column, category: str) -> Column:
    """A tag's severity numbers for a category, by short key and by ``cat=``; null where it doesn't name it."""
    short = value_of(pairs, next(k for k, c in SHORT_CATEGORIES.items() if c == category))
    named = category_of(value_of(pairs, "cat")) == category
    return F.array(
        F.when(short.isNotNull(), severity_number(short)),
        F.when(named, severity_number(F.coalesce(value_of(pairs, "sev"), F.lit("Moderate")))),
    )


def episode_features(text: Column) -> Column:
    """Ten numbers: the largest severity of each category in a text's tags, then how often each is named.

    A tag that names a category by its short key and by ``cat=`` counts twice.
    """
    def both(tags: Column) -> Column:
        return F.array(*(X.let(_category_values(tags, c), lambda v: F.struct(F.coalesce(F.array_max(v), F.lit(0.0)).alias("m"), F.size(v).cast("double").alias("n"))) for c in CATEGORIES))

    each = X.let(F.transform(episode_payloads(text), fields), both)
    return X.let(each, lambda e: F.concat(F.transform(e, lambda x: x["m"]), F.transform(e, lambda x: x["n"])))


def _category_values(tags: Column, category: str) -> Column:
    return F.filter(F.flatten(F.transform(tags, lambda t: _found(t, category))), lambda v: v.isNotNull())


def _contexts(text: Column, radius: int) -> Column:
    """For each tag of a text, the characters up to ``radius`` before and after its start.

    The text is cut at the tags. As a tag has six characters at least, the characters near it stand in a bounded number
    of pieces next to it, of which the ends suffice: the cost is linear in the number of tags.
    """
    near = radius // 6 + 2

    def found(t: Column) -> Column:
        parts, tags = t["parts"], t["tags"]
        n = F.size(tags)
        whole = F.zip_with(F.slice(parts, F.lit(1), n), tags, lambda p, m: F.concat(p, m))
        rest = F.concat(whole, F.slice(parts, n + 1, F.lit(1)))
        ends = F.transform(whole, lambda x: F.right(x, F.lit(radius)))
        begins = F.transform(rest, lambda x: F.left(x, F.lit(radius)))

        def one(m: Column, i: Column) -> Column:
            low = F.greatest(i - near, F.lit(0))
            before = F.concat(F.array_join(F.slice(ends, low + 1, i - low), ""), F.get(parts, i))
            after = F.concat(m, F.array_join(F.slice(begins, i + 2, F.lit(near)), ""))
            return F.concat(F.right(before, F.lit(radius)), F.left(after, F.lit(radius)))

        return F.transform(tags, one)

    cut = F.struct(F.split(text, EPISODE, -1).alias("parts"), F.regexp_extract_all(text, F.lit(EPISODE), F.lit(0)).alias("tags"))
    return X.let(cut, found)


def episode_rows(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per tag: id, tag (from 0), text (the characters around it), a flag, a severity and its number by category.

    ``cat=`` overrules the short key. A severity that no table knows has a null number.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tags = F.arrays_zip(_contexts(text, EPISODE_CONTEXT).alias("near"), episode_payloads(text).alias("payload"))
    rows = texts.select(F.col(id_col), F.posexplode(tags).alias("tag", "t"))
    rows = rows.select(id_col, "tag", X.strip(F.col("t.near")).alias("text"), fields(F.col("t.payload")).alias("f"))
    pairs = F.col("f")
    flags, words = {}, {}
    for short, c in SHORT_CATEGORIES.items():
        own, cat = value_of(pairs, short), value_of(pairs, "cat")
        sev = F.coalesce(value_of(pairs, "sev"), F.lit("Moderate"))
        named = F.coalesce(category_of(cat) == c, F.lit(False))
        words[c] = F.when(named, severity_word(sev, X.title_case(sev))).when(own.isNotNull(), severity_word(own, X.title_case(own))).otherwise("None")
        flags[c] = (named | own.isNotNull()).cast("int")
    number = lambda x: X.mapped(x, {k: str(v) for k, v in SEVERITY_NUMBER.items()}, F.lit(None).cast("string")).cast("double")
    return rows.select(
        id_col, "tag",
        "text",
        *(flags[c].alias(c) for c in CATEGORIES),
        *(words[c].alias(f"sev_{c}") for c in CATEGORIES),
        *(number(words[c]).alias(f"sev_{c}_num") for c in CATEGORIES),
    )


def label_severities(text: Column) -> Column:
    """struct of the five severities that a text's first label tag gives; an unknown word stays, what isn't named is None."""
    pairs = F.transform(
        fields(F.regexp_extract(F.coalesce(text, F.lit("")), LABELS, 1)),
        lambda p: F.struct(category_of(p["k"], LABEL_CATEGORIES).alias("k"), severity_word(p["v"], p["v"]).alias("v")),
    )
    return F.struct(*(F.coalesce(value_of(pairs, c), F.lit("None")).alias(c) for c in CATEGORIES))


def has_flag(severity: Column) -> Column:
    return (severity != "None").cast("int")


def quote_offset(text: Column, quote: Column, otherwise: Column) -> Column:
    """Where an annotator's quote begins (by its first characters); without a quote or a hit, the given number."""
    at = F.instr(text, F.substring(quote, 1, QUOTE_CHARS))
    return F.coalesce(F.when((quote != "") & (at > 0), at - 1), otherwise)
