"""Lexicon hits, scores and counts. A text is scanned in its own row: no join, no shuffle.

The words of a text are intersected with the lexicon first (unless that has few); only words that occur are looked for by
pattern, so the cost of a large lexicon is one hash lookup for each word.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ratings import rule_score
from ..functions.values import CATEGORIES, HIT_CONTEXT, LEXICON, OVERRIDE_AGE, OVERRIDES, PRESENCE_WORDS, SCORED_CHARS

Entry = tuple[str, int, str, float]
#: So many words are each looked for in a text; of more, those are that are among the text's words.
FEW_WORDS = 16


def entries(lexicon: dict[str, Iterable[tuple[str, float]]] | None = None) -> list[Entry]:
    """(category, ord, word, weight). A word that a category lists twice is kept twice, with its last weight."""
    out = []
    for category, words in (lexicon or LEXICON).items():
        last = dict(words)
        out += [(category, i, w, float(last[w])) for i, (w, _) in enumerate(words)]
    return out


def _occurring(low: Column, lexicon: list[Entry]) -> Column:
    """The entries that may occur in a lower-cased text, as structs, in the lexicon's order."""
    if not lexicon:
        return F.array().cast("array<struct<category:string,ord:int,word:string,weight:double,width:int,regex:string>>")
    one = lambda w: all(c.isalnum() or c == "_" for c in w)
    known = F.array(
        *(
            F.struct(
                F.lit(c).alias("category"), F.lit(i).alias("ord"), F.lit(w).alias("word"), F.lit(x).alias("weight"),
                F.lit(len(w)).alias("width"), F.lit(X.whole_word(w)).alias("regex"),
            )
            for c, i, w, x in lexicon
        )
    )
    if len({w for _, _, w, _ in lexicon}) <= FEW_WORDS:  # inside other words too, which the patterns tell
        return F.filter(known, lambda e: F.contains(low, e["word"]))
    single, phrases = sorted({w for _, _, w, _ in lexicon if one(w)}), sorted({w for _, _, w, _ in lexicon if not one(w)})
    found = F.array_intersect(F.array(*map(F.lit, single)).cast("array<string>"), F.split(low, r"[^\p{L}\p{N}_]+"))
    there = F.filter(F.array(*map(F.lit, phrases)).cast("array<string>"), lambda w: F.contains(low, w))
    present = F.concat(found, there) if phrases else found
    return F.filter(known, lambda e: F.array_contains(present, e["word"]))


def hits(text: Column, lexicon: list[Entry] | None = None, limit: int = SCORED_CHARS) -> Column:
    """An array of structs (category, ord, offset, match, weight, snippet), by category, then ord, then offset.

    Whole words of the lower-cased text's first ``limit`` characters (a word cut there counts as what is left of it);
    the lexicon's own words are taken as they are. A null text has no hits.
    """
    lexicon = lexicon if lexicon is not None else entries()

    def of(t: Column, e: Column) -> Column:
        return F.transform(
            X.match_offsets(t["low"], e["regex"], e["width"]),
            lambda o: F.struct(
                e["category"].alias("category"), e["ord"].alias("ord"), o.alias("offset"), e["word"].alias("match"), e["weight"].alias("weight"),
                F.translate(X.around(t["cut"], o, o + e["width"], HIT_CONTEXT), "\n", " ").alias("snippet"),
            ),
        )

    cut = F.substring(F.coalesce(text, F.lit("")), 1, limit)
    both = F.struct(cut.alias("cut"), F.lower(cut).alias("low"))
    return X.let(both, lambda t: F.flatten(F.transform(_occurring(t["low"], lexicon), lambda e: of(t, e))))


def of_category(found: Column, category: str) -> Column:
    return F.filter(found, lambda h: h["category"] == category)


def total_weight(found: Column, category: str) -> Column:
    return F.aggregate(of_category(found, category), F.lit(0.0), lambda s, h: s + h["weight"])


def scores(found: Column) -> dict[str, Column]:
    """The rule score of each category from a text's hits."""
    return {c: rule_score(total_weight(found, c)) for c in CATEGORIES}


def counts(text: Column, lexicon: list[Entry] | None = None) -> Column:
    """Hits in the whole text, unweighted: an array in the order of the categories."""
    lexicon = lexicon if lexicon is not None else entries()

    def found(low: Column) -> Column:
        return F.transform(
            _occurring(low, lexicon), lambda e: F.struct(e["category"].alias("c"), (F.size(F.split(low, e["regex"], -1)) - 1).alias("n"))
        )

    each = X.let(F.lower(F.coalesce(text, F.lit(""))), found)
    of = lambda rows, c: F.aggregate(F.filter(rows, lambda x: x["c"] == c), F.lit(0), lambda s, x: s + x["n"])
    return X.let(each, lambda rows: F.array(*(of(rows, c) for c in CATEGORIES)))


def presence(text: Column, words: dict[str, Iterable[str]] | None = None) -> dict[str, Column]:
    """How many different words of each category stand anywhere in the lower-cased text, inside others too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = {}
    for category, own in (words or PRESENCE_WORDS).items():
        out[category] = sum((F.contains(low, F.lit(w)).cast("long") for w in own), F.lit(0).cast("long"))
    return out


def presence_severity(n: Column) -> Column:
    return F.when(n == 0, "None").when(n == 1, "Mild").when(n <= 3, "Moderate").otherwise("Severe")


def any_match(low: Column, patterns: Iterable[str]) -> Column:
    """Whether a lower-cased text has a match of any pattern."""
    out = F.lit(False)
    for p in patterns:
        found = low.rlike(X.pattern(p))
        if words := X.starts(p):  # most texts have none of them, which is seen without the pattern
            found = functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words)) & found
        out = out | found
    return out


def legal_override(text: Column, rules=OVERRIDES, age: str = OVERRIDE_AGE) -> Column:
    """struct(min_age, reasons) of the first rule set that has a match; null if none has."""

    def judge(low: Column) -> Column:
        out = F.lit(None).cast("struct<min_age:string,reasons:array<string>>")
        for reason, patterns in reversed(list(rules)):
            found = F.struct(F.lit(age).alias("min_age"), F.array(F.lit(reason)).alias("reasons"))
            out = F.when(any_match(low, patterns), found).otherwise(out)
        return out

    return X.let(F.lower(F.coalesce(text, F.lit(""))), judge)
