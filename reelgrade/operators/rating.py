"""Scenes to ratings, scripts to reports. A scene is rated in its own row; a script costs one shuffle of small rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions.values import AGES, CATEGORIES, LEGAL_CHARS, OVERRIDES, PRESENCE_WORDS, PROBLEM_HITS, SEVERITIES
from . import lexicon as L
from .headers import FIELDS, parse_header


def rate_scenes(
    scenes: DataFrame, text_col: str = "text", lexicon: list[L.Entry] | None = None, overrides=OVERRIDES,
    episode: dict[str, Column] | None = None, model: dict[str, Column] | None = None,
) -> DataFrame:
    """``scenes`` with hits, by category rule_, model_, episode_, final_ and rank_ columns, base_rank, override and age_rank.

    ``episode`` and ``model``: columns of probabilities by category. Without a model, the fusion leaves it out.
    """
    out = scenes.withColumn("hits", L.hits(F.col(text_col), lexicon))
    out = out.withColumns({f"rule_{c}": v for c, v in L.scores(F.col("hits")).items()})
    zero = F.lit(0.0)
    out = out.withColumns({f"episode_{c}": (episode or {}).get(c, zero) for c in CATEGORIES} | {f"model_{c}": (model or {}).get(c, zero) for c in CATEGORIES})
    final = {c: R.fused(F.col(f"rule_{c}"), F.col(f"episode_{c}"), F.col(f"model_{c}") if model else None) for c in CATEGORIES}
    out = out.withColumns({f"final_{c}": v for c, v in final.items()})
    out = out.withColumns({f"rank_{c}": R.severity_rank(F.col(f"final_{c}")) for c in CATEGORIES})
    out = out.withColumns({
        "base_rank": R.scene_age_rank({c: F.col(f"rank_{c}") for c in CATEGORIES}),
        "override": L.legal_override(F.col(text_col), overrides),
    })
    return out.withColumn("age_rank", F.greatest("base_rank", F.coalesce(R.age_rank(F.col("override.min_age")), F.lit(0))))


def problems(text: Column) -> Column:
    """Of a rated scene: the first hits of categories that are Moderate or worse, then the override's start of text."""
    own = []
    for c in CATEGORIES:
        first = F.slice(L.of_category(F.col("hits"), c), 1, PROBLEM_HITS)
        own.append(F.when(F.col(f"rank_{c}") >= 2, _problem_rows(first, c)).otherwise(_none()))
    legal = F.array(
        F.struct(
            F.lit("legal").alias("category"), F.lit("Severe").alias("severity"), F.substring(text, 1, LEGAL_CHARS).alias("snippet"), F.lit(0).alias("offset")
        )
    )
    return F.concat(*own, F.when(F.col("override").isNotNull(), legal).otherwise(_none()))


def _none() -> Column:
    return F.array().cast("array<struct<category:string,severity:string,snippet:string,offset:int>>")


def _problem_rows(found: Column, category: str) -> Column:
    name = R.severity_name(F.col(f"rank_{category}"))
    return F.transform(
        found, lambda h: F.struct(F.lit(category).alias("category"), name.alias("severity"), h["snippet"].alias("snippet"), h["offset"].alias("offset"))
    )


def _class_rows() -> Column:
    """A rated scene's results as (key, value) by category."""
    entry = lambda c: F.struct(
        F.col(f"rule_{c}").alias("rule_score"), F.col(f"model_{c}").alias("model_proba"), F.col(f"episode_{c}").alias("episode_max"),
        F.col(f"final_{c}").alias("final_proba"), R.severity_name(F.col(f"rank_{c}")).alias("severity"),
        F.size(L.of_category(F.col("hits"), c)).cast("long").alias("episodes_count"),
    )
    return F.array(*(F.struct(F.lit(c).alias("key"), entry(c).alias("value")) for c in CATEGORIES))


def per_class() -> Column:
    """The map of a rated scene's results by category."""
    return F.map_from_entries(_class_rows())


def _sums(scene: str | None = None) -> list[Column]:
    """``scene``: a column that is null in the row of a script without scenes, which has no age."""
    return [
        F.count(scene or "*").alias("count_scenes"),
        F.coalesce(F.max("age_rank"), F.lit(0)).alias("age_rank"),
        *(F.count_if(F.col("age_rank") == i).alias(f"n_{i}") for i in range(1, len(AGES))),
        *(F.count_if(F.col(f"rank_{c}") > 0).alias(f"scenes_{c}") for c in CATEGORIES),
        *(F.sum(F.size(L.of_category(F.col("hits"), c))).alias(f"hits_{c}") for c in CATEGORIES),
    ]


def summarize(rated: DataFrame, id_col: str) -> DataFrame:
    """One row per script: scenes, counts by age, the highest age, and by category scenes and hits."""
    return rated.groupBy(id_col).agg(*_sums())


def percentage(n: Column, of: Column) -> Column:
    return F.bround(F.lit(100.0) * n / F.greatest(of, F.lit(1)), 2)


def parents_guide(rated: DataFrame, id_col: str) -> DataFrame:
    """One row per script and category: percentage_scenes and episodes_total."""
    s = summarize(rated, id_col)
    rows = F.array(
        *(
            F.struct(
                F.lit(c).alias("category"), percentage(F.col(f"scenes_{c}"), F.col("count_scenes")).alias("percentage_scenes"),
                F.col(f"hits_{c}").alias("episodes_total"),
            )
            for c in CATEGORIES
        )
    )
    return s.select(id_col, F.explode(rows).alias("g")).select(id_col, "g.*")


def script_rating(summary: DataFrame, id_col: str) -> DataFrame:
    return summary.select(id_col, R.age_name(F.col("age_rank")).alias("rating"))


def reports(rated: DataFrame, id_col: str = "script_id", text_col: str = "text") -> DataFrame:
    """One row per script: the nested report (rating, summary, parents_guide, details in the order of scene_index).

    The details of one script meet in one row, as the report is one document. A row without a scene_index stands for a
    script without scenes: it counts none, and is for all ages.
    """
    header = parse_header(F.col(text_col))
    there = F.col("scene_index").isNotNull()
    rated = rated.withColumn("age_rank", F.when(there, F.col("age_rank")))
    # A map can't be sorted: the results by category are rows until the details are in order.
    detail = rated.withColumn("h", header).select(
        id_col,
        F.struct(
            "scene_index", *(F.col(f"h.{f}").alias(f) for f in FIELDS), _class_rows().alias("per_class"),
            R.age_name(F.col("age_rank")).alias("scene_rating"), problems(F.col(text_col)).alias("problems"),
        ).alias("detail"),
        "scene_index", "age_rank", "hits", *(f"rank_{c}" for c in CATEGORIES),
    )
    s = detail.groupBy(id_col).agg(*_sums("scene_index"), F.collect_list(F.when(there, F.col("detail"))).alias("ds"))
    s = s.withColumn("details", F.transform(F.sort_array("ds"), lambda d: d.withField("per_class", F.map_from_entries(d["per_class"]))))
    guide = F.create_map(
        *(
            x for c in CATEGORIES for x in (
                F.lit(c),
                F.struct(percentage(F.col(f"scenes_{c}"), F.col("count_scenes")).alias("percentage_scenes"), F.col(f"hits_{c}").alias("episodes_total")),
            )
        )
    )
    ratings = F.create_map(*(x for i in range(1, len(AGES)) for x in (F.lit(AGES[i]), F.col(f"n_{i}"))))
    return s.select(
        id_col,
        F.struct(
            R.age_name(F.col("age_rank")).alias("rating"),
            F.struct("count_scenes", ratings.alias("scene_ratings")).alias("summary"),
            guide.alias("parents_guide"),
            "details",
        ).alias("report"),
    )


def scene_check() -> Column:
    """A rated scene's check as JSON."""
    return F.to_json(
        F.struct(
            R.age_name(F.col("base_rank")).alias("base_age"), R.age_name(F.col("age_rank")).alias("final_age"), F.col("override"), per_class().alias("per_class")
        ),
        {"ignoreNullFields": "false"},
    )


def presence_rating(texts: DataFrame, id_col: str, text_col: str = "text", words=PRESENCE_WORDS) -> DataFrame:
    """The older rating: the worst severity of any scene by counts of words that are anywhere in it."""
    worst = F.greatest(*(F.array_position(F.array(*map(F.lit, SEVERITIES)), L.presence_severity(n)) for n in L.presence(F.col(text_col), words).values()))
    age = F.element_at(F.array(*map(F.lit, ("0+", "12+", "16+", "18+"))), F.max("worst").cast("int"))
    return texts.select(id_col, worst.alias("worst")).groupBy(id_col).agg(age.alias("age_rating"))
