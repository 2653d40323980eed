"""Scores, severities and ages as expressions. Severities and ages are carried by rank and named at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import AGES, CATEGORIES, FUSION, FUSION_WITHOUT_MODEL, SCORE_SCALE, SEVERITIES, SEVERITY_BOUNDS


def rule_score(total: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(total) * F.lit(SCORE_SCALE))


def severity_rank(p: Column) -> Column:
    """0 None to 3 Severe; the bounds are exclusive."""
    out = F.lit(len(SEVERITY_BOUNDS))
    for rank in reversed(range(len(SEVERITY_BOUNDS))):
        out = F.when(p < F.lit(SEVERITY_BOUNDS[rank]), F.lit(rank)).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def age_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, AGES)), rank + 1)


def age_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, AGES)), name).cast("int") - 1


def fused(rule: Column, episode: Column, model: Column | None = None) -> Column:
    """The final probability, with a model's or without."""
    if model is None:
        return F.lit(FUSION_WITHOUT_MODEL["rule"]) * rule + F.lit(FUSION_WITHOUT_MODEL["episode"]) * episode
    return F.lit(FUSION["model"]) * model + F.lit(FUSION["rule"]) * rule + F.lit(FUSION["episode"]) * episode


def scene_age_rank(rank: dict[str, Column]) -> Column:
    """The age of a scene from its severity ranks by category; the first rule that holds decides."""
    moderate, severe, mild = 2, 3, 1
    age = {a: F.lit(i) for i, a in enumerate(AGES)}
    return (
        F.when((rank["profanity"] >= moderate) | (rank["sexual"] == severe) | (rank["violence"] == severe), age["18+"])
        .when((rank["violence"] == moderate) | (rank["sexual"] == moderate) | (rank["alcohol_drugs"] >= moderate), age["16+"])
        .when(rank["scary"].isin(mild, moderate), age["12+"])
        .otherwise(age["6+"])
    )


def by_category(build) -> dict[str, Column]:
    return {c: build(c) for c in CATEGORIES}
