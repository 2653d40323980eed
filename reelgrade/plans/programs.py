"""Queries over whole programs: reports, scenes and headings of generated scripts, heads and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import AGES, CATEGORIES
from ..functions import ratings as R
from ..operators import headers as H
from ..operators import models as M
from ..operators import normalize as N
from ..operators import rating as Q
from ..operators import segment as G
from ..operators import windows as W
from ..session import spread, table
from . import fixtures as P
from . import tables as T
from .pipelines import annotation_sheet, rate_scripts, rate_with_heads
from .tables import query

# Reports -----------------------------------------------------------------------------------------------------------

_SCENES = f"""WITH {T._rated('conversations', 'conv_id, turn')},
over AS (SELECT *, {T._OVERRIDE} AS reason FROM (SELECT *, {T._words_sql('text')} AS ws FROM rated)),
aged AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 4 ELSE age END AS final FROM over)"""


@query(_SCENES + ",\ns AS (SELECT conv_id, max(final) AS age, count(*) AS n, " + ", ".join(f"count(CASE WHEN final = {i} THEN 1 END) AS r{AGES[i][:-1]}" for i in range(1, 5)) + ", "
    + ", ".join(f"round_even(100.0 * count(CASE WHEN rank_{c} > 0 THEN 1 END)::DOUBLE / count(*), 2) AS p_{c}, CAST(sum(n_{c}) AS BIGINT) AS e_{c}" for c in CATEGORIES)
    + " FROM aged GROUP BY conv_id)\n" + " UNION ALL ".join(
        f"SELECT conv_id, '{c}' AS category, {T._AGE.format('age')} AS rating, n AS count_scenes, r6, r12, r16, r18, p_{c} AS percentage_scenes, e_{c} AS episodes_total FROM s" for c in CATEGORIES
    ))
def script_reports(spark, sf_dir):
    """The head of every conversation's report, each turn a scene: rating, scenes by age, and the guide by category."""
    r = _reports(spark, sf_dir).select("conv_id", "report.rating", "report.summary", F.explode("report.parents_guide").alias("category", "g"))
    ages = (F.try_element_at("summary.scene_ratings", F.lit(a)).alias(f"r{a[:-1]}") for a in AGES[1:])
    return r.select("conv_id", "category", "rating", "summary.count_scenes", *ages, "g.*")


def _reports(spark, sf_dir):
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    turns = turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("scene_index"), "text")
    return Q.reports(Q.rate_scenes(turns, lexicon=P.LEXICON, overrides=P.OVERRIDES), "conv_id")


_DETAILS = " UNION ALL ".join(
    f"""SELECT a.conv_id, CAST(a.turn + 1 AS INTEGER) AS scene_index, '{c}' AS category, {T._AGE.format('a.final')} AS scene_rating, round(k.rule, 6) AS rule_score,
  0.0::DOUBLE AS model_proba, 0.0::DOUBLE AS episode_max, round(CAST(0.8 AS DOUBLE) * k.rule, 6) AS final_proba, {T._SEV.format(f'a.rank_{c}')} AS severity, a.n_{c} AS episodes_count,
  CAST(least(CASE WHEN a.rank_{c} >= 2 THEN a.n_{c} ELSE 0 END, 5) AS INTEGER) AS problems, CASE WHEN a.reason IS NULL THEN 0 ELSE 1 END AS legal
  FROM aged a JOIN ranked k ON k.rid = a.rid AND k.category = '{c}'"""
    for c in CATEGORIES
)


@query(_SCENES + "\n" + _DETAILS)
def report_details(spark, sf_dir):
    """The details of every conversation's report, by scene and category, and how many problems it lists of each."""
    d = _reports(spark, sf_dir).select("conv_id", F.explode("report.details").alias("d"))
    d = d.select("conv_id", "d.scene_index", "d.scene_rating", "d.problems", F.explode("d.per_class").alias("category", "k"))
    count = lambda c: F.size(F.filter("problems", lambda p: p["category"] == c))
    return d.select(
        "conv_id", "scene_index", "category", "scene_rating", *(F.round(f"k.{n}", 6).alias(n) for n in ("rule_score", "model_proba", "episode_max", "final_proba")),
        "k.severity", "k.episodes_count", count(F.col("category")).alias("problems"), count(F.lit("legal")).alias("legal"),
    )


_CHECKS = " UNION ALL ".join(
    f"""SELECT a.conv_id, a.turn, '{c}' AS category, {T._AGE.format('a.age')} AS base_age, {T._AGE.format('a.final')} AS final_age, a.reason, round(k.rule, 6) AS rule_score,
  {T._SEV.format(f'a.rank_{c}')} AS severity, a.n_{c} AS episodes_count FROM aged a JOIN ranked k ON k.rid = a.rid AND k.category = '{c}'"""
    for c in CATEGORIES
)


@query(_SCENES + "\n" + _CHECKS)
def scene_checks(spark, sf_dir):
    """The single-scene check of every turn, read back from its JSON."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    made = Q.rate_scenes(turns, lexicon=P.LEXICON, overrides=P.OVERRIDES).select("conv_id", "turn", Q.scene_check().alias("j"))
    form = "base_age string, final_age string, override struct<reasons:array<string>>, per_class map<string,struct<rule_score:double,severity:string,episodes_count:bigint>>"
    made = made.select("conv_id", "turn", F.from_json("j", form).alias("j")).select("conv_id", "turn", "j.*")
    made = made.select("conv_id", "turn", "base_age", "final_age", F.get("override.reasons", F.lit(0)).alias("reason"), F.explode("per_class").alias("category", "k"))
    return made.select("conv_id", "turn", "category", "base_age", "final_age", "reason", F.round("k.rule_score", 6).alias("rule_score"), "k.severity", "k.episodes_count")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS script_id, CASE WHEN p_size % 3 = 0 THEN '0+' ELSE '6+' END AS rating, CAST(p_size % 3 AS BIGINT) AS count_scenes,
  CAST(p_size % 3 AS BIGINT) AS r6, CAST(p_size % 3 AS INTEGER) AS details FROM part""")
def empty_scripts(spark, sf_dir):
    """Reports of scripts with no, one and two scenes; those without are for all ages."""
    text = F.expr("CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN NULL ELSE repeat('INT. ROOM - DAY\nfive words are in here\n', p_size % 3) END")
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("script_id"), text.alias("text"))
    r = rate_scripts(texts).select("script_id", "report.*")
    return r.select("script_id", "rating", "summary.count_scenes", F.try_element_at("summary.scene_ratings", F.lit("6+")).alias("r6"), F.size("details").alias("details"))


# Scenes and headings -----------------------------------------------------------------------------------------------

_BRAND = "upper(replace(p_brand, '#', ' '))"


def _pick(cases: list[str], by: str) -> str:
    """An expression of both dialects."""
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases[:-1])) + f" ELSE {cases[-1]} END"


_OPENING = _pick(
    [f"'1-2. INT. ' || {_BRAND} || ' - NIGHT'", f"'EXT. ' || {_BRAND} || ' УТРО.'", f"'7. НАТ. ' || {_BRAND} || ' — ДЕНЬ 2'", "'СЦЕНА 5'", f"'9. ИНТ. ' || {_BRAND} || '. НОЧЬ'"],
    "(p_partkey + j) % 5",
)


@query(f"""WITH p AS (SELECT *, unnest(generate_series(0, 4)) AS j FROM part),
s AS (SELECT p_partkey, j, CASE WHEN j = 0 THEN 'some words are five here' ELSE {_OPENING} || chr(10) || 'the ' || p_name || ' stands over there' END AS text FROM p
      WHERE (j = 0 AND p_partkey % 2 = 0) OR (j > 0 AND j <= p_size % 4))
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY j) AS INTEGER) AS scene_index, text FROM s""")
def script_scenes(spark, sf_dir):
    """Scripts of up to three scenes under headings of five forms, after words of their own or none, and before a scene too short to count, cut apart."""
    body = F.expr(f"array_join(transform(filter(sequence(1, 4), j -> j <= p_size % 4), j -> {_OPENING} || '\n  the ' || p_name || ' stands over there \n'), '')")
    whole = F.concat(F.when(F.col("p_partkey") % 2 == 0, "some words are five here\n").otherwise(""), body, F.lit("СЦЕНА 6\nno"))
    d = table(spark, sf_dir, "part").select("p_partkey", whole.alias("text"))
    rows = G.explode_scenes(d, G.scenes(F.col("text")), "p_partkey")
    return rows.select("p_partkey", "scene_index", F.regexp_replace("text", "\n  ", "\n").alias("text"))


@query(f"""WITH s AS (SELECT p_partkey, 1 AS i, 'before all these ' || p_name AS text FROM part
UNION ALL SELECT p_partkey, 2, 'СЦЕНА 3.  ' || {_BRAND} || ' is the place' FROM part
UNION ALL SELECT p_partkey, 3, 'ext.  ' || p_name || ' is out there' FROM part)
SELECT p_partkey, i AS scene_index, text FROM s""")
def marker_scenes(spark, sf_dir):
    """The older rating's scenes: cut at markers anywhere, those of three words or fewer left out."""
    text = F.expr(f"'before all these ' || p_name || ' СЦЕНА 3. ' || {_BRAND} || ' is the place INT. few ext. ' || p_name || ' is out there'")
    d = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return G.explode_scenes(d, G.marker_scenes(F.col("text")), "p_partkey")


@query("""SELECT p_partkey, CAST(least(p_size % 15, 10) AS INTEGER) AS n,
  coalesce((SELECT string_agg('INT. ROOM ' || j || ' - DAY', '|' ORDER BY j) FROM generate_series(1, least(p_size % 15, 10)) t(j)), '') AS headings,
  coalesce((SELECT string_agg('INT. ROOM ' || j || ' - DAY' || chr(10) || 'five words are in here', '|' ORDER BY j) FROM generate_series(1, least(p_size % 15, 10)) t(j)), '') AS scenes
FROM part""")
def first_headings(spark, sf_dir):
    """The first ten headings and scenes of scripts with none to fourteen."""
    text = F.expr("array_join(transform(filter(sequence(1, 15), j -> j <= p_size % 15), j -> 'INT. ROOM ' || j || ' - DAY\nfive words are in here\n'), '')")
    d = table(spark, sf_dir, "part").select("p_partkey", G.first_of_script(text).alias("f"))
    return d.select("p_partkey", F.size("f.headings").alias("n"), F.array_join("f.headings", "|").alias("headings"), F.array_join("f.scenes", "|").alias("scenes"))


_NO = "CAST(p_size AS VARCHAR)"
#: A heading for each parser and both ways of the heuristic, and its scene_no, period, place_type, location, tod.
_HEADINGS = [
    (f"{_NO} || '-' || {_NO} || ' 5-Е. INT. ' || {_BRAND} || ' - РЕЖИМ'", f"{_NO} || '-' || {_NO}", "'5-Е.'", "'INT.'", _BRAND, "'РЕЖИМ'"),
    (f"'ext ' || {_BRAND} || ' night 2.'", "''", "''", "'EXT.'", _BRAND, "'НОЧЬ'"),
    (f"'INT. КУХНЯ.' || replace({_BRAND}, ' ', '') || ' ВЕЧЕР x'", "''", "''", "'INT.'", f"'КУХНЯ.' || replace({_BRAND}, ' ', '')", "'ВЕЧЕР'"),
    (f"{_NO} || '. ' || {_BRAND} || ' — day'", _NO, "''", "''", _BRAND, "'ДЕНЬ'"),
    (f"{_NO} || '. EXT. ' || {_BRAND} || '. NIGHT'", _NO, "''", "'EXT.'", _BRAND, "'НОЧЬ'"),
    ("'A' || repeat('№', CAST(2 + p_size AS INTEGER)) || ' - УТРО'", "''", "''", "''", "'A' || repeat('№', CAST(2 + p_size AS INTEGER))", "'УТРО'"),
    (f"{_NO} || '. НАТ. ' || {_BRAND} || '.HALL'", _NO, "''", "'НАТ.'", f"{_BRAND} || '.HAL'", "''"),
    (f"'x ' || {_NO} || ' EXT. ' || {_BRAND} || ': НОЧЬ'", _NO, "''", "'EXT.'", _BRAND, "'НОЧЬ'"),
    (f"'x ' || {_BRAND} || ': ВЕЧЕР'", f"substr({_BRAND}, 7)", "''", "''", f"'x ' || {_BRAND}", "'ВЕЧЕР'"),
    ("'nothing here'", "''", "''", "''", "''", "''"),
]
_FORM = f"p_partkey % {len(_HEADINGS)}"


@query("SELECT p_partkey, " + ", ".join(
    f"{_pick([h[i] for h in _HEADINGS], _FORM)} AS {n}" for i, n in enumerate(("scene_no", "period", "place_type", "location", "tod"), 1)
) + " FROM part")
def header_patterns(spark, sf_dir):
    """Headings of all parts in ten forms: one for each parser that can win, the heuristic with and without a type, and none."""
    line = F.expr(_pick([h[0] for h in _HEADINGS], _FORM).replace("AS VARCHAR", "AS STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", H.parse_header(line).alias("h")).select("p_partkey", "h.*")


#: Texts of scripts, and what is left of them in one form.
_SCRIPTS = [
    (f"'int ' || {_BRAND} || ': night.'", f"'INT. ' || {_BRAND} || ' - night'"),
    (f"'4. EXT – ' || {_BRAND} || ' — DAY' || chr(92)", f"'4. EXT. ' || {_BRAND} || ' - DAY'"),
    (f"'INT.' || {_BRAND} || '.ДЕНЬ'", f"'INT. ' || {_BRAND} || ' - ДЕНЬ'"),
    (f"'и' || chr(774) || ' {{.smallcaps}}' || chr(92) || '[x' || chr(92) || ']  ' || {_BRAND} || '{{.underline}}'", f"'й [x] ' || {_BRAND}"),
    (f"{_BRAND} || ' -- x' || repeat(chr(10), 4) || 'y'", f"{_BRAND} || ' - x' || repeat(chr(10), 2) || 'y'"),
    (f"'3. INT ' || {_BRAND} || '. DAY.   ' || chr(10) || 'x' || chr(9) || '  y  '", f"'3. INT. ' || {_BRAND} || ' - DAY' || chr(10) || 'x y'"),
    (f"'EXT. ' || {_BRAND} || ' − MORNING ' || chr(92) || chr(92) || chr(10) || 'x'", f"'EXT. ' || {_BRAND} || ' - MORNING' || chr(10) || 'x'"),
]


@query(f"SELECT p_partkey, {_pick([b for _, b in _SCRIPTS], f'p_partkey % {len(_SCRIPTS)}')} AS text FROM part")
def script_forms(spark, sf_dir):
    """Whole scripts with their headings in one form, composed letters and all."""
    text = F.expr(_pick([a for a, _ in _SCRIPTS], f"p_partkey % {len(_SCRIPTS)}").replace("chr(774)", "'\u0306'"))
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_headings(text).alias("text"))


@query(f"""SELECT doc_id, md5(substr(text, 1, 1200)) AS sheet, md5(substr(coalesce(text, ''), 1, 2000)) AS episode,
  CAST(least(len({T._TOKENS.replace('text', 'substr(text, 1, 2000)')}), 512) AS INTEGER) AS tokens FROM documents""")
def text_prefixes(spark, sf_dir):
    """What annotators are shown of every document, and what of it is encoded as an episode."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), F.lit(1).alias("scene_index"), "text")
    sheet = annotation_sheet(d).select(F.col("script_id").alias("doc_id"), F.md5("text").alias("sheet"))
    own = W.episode_text(F.col("text"))
    words = F.filter(F.split(F.lower(own), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    rows = d.select(F.col("script_id").alias("doc_id"), F.md5(own).alias("episode"), F.size(W.episode_tokens(words)).alias("tokens"))
    return sheet.join(rows, "doc_id")


# Vectors and heads -------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) DESC, vec_id DESC) AS place FROM embeddings),
a AS (SELECT label, pos, avg(v) AS mean, max(v) AS most, avg(CASE WHEN place <= 3 THEN v END) AS top FROM x JOIN n USING (label, vec_id) GROUP BY ALL)
SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 6) AS value FROM a
UNION ALL SELECT label, CAST(pos + 64 AS INTEGER), round(most, 6) FROM a UNION ALL SELECT label, CAST(pos + 128 AS INTEGER), round(top, 6) FROM a""")
def scene_vectors(spark, sf_dir):
    """Vectors of each label as a scene's windows: mean, max and top mean, one after another."""
    made = W.scene_vectors(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return made.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("""WITH x AS (SELECT label, CASE WHEN vec_id % 3 <> 0 AND label <> 9 THEN 1 ELSE 0 END AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v * m) / greatest(sum(m), 1e-9::DOUBLE), 6) + 0.0 AS mean FROM x GROUP BY label, pos""")
def masked_pool(spark, sf_dir):
    """Mean of the vectors of each label that a mask lets through; one label has none."""
    rows = table(spark, sf_dir, "embeddings").withColumn("mask", ((F.col("vec_id") % 3 != 0) & (F.col("label") != 9)).cast("int"))
    made = W.masked_mean_pool(rows, "label", "embedding", "mask")
    return made.select("label", "pos", (F.round("mean", 6) + 0.0).alias("mean"))


@query(f"WITH s AS ({T._SCORED}) SELECT label, " + ", ".join(f"round(max(CASE WHEN category = '{c}' THEN bin END), 6) AS episode_{c}" for c in CATEGORIES) + " FROM s GROUP BY label")
def episode_maxima(spark, sf_dir):
    """The largest episode probability of each label and category."""
    made = W.episode_max(W.episode_aggregates(W.linear_scores(table(spark, sf_dir, "embeddings"), "embedding", T._heads()), "label"), "label")
    return made.select("label", *(F.round(f"episode_{c}", 6).alias(f"episode_{c}") for c in CATEGORIES))


_MODELS = {c: P.head(64, i + 5) for i, c in enumerate(CATEGORIES)}
_PROBA = " ".join(f"WHEN '{c}' THEN 1.0 / (1.0 + exp(-({T._dot_sql(h['bin'].weights)} + {h['bin'].bias}::DOUBLE)))" for c, h in _MODELS.items())


@query(f"""WITH {T._hits('documents', 'doc_id')},
score AS (SELECT s.rid, s.doc_id, c.category, least(1.0, ln(1 + coalesce(sum(weight), 0)) * CAST(0.25 AS DOUBLE)) AS rule
          FROM scene s CROSS JOIN cats c LEFT JOIN hit h ON h.rid = s.rid AND h.category = c.category GROUP BY ALL),
epi AS (SELECT vec_id AS doc_id, category, bin FROM ({T._SCORED})),
f AS (SELECT s.rid, s.doc_id, s.category, rule, coalesce(CASE s.category {_PROBA} END, 0) AS model, coalesce(bin, 0) AS episode
      FROM score s LEFT JOIN embeddings e ON e.vec_id = s.doc_id LEFT JOIN epi p ON p.doc_id = s.doc_id AND p.category = s.category),
g AS (SELECT *, CAST(0.55 AS DOUBLE) * model + CAST(0.25 AS DOUBLE) * rule + CAST(0.2 AS DOUBLE) * episode AS final FROM f),
k AS (SELECT *, CASE WHEN final < 0.2::DOUBLE THEN 0 WHEN final < 0.4::DOUBLE THEN 1 WHEN final < 0.7::DOUBLE THEN 2 ELSE 3 END AS rank FROM g),
w AS (SELECT rid, {', '.join(f"max(CASE WHEN category = '{c}' THEN rank END) AS rank_{c}" for c in CATEGORIES)} FROM k GROUP BY rid),
a AS (SELECT rid, CASE WHEN rank_profanity >= 2 OR rank_sexual = 3 OR rank_violence = 3 THEN 4 WHEN rank_violence = 2 OR rank_sexual = 2 OR rank_alcohol_drugs >= 2 THEN 3
                       WHEN rank_scary IN (1, 2) THEN 2 ELSE 1 END AS age FROM w)
SELECT doc_id, category, round(rule, 6) AS rule, round(model, 6) AS model, round(episode, 6) AS episode, round(final, 6) AS final, {T._SEV.format('rank')} AS severity, {T._AGE.format('age')} AS base_age
FROM k JOIN a USING (rid)""")
def assembled_scenes(spark, sf_dir):
    """Documents as scenes, rated from rules, heads of scenes on their vectors, and the episodes' largest probability."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("script_id"), F.lit(1).alias("scene_index"), "embedding")
    scored = W.episode_max(W.episode_aggregates(W.linear_scores(vectors.select("script_id", "embedding"), "embedding", T._heads()), "script_id"), "script_id")
    features = vectors.withColumnRenamed("embedding", "x").join(scored, "script_id")
    scenes = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("script_id"), F.lit(1).alias("scene_index"), "text")
    rated = rate_with_heads(scenes, features, _MODELS, lexicon=P.LEXICON, overrides=())
    row = lambda c: F.struct(
        F.lit(c).alias("category"), *(F.round(f"{n}_{c}", 6).alias(n) for n in ("rule", "model", "episode", "final")), R.severity_name(F.col(f"rank_{c}")).alias("severity")
    )
    rows = rated.select("script_id", R.age_name(F.col("base_rank")).alias("base_age"), F.explode(F.array(*map(row, CATEGORIES))).alias("r"))
    return rows.select(F.col("script_id").alias("doc_id"), "r.*", "base_age")


@query("""WITH d AS (SELECT embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, (label % 4) / 3.0::DOUBLE AS y FROM embeddings),
s AS (SELECT count(*) * covar_pop(x1, x1) + 1 AS a, count(*) * covar_pop(x1, x2) AS b, count(*) * covar_pop(x2, x2) + 1 AS c,
             count(*) * covar_pop(x1, y) AS u, count(*) * covar_pop(x2, y) AS v, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM d),
w AS (SELECT (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2, m1, m2, my FROM s)
SELECT 0 AS place, round(my - w1 * m1 - w2 * m2, 6) AS value FROM w UNION ALL SELECT 1, round(w1, 6) FROM w UNION ALL SELECT 2, round(w2, 6) FROM w""")
def ridge_plane(spark, sf_dir):
    """Intercept and coefficients of a ridge regression of labels on two numbers of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 2).alias("x"), (F.col("label") % 4 / 3.0).alias("y"))
    return _coefficients(spark, M.fit_ridge(rows, "y", "x"), 6)


def _coefficients(spark, model, digits: int):
    head = M.head_of(model)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([head.bias, *head.weights])], "place int, value double").withColumn("value", F.round("value", digits))


def _newton(steps: int) -> str:
    """CTEs i0 to i<steps>: Newton's steps (b, w) of a balanced logistic regression of y on x with the penalty w * w / 2."""
    out = ["i0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS w)"]
    for i in range(steps):
        out.append(f"""g{i} AS (SELECT b, w, sum(k * (p - y)) AS g0, sum(k * (p - y) * x) + w AS g1, sum(k * p * (1 - p)) AS h00, sum(k * p * (1 - p) * x) AS h01, sum(k * p * (1 - p) * x * x) + 1 AS h11
FROM (SELECT d.*, b, w, 1.0 / (1.0 + exp(-(b + w * x))) AS p FROM d, i{i}) GROUP BY b, w),
i{i + 1} AS (SELECT b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b, w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w FROM g{i})""")
    return ",\n".join(out)


@query(f"""WITH e AS (SELECT embedding[1]::DOUBLE AS x, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings),
c AS (SELECT y, count(*) AS n, (SELECT count(*) FROM e) AS total FROM e GROUP BY y),
d AS (SELECT e.x, e.y, c.total / (2.0 * c.n) AS k FROM e JOIN c USING (y)),
{_newton(12)}
SELECT 0 AS place, round(b, 4) AS value FROM i12 UNION ALL SELECT 1, round(w, 4) FROM i12""")
def logistic_line(spark, sf_dir):
    """Intercept and coefficient of a balanced classifier of one label on one number of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 1).alias("x"), (F.col("label") == 0).cast("int").alias("y"))
    return _coefficients(spark, M.fit_logistic(rows, "y", "x"), 4)
