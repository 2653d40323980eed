"""The whole programs: rating scripts, extracting labels and episodes, features, and the single-scene check."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import ANNOTATION_CHARS, CATEGORIES, LOG_CHARS, SCENE_STRIDE, SCENE_WINDOW, SEVERITIES
from ..operators import headers as H
from ..operators import lexicon as L
from ..operators import models as M
from ..operators import normalize as N
from ..operators import rating as R
from ..operators import segment as G
from ..operators import tags as T
from ..operators import windows as W
from ..sources import scripts, sinks


def scenes_of(texts: DataFrame, id_col: str = "script_id", outer: bool = False) -> DataFrame:
    """(id, scene_index, text) of normalised scripts. ``outer``: a script without scenes has a row without a scene."""
    made = texts.select(id_col, N.normalize_headings(F.col("text")).alias("text"))
    return G.explode_scenes(made, G.scenes(F.col("text")), id_col, outer)


def rate_scripts(texts: DataFrame, **options) -> DataFrame:
    """Reports of scripts (script_id, text); one without scenes is rated for all ages."""
    return R.reports(R.rate_scenes(scenes_of(texts, outer=True), **options))


def rate_with_heads(scenes: DataFrame, features: DataFrame, heads: dict | None, **options) -> DataFrame:
    """Rated scenes, with the features' episode_<category> columns and, if there are heads of scenes, their probabilities.

    Scenes and features (script_id, scene_index, x, episode_<category>) meet by key; a scene without features has
    probabilities of 0.
    """
    rows = scenes.join(features, ["script_id", "scene_index"], "left")
    found = {c: f"episode_{c}" for c in CATEGORIES}
    rows = rows.withColumnsRenamed({v: f"{v}_max" for v in found.values()})  # the rated scene's own columns have these names
    episode = {c: F.coalesce(f"{v}_max", F.lit(0.0)) for c, v in found.items()}
    model = {c: F.coalesce(M.head_value(heads[c]["bin"], F.col("x")), F.lit(0.0)) for c in CATEGORIES} if heads else None
    return R.rate_scenes(rows, episode=episode, model=model, **options).drop("x", *(f"{v}_max" for v in found.values()))


def analyze_scripts(
    spark: SparkSession, path: str, report_path: str, heads_path: str | None = None, episode_heads_path: str | None = None, tokenize=None, encoder=None
) -> None:
    """Read, rate and write. With a tokenizer, an encoder and saved heads of episodes, scenes get their features, and with
    saved heads of scenes also the model's probabilities; heads of scenes are optional."""
    texts = scripts.read_scripts(spark, path)
    if tokenize is None or encoder is None or episode_heads_path is None:
        sinks.write_reports(rate_scripts(texts), report_path)
        return
    episodes = M.load_heads(spark, episode_heads_path)
    if episodes is None:
        raise FileNotFoundError(f"no heads of episodes at {episode_heads_path}")
    scenes = scenes_of(texts, outer=True)
    features = make_features(scenes.where("scene_index IS NOT NULL"), tokenize(F.col("text")), encoder, episodes)
    rated = rate_with_heads(scenes, features, M.load_heads(spark, heads_path) if heads_path else None)
    sinks.write_reports(R.reports(rated), report_path)


def analyze_by_presence(texts: DataFrame) -> DataFrame:
    """The older program's scenes (script_id, scene_id, text, a severity by category)."""
    rows = G.explode_scenes(texts, G.marker_scenes(F.col("text")))
    named = {c: L.presence_severity(n) for c, n in L.presence(F.col("text")).items()}
    return rows.select("script_id", F.col("scene_index").alias("scene_id"), "text", *(v.alias(c) for c, v in named.items()))


def extract_labels(scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rows of scenes, and the rejects: ``skipped`` (no heading, no labels) and ``no_location`` (a type, but no place)."""
    line = X.first_line(F.col("text"))
    rows = scenes.withColumn("line", line).withColumn("strict", N.normalize_heading(line))
    rows = rows.withColumn("h", H.parse_header(F.col("strict"), wide=True)).withColumn("l", T.label_severities(F.col("text")))
    empty = H.is_empty(F.col("h"))
    for c in CATEGORIES:
        empty = empty & (F.col(f"l.{c}") == "None")
    rows = rows.withColumn("skip", empty)
    labels = rows.where(~F.col("skip")).select(
        "script_id", "scene_index", *(F.col(f"h.{f}").alias(f) for f in ("scene_no", "place_type", "location", "tod")),
        *(x for c in CATEGORIES for x in (T.has_flag(F.col(f"l.{c}")).alias(f"has_{c}"), F.col(f"l.{c}").alias(f"sev_{c}"))),
    )
    reason = F.when(F.col("skip"), "skipped").when((F.col("h.place_type") != "") & (F.col("h.location") == ""), "no_location")
    rejects = rows.withColumn("reason", reason).where("reason IS NOT NULL").select(
        "script_id", "scene_index", "reason", F.substring("line", 1, LOG_CHARS).alias("line"), "strict"
    )
    return labels, rejects


def extract_label_files(spark: SparkSession, path: str, labels_path: str, rejects_path: str) -> None:
    texts = scripts.read_scripts(spark, path, clean="labels")
    labels, rejects = extract_labels(scenes_of(texts))
    sinks.write_csv(labels.drop("script_id", "scene_index"), labels_path)
    sinks.write_rejects(rejects, rejects_path)


def extraction_summary(scenes: DataFrame) -> DataFrame:
    """One row: scenes cut, written and skipped."""
    labels, rejects = extract_labels(scenes)
    rows = labels.select(F.lit(1).alias("w"), F.lit(0).alias("s")).unionByName(rejects.where("reason = 'skipped'").select(F.lit(0).alias("w"), F.lit(1).alias("s")))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("cut"), n("w").alias("written"), n("s").alias("skipped"))


def annotation_rows(scenes: DataFrame, answers: DataFrame) -> DataFrame:
    """Annotated label rows. ``answers``: script_id, scene_index, sev_<category> (null: none), episodes (array of cat,
    quote, offset) and notes; a severity outside the choices is None, and a quote's offset is looked up in the scene."""
    rows = scenes.join(answers, ["script_id", "scene_index"]).withColumn("h", H.parse_header(F.col("text")))
    severity = lambda c: F.when(F.col(f"sev_{c}").isin("Mild", "Moderate", "Severe"), F.col(f"sev_{c}")).otherwise("None")
    found = F.transform(
        "episodes",
        lambda e: F.struct(e["cat"].alias("cat"), T.quote_offset(F.col("text"), e["quote"], F.coalesce(e["offset"], F.lit(0))).alias("offset"), e["quote"].alias("text")),
    )
    return rows.select(
        *(F.col(f"h.{f}").alias(f) for f in ("scene_no", "place_type", "location", "tod")),
        *(x for c in CATEGORIES for x in (F.col(f"sev_{c}").isNotNull().cast("int").alias(f"has_{c}"), severity(c).alias(f"sev_{c}"))),
        F.coalesce(F.to_json(found), F.lit("[]")).alias("episodes_json"), F.coalesce("notes", F.lit("")).alias("notes"),
    )


def presence_reports(texts: DataFrame) -> DataFrame:
    """The older program's reports: one JSON document a script."""
    rows = analyze_by_presence(texts)
    worst = F.greatest(*(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c)) for c in CATEGORIES))
    made = rows.groupBy("script_id").agg(
        F.max(worst).cast("int").alias("worst"), F.array_sort(F.collect_list(F.struct("scene_id", "text", *CATEGORIES))).alias("scenes")
    )
    age = F.element_at(F.array(*map(F.lit, ("0+", "12+", "16+", "18+"))), F.col("worst"))
    return made.select("script_id", F.to_json(F.struct(age.alias("age_rating"), "scenes")).alias("report"))


def train_scene_heads(features: DataFrame, labels: DataFrame) -> tuple[dict, dict]:
    """A classifier for each category, and its metrics on the rows held out. Features and labels meet by key."""
    rows = features.join(labels, ["script_id", "scene_index"]).withColumn("key", F.concat_ws("#", "script_id", "scene_index"))
    heads, judged = {}, {}
    for c in CATEGORIES:
        split = M.split_for(rows, "key", f"has_{c}")
        heads[c] = M.fit_logistic(split.where("train"), f"has_{c}", "x")
        guess = M.predict(split.where("NOT train"), heads[c], "p", "x").withColumn("guess", (F.col("p") > 0.5).cast("int"))
        judged[c] = M.report(split.where("train"), guess, f"has_{c}", "guess")
    return heads, judged


def train_episode_heads(vectors: DataFrame) -> tuple[dict, dict]:
    """A classifier and a severity regression for each category, and the classifier's metrics on the rows held out, from
    episodes with a ``vector`` column and a key ``text``."""
    heads, judged = {}, {}
    for c in CATEGORIES:
        split = M.split_for(vectors, "text", c, least=2)
        train = split.where("train")
        heads[c] = {"bin": M.fit_logistic(train, c), "sev": M.fit_ridge(train, f"sev_{c}_num")}
        guess = M.predict(split.where("NOT train"), heads[c]["bin"], "p").withColumn("guess", (F.col("p") > 0.5).cast("int"))
        judged[c] = M.report(train, guess, c, "guess")
    return heads, judged


def train_episode_files(spark: SparkSession, episodes_path: str, heads_path: str, tokenize, encoder) -> dict:
    """Read episodes, encode them, train their heads and save these; the metrics."""
    vectors = W.episode_vectors(scripts.read_episodes(spark, episodes_path), tokenize, encoder)
    heads, judged = train_episode_heads(vectors)
    M.save_heads(spark, heads, heads_path)
    return judged


def apply_heads(features: DataFrame, heads: dict, vector: str = "x") -> DataFrame:
    """Features with a column proba_<category> for each head (a model, or a category's parts)."""
    for c in CATEGORIES:
        features = M.predict(features, heads[c]["bin"] if isinstance(heads[c], dict) else heads[c], f"proba_{c}", vector)
    return features


def annotation_sheet(scenes: DataFrame) -> DataFrame:
    """What an annotator is shown of each scene: its heading's parts and the beginning of its text."""
    rows = scenes.withColumn("h", H.parse_header(F.col("text")))
    return rows.select("script_id", "scene_index", "h.*", F.substring("text", 1, ANNOTATION_CHARS).alias("text"))


def extract_episodes(texts: DataFrame) -> DataFrame:
    cleaned = texts.select("script_id", N.clean_episode_text(F.col("text")).alias("text"))
    return T.episode_rows(cleaned, "script_id")


def make_features(scenes: DataFrame, tokens, encoder, heads, cache: str | None = None) -> DataFrame:
    """(script_id, scene_index, x, episode_<category>): x is the scene's vector, rule counts, tag features and episode
    aggregates; the other columns are the largest episode probability of each category.

    ``tokens``: a column of token ids of ``text``; ``encoder``: a factory of window encoders; ``heads``: as in
    ``windows.linear_scores``; ``cache``: where vectors of texts are kept and looked up, if anywhere. Scenes are joined
    by key, never by place.
    """
    keyed = scenes.withColumn("scene", F.concat_ws("#", "script_id", "scene_index")).withColumn("tokens", tokens)

    def cut(rows: DataFrame, key: str, windows) -> DataFrame:
        return rows.select(key, F.posexplode(windows).alias("window", "w")).select(key, "window", F.col("w.tokens").alias("tokens"))

    def whole(rows: DataFrame, key: str) -> DataFrame:
        made = W.encode_windows(cut(rows, key, G.token_windows(F.col("tokens"), SCENE_WINDOW, SCENE_STRIDE)), "tokens", encoder)
        return W.scene_vectors(made, key, "window", "vector")

    if cache is None:
        rows = keyed.join(whole(keyed, "scene"), "scene")
    else:
        rows = W.cached_vectors(keyed, "text", cache, lambda new: whole(new.withColumn("tokens", tokens), "key"), SCENE_WINDOW, SCENE_STRIDE)
    parts = W.encode_windows(cut(keyed, "scene", G.episode_windows(F.col("tokens"))), "tokens", encoder).select("scene", "window", "vector")
    each = W.episode_aggregates(W.linear_scores(parts, "vector", heads), "scene")
    names = ("bin_max", "bin_mean", "bin_top", "sev_max", "sev_mean", "sev_top")
    found = each.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("category", F.array(*names)))).alias("m"))
    episodes = found.select("scene", F.concat(*(F.element_at("m", F.lit(c)) for c in CATEGORIES)).alias("episodes"))
    rows = rows.join(episodes, "scene").join(W.episode_max(each, "scene"), "scene")
    counts = L.counts(F.col("text")).cast("array<double>")
    return rows.select(
        "script_id", "scene_index", F.concat("vector", counts, T.episode_features(F.col("text")), "episodes").alias("x"), *(f"episode_{c}" for c in CATEGORIES)
    )


def write_feature_files(features: DataFrame, labels: DataFrame, path: str) -> None:
    """Features with the five flags of their labels; they meet by key."""
    flags = labels.select("script_id", "scene_index", *(f"has_{c}" for c in CATEGORIES))
    sinks.write_features(features.join(flags, ["script_id", "scene_index"]), path)


def check_scene(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m reelgrade.plans.pipelines TEXT | FILE``, or the text on standard input: the check of one scene as JSON."""
    from ..session import local_session

    args = " ".join(sys.argv[1:] if argv is None else argv)
    if args:
        try:
            with open(args, encoding="utf-8") as f:
                text = f.read()
        except OSError:
            text = args
    else:
        text = sys.stdin.read()
    if not text.strip():
        print("usage: python -m reelgrade.plans.pipelines TEXT | FILE, or the text on standard input")
        return 1
    spark = spark or local_session(2, 2, "2g")
    print(R.rate_scenes(scripts.scene_from_text(spark, text)).select(R.scene_check().alias("j")).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(check_scene())
