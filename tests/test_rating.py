"""Hand-derived cases of the content rating, over the default lexicon."""

import json

import pytest
from pyspark.sql import functions as F

from reelgrade.functions import ratings as R
from reelgrade.functions import text as X
from reelgrade.operators import headers as H
from reelgrade.operators import lexicon as L
from reelgrade.operators import models as M
from reelgrade.operators import normalize as N
from reelgrade.operators import segment as G
from reelgrade.operators import tags as T
from reelgrade.operators import windows as W
from reelgrade.plans import pipelines

SCRIPT = """СЦЕНА 1. КВАРТИРА. НОЧЬ
На полу кровь. За окном слышен крик.

СЦЕНА 2. ДВОР. УТРО
Мальчик играет с собакой во дворе.

СЦЕНА 3. ПОДЪЕЗД. НОЧЬ
Из темноты появляется тень, труп падает на пол.
"""


CATS = ("violence", "sexual", "profanity", "alcohol_drugs", "scary")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "heading, strict",
    [
        ("1-2 инт. ПОЕЗД. КУПЕ - ДЕНЬ.", "1-2 ИНТ. ПОЕЗД. КУПЕ - ДЕНЬ"),
        ("1-2-А НАТ.: УЛИЦА - НОЧЬ", "1-2-А НАТ. УЛИЦА - НОЧЬ"),
        ("3. ИНТ - КОМНАТА: день", "3. ИНТ. КОМНАТА - ДЕНЬ"),
        ("ИНТ.ЛОКАЦИЯ.ВЕЧЕР", "ИНТ. ЛОКАЦИЯ. - ВЕЧЕР"),
        ("5 ИНТ КУХНЯ — УТРО", "5 ИНТ. КУХНЯ - УТРО"),
        ("НАТ - ДОМ.ДЕНЬ", "НАТ. ДОМ. - ДЕНЬ"),
        ("инт. квартира: ночь.", "ИНТ. квартира - НОЧЬ"),
        ("ИНТ: ОФИС - ДЕНЬ", "ИНТ. ОФИС - ДЕНЬ"),
    ],
)
def test_strict_headings(spark, heading, strict):
    assert one(spark, N.normalize_heading(F.col("h")), h=heading) == strict


def test_headers(spark):
    parsed = lambda h: tuple(one(spark, H.parse_header(F.col("h")), h=h))
    assert parsed("1-2 ИНТ. ПОЕЗД. КУПЕ - ДЕНЬ") == ("1-2", "", "ИНТ.", "ПОЕЗД. КУПЕ", "ДЕНЬ")
    assert parsed("12. EXT. YARD. NIGHT") == ("12", "", "EXT.", "YARD", "НОЧЬ")
    assert parsed("СЦЕНА 1. КВАРТИРА - НОЧЬ") == ("1", "", "", "СЦЕНА 1. КВАРТИРА", "НОЧЬ")
    assert parsed("") == ("", "", "", "", "")
    assert tuple(one(spark, H.parse_header(F.col("h")), h=None)) == ("", "", "", "", "")


def test_composed_text(spark):
    assert one(spark, N.composed(F.col("x")), x="й") == "й"


def test_script_end_to_end(spark):
    texts = spark.createDataFrame([("a", SCRIPT), ("b", ""), ("c", None)], "script_id string, text string")
    reports = {r["script_id"]: r["report"] for r in pipelines.rate_scripts(texts).collect()}
    a = reports["a"]
    assert set(reports) == {"a", "b", "c"}
    for empty in (reports["b"], reports["c"]):
        assert empty["rating"] == "0+" and empty["details"] == [] and set(empty["summary"]["scene_ratings"].values()) == {0}
        assert empty["summary"]["count_scenes"] == 0 and empty["parents_guide"]["scary"].asDict() == {"percentage_scenes": 0.0, "episodes_total": 0}
    assert a["rating"] == "6+" and a["summary"]["count_scenes"] == 3
    assert a["summary"]["scene_ratings"] == {"6+": 3, "12+": 0, "16+": 0, "18+": 0}
    assert a["parents_guide"]["violence"].asDict() == {"percentage_scenes": 33.33, "episodes_total": 2}
    assert [d["scene_index"] for d in a["details"]] == [1, 2, 3]
    third = a["details"][2]
    assert third["tod"] == "НОЧЬ" and third["per_class"]["violence"]["severity"] == "Mild"
    assert round(third["per_class"]["violence"]["final_proba"], 6) == 0.219722


def test_hits_keep_offsets(spark):
    text = "Труп, труп.\nНож и половой акт; ножом"
    found = one(spark, L.hits(F.col("t")), t=text)
    assert [(h["match"], h["offset"]) for h in found] == [("труп", 0), ("труп", 6), ("нож", 12), ("половой акт", 18)]
    assert all(text.lower()[h["offset"] : h["offset"] + len(h["match"])] == h["match"] for h in found)
    assert found[1]["snippet"] == text[:35].replace("\n", " ")
    assert one(spark, L.hits(F.col("t")), t=None) == [] and one(spark, L.counts(F.col("t")), t="нож нож") == [2, 0, 0, 0, 0]


def test_scoring_stops_at_the_limit(spark):
    text = "а " * 3999 + "нож нож"
    assert len(one(spark, L.hits(F.col("t")), t=text)) == 0  # cut inside the first one
    assert one(spark, L.counts(F.col("t")), t=text)[0] == 2


@pytest.mark.parametrize("p, name", [(0.1999, "None"), (0.2, "Mild"), (0.4, "Moderate"), (0.7, "Severe")])
def test_severity_edges(spark, p, name):
    assert spark.range(1).select(R.severity_name(R.severity_rank(F.lit(p))).alias("v")).first()["v"] == name


@pytest.mark.parametrize(
    "ranks, age",
    [
        ({}, "6+"), ({"scary": 3}, "6+"), ({"scary": 1}, "12+"), ({"alcohol_drugs": 2}, "16+"), ({"violence": 2}, "16+"),
        ({"profanity": 2}, "18+"), ({"violence": 3}, "18+"), ({"violence": 1}, "6+"),
    ],
)
def test_age_rules(spark, ranks, age):
    column = R.age_name(R.scene_age_rank({c: F.lit(ranks.get(c, 0)) for c in ("violence", "sexual", "profanity", "alcohol_drugs", "scary")}))
    assert spark.range(1).select(column.alias("v")).first()["v"] == age


def test_overrides_in_order(spark):
    reason = lambda t: (one(spark, L.legal_override(F.col("t")), t=t) or {"reasons": [None]})["reasons"][0]
    assert reason("вскрыл и вводит").startswith("Натуралистическое")
    assert reason("инструкция").startswith("Наркотики")
    assert reason("СУКА, кайф").startswith("Обсценная")
    assert reason("Тихий вечер") is None


def test_tags(spark):
    features = lambda t: one(spark, T.episode_features(F.col("t")), t=t)
    assert features("[ep: v=Severe, cat=v, sev=Mild]") == [1.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0]
    assert features("[ep: v=жёсткое]")[0] == 0.66
    assert features("[ep: cat=scary]")[4] == 0.66 and features("[EP : x]") == [0.0] * 10
    labels = one(spark, T.label_severities(F.col("t")), t="[МЕТКИ: насилие=жёсткое, p=abc, zz=mild]")
    assert labels["violence"] == "Severe" and labels["profanity"] == "abc" and labels["sexual"] == "None"
    rows = T.episode_rows(spark.createDataFrame([(1, "x [ep: v=жёсткое] y [EP : z]")], "id long, text string"), "id").orderBy("tag").collect()
    assert (rows[0]["violence"], rows[0]["sev_violence"], rows[0]["sev_violence_num"]) == (1, "Severe", 1.0)
    assert rows[1]["violence"] == 0 and rows[1]["text"].endswith("[EP : z]")


@pytest.mark.parametrize("n, starts", [(0, [0]), (384, [0]), (385, [0, 1]), (704, [0, 320]), (1000, [0, 320, 616])])
def test_window_starts(spark, n, starts):
    assert spark.range(1).select(G.window_starts(F.lit(n)).alias("v")).first()["v"] == starts
    most = spark.range(1).select(G.window_starts(F.lit(5000), 256, 224, 16).alias("v")).first()["v"]
    assert len(most) == 16 and most[:2] == [0, 224]


def test_scene_vectors(spark):
    rows = spark.createDataFrame([("s", i, [float(i), 1.0]) for i in range(5)], "scene string, w int, v array<float>")
    assert W.scene_vectors(rows, "scene", "w", "v").first()["vector"] == [2.0, 1.0, 4.0, 1.0, 3.0, 1.0]


def test_features_have_their_width(spark):
    scenes = spark.createDataFrame([("a", 1, "слово " * 600), ("a", 2, "нож [ep: v=mild]")], "script_id string, scene_index int, text string")
    tokens = F.transform(F.split("text", " "), lambda w: (F.crc32(w) % 1000).cast("int"))
    heads = {c: {"bin": M.Head("logistic", [0.1] * 8, 0.0), "sev": M.Head("ridge", [0.1] * 8, 0.0)} for c in CATS}
    made = pipelines.make_features(scenes, tokens, lambda: W.hashing_encoder(8), heads).collect()
    assert {len(r["x"]) for r in made} == {3 * 8 + 45} and len(W.feature_columns(8)) == 3 * 8 + 45
    names = W.feature_columns(8)
    for r in made:  # the largest episode probability is one of the features
        assert all(r[f"episode_{c}"] == r["x"][names.index(f"{c}_bin_max")] for c in CATS)


def test_vectors_are_kept(spark, tmp_path):
    scenes = spark.createDataFrame([("a", 1, "слово " * 600), ("a", 2, "нож"), ("b", 1, "нож"), ("b", 2, None)], "script_id string, scene_index int, text string")
    calls = []

    def compute(new):
        calls.append(sorted(r["text"] or "" for r in new.collect()))
        return new.select("key", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("vector"))

    path = str(tmp_path / "vectors")
    first = W.cached_vectors(scenes.where("scene_index = 1"), "text", path, compute, 384, 320).collect()
    both = W.cached_vectors(scenes, "text", path, compute, 384, 320).collect()
    assert calls == [["нож", "слово " * 600], [""]] and len(first) == 2
    assert {(r["script_id"], r["scene_index"]): r["vector"] for r in both} == {("a", 1): [3600.0], ("a", 2): [3.0], ("b", 1): [3.0], ("b", 2): [0.0]}
    heads = {c: {"bin": M.Head("constant", [], 0.25), "sev": M.Head("constant", [], 2.0)} for c in CATS}
    tokens = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: (F.crc32(w) % 1000).cast("int"))
    plain = pipelines.make_features(scenes, tokens, lambda: W.hashing_encoder(4), heads)
    kept = pipelines.make_features(scenes, tokens, lambda: W.hashing_encoder(4), heads, cache=str(tmp_path / "own"))
    key = lambda r: (r["script_id"], r["scene_index"])
    assert sorted(plain.collect(), key=key) == sorted(kept.collect(), key=key)


def test_masked_means_and_model_sessions():
    import numpy as np

    class Session:  # stands in for a transformer: a token's vector is its id and the id's double
        def run(self, _, fed):
            assert fed["input_ids"].shape == fed["attention_mask"].shape
            return [np.stack([fed["input_ids"], 2 * fed["input_ids"]], axis=2).astype(np.float32)]

    got = W.session_encoder(Session(), pad=99)([[1, 3], [5], []])
    assert got.tolist() == [[2.0, 4.0], [5.0, 10.0], [0.0, 0.0]]


def test_scripts_are_rated_with_saved_heads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ИНТ. ДОМ - НОЧЬ\nТихо и очень спокойно тут сегодня\nИНТ. САД - ДЕНЬ\nТут кровь и труп лежит на полу\n", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("\n", encoding="utf-8")
    tokens = lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), " "), lambda w: (F.crc32(w) % 1000).cast("int"))
    M.save_heads(spark, {c: {"bin": M.Head("constant", [], 0.5), "sev": M.Head("ridge", [0.1] * 4, 0.2)} for c in CATS}, str(tmp_path / "episodes"))
    M.save_heads(spark, {c: M.Head("constant", [], 1.0) if c == "scary" else 0.0 for c in CATS}, str(tmp_path / "scenes"))
    for heads, scary in ((str(tmp_path / "scenes"), 0.55 + 0.1), (str(tmp_path / "none"), 0.1), (None, 0.1)):
        pipelines.analyze_scripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), heads, str(tmp_path / "episodes"), tokens, lambda: W.hashing_encoder(4))
        reports = sorted((json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()), key=lambda r: r["rating"])
        assert reports[0]["rating"] == "0+" and reports[0]["details"] == []
        first = reports[1]["details"][0]["per_class"]["scary"]
        assert first["episode_max"] == 0.5 and round(first["final_proba"], 6) == round(scary, 6)
    with pytest.raises(FileNotFoundError):
        pipelines.analyze_scripts(spark, str(tmp_path / "in"), str(tmp_path / "out"), None, str(tmp_path / "none"), tokens, lambda: W.hashing_encoder(4))


def test_splits_by_class(spark):
    rows = spark.createDataFrame([(i, 0 if i < 90 else 1 if i < 98 else 2 if i < 99 else None, "x") for i in range(100)], "id long, y int, train string")
    got = M.stratified_split(rows, "id", "y", out="t").groupBy("y", "t").count().collect()
    assert {(r["y"], r["t"]): r["count"] for r in got} == {(0, True): 72, (0, False): 18, (1, True): 6, (1, False): 2, (2, True): 1, (None, True): 1}
    assert M.stratified_split(rows, "id", None, out="t").where("t").count() == 80
    assert M.stratified_split(rows.where("y = 1").limit(2), "id", "y", out="t").where("t").count() == 1
    assert M.stratified_split(rows.where("false"), "id", "y", out="t").count() == 0
    two = rows.where("y IN (0, 1)")
    assert M.split_for(two.drop("train"), "id", "y", least=2).where("NOT train AND y = 1").count() == 2


def test_heads(spark):
    rows = spark.createDataFrame([([float(i % 5), float(i)], int(i > 10), i / 20) for i in range(20)], "vector array<double>, y int, s double")
    judged = M.predict(rows, M.fit_logistic(rows, "y"), "p")
    assert judged.where("(p > 0.5) = (y = 1)").count() >= 18
    assert M.fit_logistic(rows.withColumn("y", F.lit(1)), "y") == 1.0 and M.fit_ridge(rows.withColumn("s", F.lit(0.5)), "s") == 0.5
    import numpy as np

    x = np.array([[i % 5, i] for i in range(20)], float)
    y = np.arange(20) / 20
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(M.fit_ridge(rows, "s").coefficients.toArray(), want, atol=1e-9)


def test_label_extraction(spark):
    text = "1-1. ИНТ. ДОМ - НОЧЬ\nслова слова слова [Labels: v=mild]\n"
    scenes = spark.createDataFrame([("a", 1, text), ("a", 2, "просто слова без ничего тут"), ("a", 3, "ИНТ. дом")], "script_id string, scene_index int, text string")
    labels, rejects = pipelines.extract_labels(scenes)
    row = labels.where("scene_index = 1").first()
    assert (row["scene_no"], row["location"], row["tod"], row["has_violence"], row["sev_violence"]) == ("1-1", "ДОМ", "НОЧЬ", 1, "Mild")
    assert {(r["scene_index"], r["reason"]) for r in rejects.collect()} >= {(3, "no_location")}


def test_single_scene_check(spark, capsys):
    assert pipelines.check_scene(["нож и труп"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["base_age"] == "6+" and out["per_class"]["violence"]["episodes_count"] == 2 and out["override"] is None


def test_marker_scenes(spark):
    got = one(spark, G.marker_scenes(F.col("t")), t="before all this text here INT. a b c d EXT.INT. e f g h")
    assert got == ["before all this text here", "INT.  a b c d", "INT.  e f g h"]


def test_python_white_space(spark):
    assert one(spark, X.strip(F.col("t")), t="  a b  \n") == "a b" and one(spark, X.word_count(F.col("t")), t=" a b ") == 2


def test_training_programs(spark, tmp_path):
    rows = [("a", i, [float(i % 7), float(i > 30)], *(int(i > 30), "None") * 5) for i in range(60)]
    cats = ("violence", "sexual", "profanity", "alcohol_drugs", "scary")
    schema = "script_id string, scene_index int, x array<double>, " + ", ".join(f"has_{c} int, sev_{c} string" for c in cats)
    made = spark.createDataFrame(rows, schema)
    heads, judged = pipelines.train_scene_heads(made.select("script_id", "scene_index", "x"), made.drop("x"))
    assert set(heads) == set(cats) and judged["scary"].count() == 2
    scored = pipelines.apply_heads(made.select("scene_index", "x"), heads)
    assert scored.where("(proba_violence > 0.5) = (scene_index > 30)").count() == 60
    heads["sexual"] = 0.0  # what a category with one class has
    M.save_heads(spark, heads, str(tmp_path / "h"))
    loaded = M.load_heads(spark, str(tmp_path / "h"))
    assert loaded["scary"]["bin"] == M.head_of(heads["scary"]) and loaded["sexual"]["bin"] == M.Head("constant", [], 0.0)
    assert M.load_heads(spark, str(tmp_path / "none")) is None
    again = pipelines.apply_heads(made.select("scene_index", "x"), loaded)
    assert again.where("proba_sexual = 0 AND (proba_violence > 0.5) = (scene_index > 30)").count() == 60
    pipelines.write_feature_files(made.select("script_id", "scene_index", "x"), made.drop("x"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).columns == ["script_id", "scene_index", "x", *(f"has_{c}" for c in cats)]


def test_probabilities_are_the_fitted_models(spark):
    rows = spark.createDataFrame([([float(i % 5), float(i)], int(i > 10), i / 20) for i in range(20)], "vector array<double>, y int, s double")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    fed = rows.withColumn("features", array_to_vector("vector"))
    model = M.fit_logistic(rows, "y")
    p = model.transform(fed).select(vector_to_array("probability")[1].alias("p"), M.head_value(model, F.col("vector")).alias("q"))
    assert p.where("abs(p - q) > 1e-12").count() == 0
    model = M.fit_ridge(rows, "s")
    v = model.transform(fed).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("p"), M.head_value(model, F.col("vector")).alias("q"))
    assert v.where("abs(p - q) > 1e-12").count() == 0


def test_episode_training(spark, tmp_path):
    from reelgrade.sources import scripts, sinks

    rows = [(f"{'кровь нож' if i % 2 else 'сад цветы'} {i}", *[i % 2] * 4, 0, *["Mild"] * 5, *[(i % 3) / 3] * 4, 0.5) for i in range(40)] + [(None, *[0] * 5, *["None"] * 5, *[0.0] * 4, 0.5)]
    sinks.write_csv(spark.createDataFrame(rows, scripts.EPISODES_SCHEMA), str(tmp_path / "episodes"))
    tokens = lambda t: F.transform(F.split(t, " "), lambda w: (F.crc32(w) % 1000).cast("int"))
    judged = pipelines.train_episode_files(spark, str(tmp_path / "episodes"), str(tmp_path / "heads"), tokens, lambda: W.hashing_encoder(8))
    heads = M.load_heads(spark, str(tmp_path / "heads"))
    assert heads["scary"] == {"bin": M.Head("constant", [], 0.0), "sev": M.Head("constant", [], 0.5)} and heads["violence"]["sev"].kind == "ridge"
    assert judged["violence"].count() == 2 and judged["scary"].first()["accuracy"] == 1.0


def test_borders_of_fast_patterns(spark):
    words = ["половой акт", "«дать дорожку»", "a_b", "x"]
    texts = ["половой акт.", "1половой акт", "половой акты", "«дать дорожку»", "ю«дать дорожку»я", "«дать дорожку» «дать дорожку»", "a_b a_bc xa_b", "x x-x xx"]
    import re

    for w in words:
        fast, plain = X.whole_word(w), X.BORDER + X.quoted(w) + X.BORDER
        for t in texts:
            a, b = (one(spark, F.size(F.regexp_extract_all(F.col("t"), F.lit(r), F.lit(0))).cast("string"), t=t) for r in (fast, plain))
            assert a == b == str(len(re.findall(rf"\b{re.escape(w)}\b", t))), (w, t)
    assert X.starts("<b>(кайф|оргазм от)<b>") == ["кайф", "оргазм"] and X.starts("<b>(a|b)c") == [] and X.starts("<b>(еб[ао]н|x)<w>*<b>") == []


def test_tags_near_one_another(spark):
    text = "я" * 250 + "".join(f"[ep: v=mild, n{i}] и {i} " for i in range(60)) + "z" * 300
    rows = T.episode_rows(spark.createDataFrame([(1, text), (2, None)], "whole long, text string"), "whole").orderBy("tag").collect()
    import re

    starts = [m.start() for m in re.finditer(r"\[ep:", text)]
    assert [r["text"] for r in rows] == [text[max(0, at - 200) : at + 200].strip() for at in starts] and len(rows) == 60


def test_annotations_and_older_reports(spark):
    scenes = spark.createDataFrame([("a", 1, "INT. ROOM - DAY\nHe takes the knife at last")], "script_id string, scene_index int, text string")
    answers = spark.createDataFrame(
        [("a", 1, "Mild", None, "odd", None, None, [("violence", "takes the kni...", None), ("scary", "", 3)], None)],
        "script_id string, scene_index int, sev_violence string, sev_sexual string, sev_profanity string, sev_alcohol_drugs string, sev_scary string, "
        "episodes array<struct<cat:string,quote:string,offset:int>>, notes string",
    )
    row = pipelines.annotation_rows(scenes, answers).first()
    assert (row["location"], row["has_violence"], row["sev_violence"], row["has_profanity"], row["sev_profanity"], row["has_scary"]) == ("ROOM", 1, "Mild", 1, "None", 0)
    assert [e["offset"] for e in json.loads(row["episodes_json"])] == [19, 3]
    texts = spark.createDataFrame([("a", "INT. нож кровь труп тут EXT. тихий вечер в саду")], "script_id string, text string")
    report = json.loads(pipelines.presence_reports(texts).first()["report"])
    assert report["age_rating"] == "16+" and [s["violence"] for s in report["scenes"]] == ["Moderate", "None"]
