"""The engine's operators over the public tables, one query for each group of operators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions import text as X
from ..functions.values import AGES, CATEGORIES, PLACE_TYPES, SEVERITY_WORDS, TIMES_OF_DAY
from ..operators import headers as H
from ..operators import lexicon as L
from ..operators import models as M
from ..operators import normalize as N
from ..operators import rating as Q
from ..operators import segment as G
from ..operators import tags as T
from ..operators import windows as W
from ..session import spread, table
from . import fixtures as P
from .pipelines import extract_labels, extraction_summary, rate_scripts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# SQL shared by several oracles -------------------------------------------------------------------------------------

_LEX = "lex(category, ord, word, weight) AS (VALUES " + ", ".join(
    f"('{c}', {i}, '{w}', CAST({x} AS DOUBLE))" for c, i, w, x in P.LEXICON
) + ")"
_CATS = "cats(category, ci) AS (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(CATEGORIES)) + ")"
_PIECES = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"


def _hits(source: str, keys: str, limit: int = 8000) -> str:
    """CTEs scene (rid, keys, cut) and hit (rid, category, ord, off, word, weight)."""
    return f"""{_LEX}, {_CATS},
scene AS (SELECT row_number() OVER () AS rid, {keys}, text, substr(coalesce(text, ''), 1, {limit}) AS cut FROM {source}),
piece AS (SELECT rid, unnest(regexp_extract_all(lower(cut), {_PIECES})) AS w,
                 generate_subscripts(regexp_extract_all(lower(cut), {_PIECES}), 1) AS i FROM scene),
placed AS (SELECT rid, w, sum(length(w)) OVER (PARTITION BY rid ORDER BY i) - length(w) AS off FROM piece),
hit AS (SELECT rid, category, ord, CAST(off AS INTEGER) AS off, word, weight FROM placed JOIN lex ON w = word)"""


def _rated(source: str, keys: str) -> str:
    """CTEs up to rated: rid, keys, a severity rank and number of hits by category, and the age's rank."""
    ranks = ", ".join(f"max(CASE WHEN category = '{c}' THEN rank END) AS rank_{c}, max(CASE WHEN category = '{c}' THEN n END) AS n_{c}" for c in CATEGORIES)
    names = [k.split(" AS ")[-1].strip() for k in keys.split(",")]
    return f"""{_hits(source, keys)},
score AS (SELECT s.rid, c.category, count(h.word) AS n, least(1.0, ln(1 + coalesce(sum(weight), 0)) * CAST(0.25 AS DOUBLE)) AS rule
          FROM scene s CROSS JOIN cats c LEFT JOIN hit h ON h.rid = s.rid AND h.category = c.category GROUP BY ALL),
ranked AS (SELECT *, CASE WHEN CAST(0.8 AS DOUBLE) * rule < CAST(0.2 AS DOUBLE) THEN 0 WHEN CAST(0.8 AS DOUBLE) * rule < CAST(0.4 AS DOUBLE) THEN 1
                          WHEN CAST(0.8 AS DOUBLE) * rule < CAST(0.7 AS DOUBLE) THEN 2 ELSE 3 END AS rank FROM score),
wide AS (SELECT rid, {ranks} FROM ranked GROUP BY rid),
rated AS (SELECT s.rid, {', '.join('s.' + n for n in names)}, s.text, w.* EXCLUDE (rid),
          CASE WHEN rank_profanity >= 2 OR rank_sexual = 3 OR rank_violence = 3 THEN 4
               WHEN rank_violence = 2 OR rank_sexual = 2 OR rank_alcohol_drugs >= 2 THEN 3
               WHEN rank_scary IN (1, 2) THEN 2 ELSE 1 END AS age FROM scene s JOIN wide w USING (rid))"""


_AGE = "list_extract(['0+', '6+', '12+', '16+', '18+'], CAST({} AS BIGINT) + 1)"
_SEV = "list_extract(['None', 'Mild', 'Moderate', 'Severe'], CAST({} AS BIGINT) + 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.rate_scenes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), lexicon=P.LEXICON, overrides=())


# Lexicons ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_hits('documents', 'doc_id')}
SELECT s.doc_id, c.category, count(h.word) AS hits, round(coalesce(sum(h.weight), 0), 6) AS total,
       round(least(1.0, ln(1 + coalesce(sum(h.weight), 0)) * CAST(0.25 AS DOUBLE)), 6) AS rule_score
FROM scene s CROSS JOIN cats c LEFT JOIN hit h ON h.rid = s.rid AND h.category = c.category GROUP BY s.rid, s.doc_id, c.category""")
def lexicon_rule_score(spark, sf_dir):
    """Weighted hits and the rule score of every document and category."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", L.hits(F.col("text"), P.LEXICON).alias("hits"))
    row = lambda c: F.struct(
        F.lit(c).alias("category"), F.size(L.of_category(F.col("hits"), c)).cast("long").alias("hits"),
        F.round(L.total_weight(F.col("hits"), c), 6).alias("total"), F.round(R.rule_score(L.total_weight(F.col("hits"), c)), 6).alias("rule_score"),
    )
    return d.select("doc_id", F.explode(F.array(*map(row, CATEGORIES))).alias("r")).select("doc_id", "r.*")


@query(f"""WITH {_hits('documents', 'doc_id', 1_000_000_000)}
SELECT s.doc_id, {', '.join(f"count(CASE WHEN h.category = '{c}' THEN 1 END) AS {c}" for c in CATEGORIES)}
FROM scene s LEFT JOIN hit h USING (rid) GROUP BY s.rid, s.doc_id""")
def lexicon_counts_pivot(spark, sf_dir):
    """Unweighted hits in whole documents, a column for each category."""
    n = L.counts(F.col("text"), P.LEXICON)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", n.alias("n"))
    return d.select("doc_id", *(F.get("n", F.lit(i)).cast("long").alias(c) for i, c in enumerate(CATEGORIES)))


@query(f"""WITH {_hits('documents', 'doc_id')},
top AS (SELECT *, row_number() OVER (PARTITION BY rid, category ORDER BY ord, off) AS place FROM hit)
SELECT s.doc_id, t.category, CAST(t.place AS INTEGER) AS place, CAST(t.ord AS INTEGER) AS ord, t.off AS "offset", t.word AS match, t.weight,
       replace(substr(s.cut, CAST(greatest(t.off - 25, 0) + 1 AS BIGINT), CAST(t.off + length(t.word) + 25 - greatest(t.off - 25, 0) AS BIGINT)), chr(10), ' ') AS snippet
FROM top t JOIN scene s USING (rid) WHERE place <= 5""")
def trigger_snippets(spark, sf_dir):
    """The first five hits of every document and category, with their surroundings."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", L.hits(F.col("text"), P.LEXICON).alias("hits"))
    first = F.flatten(F.array(*(
        F.transform(F.slice(L.of_category(F.col("hits"), c), 1, 5), lambda h, i: F.struct((i + 1).alias("place"), h.alias("h"))) for c in CATEGORIES
    )))
    return d.select("doc_id", F.explode(first).alias("x")).select("doc_id", "x.h.category", "x.place", "x.h.ord", "x.h.offset", "x.h.match", "x.h.weight", "x.h.snippet")


def _presence_sql(source: str, keys: str) -> str:
    sums = ", ".join(
        f"{' + '.join(f'CAST(contains(low, {chr(39)}{w}{chr(39)}) AS BIGINT)' for w in ws)} AS {c}" for c, ws in P.PRESENCE.items()
    )
    return f"SELECT {keys}, {sums} FROM (SELECT *, lower(coalesce(text, '')) AS low FROM {source})"


def _presence_rank(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 WHEN {n} = 1 THEN 1 WHEN {n} <= 3 THEN 2 ELSE 3 END"


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, {c} AS \"count\", {_SEV.format(_presence_rank(c))} AS severity FROM ({_presence_sql('documents', 'doc_id')})" for c in CATEGORIES
))
def v0_presence_severity(spark, sf_dir):
    """Different words of each category anywhere in a document, and the older severity."""
    d = table(spark, sf_dir, "documents")
    rows = F.array(*(
        F.struct(F.lit(c).alias("category"), n.alias("count"), L.presence_severity(n).alias("severity")) for c, n in L.presence(F.col("text"), P.PRESENCE).items()
    ))
    return d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query(f"""SELECT conv_id, list_extract(['0+', '12+', '16+', '18+'], CAST(max(greatest({', '.join(_presence_rank(c) for c in CATEGORIES)})) AS BIGINT) + 1) AS age_rating
FROM ({_presence_sql('conversations', 'conv_id')}) GROUP BY conv_id""")
def v0_rating(spark, sf_dir):
    """The older rating of every conversation."""
    return Q.presence_rating(table(spark, sf_dir, "conversations"), "conv_id", words=P.PRESENCE)


# Ratings -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_rated('conversations', 'conv_id')} " + " UNION ALL ".join(
    f"SELECT conv_id, '{c}' AS category, round_even(100.0 * count(CASE WHEN rank_{c} > 0 THEN 1 END)::DOUBLE / greatest(count(*), 1), 2) AS percentage_scenes, "
    f"CAST(sum(n_{c}) AS BIGINT) AS episodes_total FROM rated GROUP BY conv_id" for c in CATEGORIES
))
def parents_guide(spark, sf_dir):
    """Share of scenes and number of hits of every conversation and category."""
    return Q.parents_guide(_turns(spark, sf_dir), "conv_id")


@query(f"""WITH {_rated('conversations', 'conv_id')}
SELECT conv_id, count(*) AS count_scenes, {', '.join(f"count(CASE WHEN age = {i} THEN 1 END) AS r{AGES[i][:-1]}" for i in range(1, 5))}
FROM rated GROUP BY conv_id""")
def scene_rating_hist(spark, sf_dir):
    """Scenes by age of every conversation."""
    s = Q.summarize(_turns(spark, sf_dir), "conv_id")
    return s.select("conv_id", "count_scenes", *(F.col(f"n_{i}").alias(f"r{AGES[i][:-1]}") for i in range(1, len(AGES))))


@query(f"WITH {_rated('conversations', 'conv_id')} SELECT conv_id, {_AGE.format('max(age)')} AS rating FROM rated GROUP BY conv_id")
def script_rating(spark, sf_dir):
    """The highest age of every conversation."""
    return Q.script_rating(Q.summarize(_turns(spark, sf_dir), "conv_id"), "conv_id")


def _words_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"


_OVERRIDE = """CASE WHEN list_has_any(ws, ['license', 'licensed']) THEN 'license'
     WHEN list_has_any(ws, ['token', 'api_key', 'password', 'reserved']) THEN 'secret'
     WHEN list_has_any(ws, ['und', 'der', 'die']) THEN 'language' END"""


@query(f"""WITH {_rated('documents', 'doc_id')},
over AS (SELECT *, {_OVERRIDE} AS reason FROM (SELECT *, {_words_sql('text')} AS ws FROM rated))
SELECT doc_id, {_AGE.format('age')} AS base_age, reason, CASE WHEN reason IS NOT NULL THEN '18+' ELSE {_AGE.format('age')} END AS final_age FROM over""")
def legal_override(spark, sf_dir):
    """The first rule set that a document breaks, and its age before and after."""
    d = Q.rate_scenes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), lexicon=P.LEXICON, overrides=P.OVERRIDES)
    reason = F.get(F.col("override.reasons"), F.lit(0)).alias("reason")
    return d.select("doc_id", R.age_name(F.col("base_rank")).alias("base_age"), reason, R.age_name(F.col("age_rank")).alias("final_age"))


_PROBLEM_ROWS = " UNION ALL ".join(
    f"""SELECT r.rid, r.conv_id, r.turn, {i} AS part, t.place, '{c}' AS category, {_SEV.format(f'r.rank_{c}')} AS severity,
 replace(substr(s.cut, CAST(greatest(t.off - 25, 0) + 1 AS BIGINT), CAST(t.off + length(t.word) + 25 - greatest(t.off - 25, 0) AS BIGINT)), chr(10), ' ') AS snippet,
 t.off AS "offset" FROM rated r JOIN scene s USING (rid) JOIN top t ON t.rid = r.rid AND t.category = '{c}' WHERE r.rank_{c} >= 2 AND t.place <= 5"""
    for i, c in enumerate(CATEGORIES)
)


@query(f"""WITH {_rated('conversations', 'conv_id, turn')},
top AS (SELECT *, row_number() OVER (PARTITION BY rid, category ORDER BY ord, off) AS place FROM hit),
over AS (SELECT rid, conv_id, turn, text, {_OVERRIDE} AS reason FROM (SELECT *, {_words_sql('text')} AS ws FROM rated)),
rows AS ({_PROBLEM_ROWS} UNION ALL SELECT rid, conv_id, turn, 9, 1, 'legal', 'Severe', substr(text, 1, 240), 0 FROM over WHERE reason IS NOT NULL)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY rid ORDER BY part, place) AS INTEGER) AS place, category, severity, snippet, "offset" FROM rows""")
def problems_report(spark, sf_dir):
    """What the report lists of every scene: first hits of bad categories, then the override."""
    d = Q.rate_scenes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), lexicon=P.LEXICON, overrides=P.OVERRIDES)
    rows = d.select("conv_id", "turn", F.posexplode(Q.problems(F.col("text"))).alias("i", "p"))
    return rows.select("conv_id", "turn", (F.col("i") + 1).alias("place"), "p.*")


@query(f"""WITH {_hits('documents', 'doc_id')},
one AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
score AS (SELECT s.rid, s.doc_id, c.category, least(1.0, ln(1 + coalesce(sum(weight), 0)) * CAST(0.25 AS DOUBLE)) AS rule
          FROM scene s CROSS JOIN cats c LEFT JOIN hit h ON h.rid = s.rid AND h.category = c.category GROUP BY ALL),
fused AS (SELECT s.doc_id, s.category, CAST(0.55 AS DOUBLE) * CAST(quality AS DOUBLE) + CAST(0.25 AS DOUBLE) * rule + CAST(0.2 AS DOUBLE) * CAST(toxic AS DOUBLE) AS with_model,
                 CAST(0.8 AS DOUBLE) * rule + CAST(0.2 AS DOUBLE) * CAST(toxic AS DOUBLE) AS without_model FROM score s JOIN one USING (doc_id))
SELECT doc_id, category, round(with_model, 6) AS with_model, round(without_model, 6) AS without_model,
       CASE WHEN with_model < 0.2::DOUBLE THEN 'None' WHEN with_model < 0.4::DOUBLE THEN 'Mild' WHEN with_model < 0.7::DOUBLE THEN 'Moderate' ELSE 'Severe' END AS severity_with,
       CASE WHEN without_model < 0.2::DOUBLE THEN 'None' WHEN without_model < 0.4::DOUBLE THEN 'Mild' WHEN without_model < 0.7::DOUBLE THEN 'Moderate' ELSE 'Severe' END AS severity_without
FROM fused""")
def fused_severity(spark, sf_dir):
    """Both fusions, with labels standing for the model's and the episodes' probabilities."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", L.hits(F.col("text"), P.LEXICON).alias("hits")).join(labels, "doc_id")
    model, episode = F.col("quality").cast("double"), F.col("toxic").cast("double")
    rows = []
    for c, rule in L.scores(F.col("hits")).items():
        a, b = R.fused(rule, episode, model), R.fused(rule, episode)
        rows.append(F.struct(
            F.lit(c).alias("category"), F.round(a, 6).alias("with_model"), F.round(b, 6).alias("without_model"),
            R.severity_name(R.severity_rank(a)).alias("severity_with"), R.severity_name(R.severity_rank(b)).alias("severity_without"),
        ))
    return d.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


@query()
def document_scripts(spark, sf_dir):
    """Documents as scripts with headings put before their lines: normalised, split, parsed, rated and reported, each with its whole report as JSON."""
    heading = F.concat(F.lit("1-2. INT. ROOM "), F.col("doc_id").cast("string"), F.lit(" - NIGHT\n"))
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("doc_id").cast("string").alias("script_id"), F.concat(heading, F.regexp_replace("text", "\n", "\n\nEXT. YARD - DAY\n")).alias("text")
    )
    made = rate_scripts(texts, lexicon=P.LEXICON, overrides=P.OVERRIDES)
    whole = F.to_json("report", {"ignoreNullFields": "false"})
    return made.select("script_id", F.col("report.rating").alias("rating"), F.col("report.summary.count_scenes").alias("count_scenes"), whole.alias("report"))


# Segmentation and text ---------------------------------------------------------------------------------------------

_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '')"
_COUNT = r"len(regexp_extract_all({}, '[^\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'))"


@query(f"""WITH l AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT rid, doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM l),
s AS (SELECT rid, doc_id, i, {_STRIP.format('raw')} AS text FROM p),
k AS (SELECT *, CAST({_COUNT.format('text')} AS BIGINT) AS words,
             list_has_any(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), ['the', 'de', 'la', 'und']) AS action FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY i) AS INTEGER) AS scene_index, words, text
FROM k WHERE words >= 5 OR (words >= 3 AND action)""")
def line_scenes(spark, sf_dir):
    """Lines that are long enough to be scenes, numbered."""
    d = table(spark, sf_dir, "documents")
    return G.explode_scenes(d, G.line_scenes(F.col("text"), P.VERBS), "doc_id").select("doc_id", "scene_index", X.word_count(F.col("text")).alias("words"), "text")


@query(f"""SELECT doc_id, printf('%04d: %s', doc_id, substr({_STRIP.format(r"regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')")}, 1, 180)) AS line
FROM documents""")
def preview_dump(spark, sf_dir):
    """A numbered line for each document, with the beginning of its text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("%04d: %s", "doc_id", G.preview(F.col("text"), 180)).alias("line"))


def _marked(text):
    return F.concat(F.lit("**"), F.substring(text, 1, 20), F.lit("** {.underline}\\[x\\] {.smallcaps}"), text, F.lit(" \\\\"))


_MARKED = "'**' || substr(text, 1, 20) || '** {.underline}\\[x\\] {.smallcaps}' || text || ' \\\\'"


@query(f"""SELECT doc_id,
  replace(regexp_replace(replace(replace(m, '\\[', '['), '\\]', ']'), '(?m)[ \\t]*\\\\\\\\[\\s]*$', '', 'g'), '{{.smallcaps}}', '') AS label_text,
  regexp_replace(replace(regexp_replace(m, '(?i)\\{{\\.underline\\}}', '', 'g'), '{{.smallcaps}}', ''), '\\*\\*(.*?)\\*\\*', '\\1', 'g') AS unmarked
FROM (SELECT doc_id, {_MARKED} AS m FROM documents WHERE text IS NOT NULL)""")
def markup_cleanup(spark, sf_dir):
    """Marks of text extraction removed, as for labels and as in paragraphs."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _marked(F.col("text")).alias("m"))
    return d.select("doc_id", N.clean_label_text(F.col("m")).alias("label_text"), N.replace_all(F.col("m"), N.PARAGRAPH[:3]).alias("unmarked"))


def _case_sql(x: str, mapping: dict[str, str], otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


_RAW = "list_extract(['int', 'Ext.', 'NAT', 'i/e', 'room', ''], CAST(event_id % 6 AS BIGINT) + 1)"
_RAW_TIME = "list_extract(['day', 'Night', ' evening', 'noon', ''], CAST(event_id % 5 AS BIGINT) + 1)"
_RAW_SEV = "list_extract(['mild', 'SEVERE', 'none', 'odd'], CAST(event_id % 4 AS BIGINT) + 1)"


@query(f"""SELECT event_id,
  CASE WHEN p = '' THEN '' ELSE {_case_sql("trim(replace(lower(p), '.', ''))", PLACE_TYPES, 'upper(p)')} END AS place_type,
  CASE WHEN t = '' THEN '' ELSE {_case_sql('trim(lower(t))', TIMES_OF_DAY, 'upper(t)')} END AS tod,
  {_case_sql('lower(s)', SEVERITY_WORDS, 's')} AS severity,
  CASE s WHEN 'mild' THEN 0.33::DOUBLE WHEN 'SEVERE' THEN 1.0::DOUBLE WHEN 'none' THEN 0.0::DOUBLE ELSE 0.66::DOUBLE END AS severity_number,
  {_case_sql("lower(substr(event_type, 1, 1))", {'v': 'violence', 'p': 'profanity', 's': 'sexual', 'a': 'alcohol_drugs'}, "lower(substr(event_type, 1, 1))")} AS category
FROM (SELECT event_id, event_type, {_RAW} AS p, {_RAW_TIME} AS t, {_RAW_SEV} AS s FROM events)""")
def canonical_maps(spark, sf_dir):
    """Place types, times of day, severities and categories in one form."""
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs)).cast("int"))
    e = table(spark, sf_dir, "events")
    s = pick(["mild", "SEVERE", "none", "odd"])
    return e.select(
        "event_id",
        H.place_type(pick(["int", "Ext.", "NAT", "i/e", "room", ""])).alias("place_type"),
        H.time_of_day(pick(["day", "Night", " evening", "noon", ""])).alias("tod"),
        T.severity_word(s, s).alias("severity"),
        T.severity_number(s).alias("severity_number"),
        T.category_of(F.substring("event_type", 1, 1)).alias("category"),
    )


@query(r"""SELECT p_partkey,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '' ELSE regexp_extract(p_brand, '[0-9]+') END AS scene_no, '' AS period,
  CASE p_partkey % 3 WHEN 1 THEN 'EXT.' ELSE 'INT.' END AS place_type,
  CASE WHEN p_partkey % 3 = 2 THEN '' ELSE upper(p_brand) END AS location, CASE p_partkey % 3 WHEN 0 THEN 'ДЕНЬ' WHEN 1 THEN 'НОЧЬ' ELSE '' END AS tod
FROM (SELECT p_partkey, replace(replace(p_brand, '#', ' '), '-', ' ') AS p_brand FROM part)""")
def header_forms(spark, sf_dir):
    """Headings of all parts in three forms (numbered with dots; with a dash; without a time, so that the heuristic takes the number as the scene's) parsed into their parts."""
    place = F.upper(F.translate("p_brand", "#-", "  "))
    form = F.col("p_partkey") % 3
    line = F.when(form == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". int. "), place, F.lit(". DAY")))
    line = line.when(form == 1, F.concat(F.lit("EXT. "), place, F.lit(" - night 2"))).otherwise(F.concat(F.lit("int. "), place))
    return table(spark, sf_dir, "part").select("p_partkey", H.parse_header(line).alias("h")).select("p_partkey", "h.*")


# Tags --------------------------------------------------------------------------------------------------------------

_TAGGED = """'a [ep: v=' || s || ', cat=' || c || ', sev=Mild, x] b [EP : p=' || s || '] ' || coalesce(props, '')"""
_TAG_SOURCE = """SELECT event_id, props, list_extract(['Severe', 'mild', 'odd', 'Moderate'], CAST(event_id % 4 AS BIGINT) + 1) AS s,
  list_extract(['v', 'scary', 'sc', 'zz'], CAST((event_id // 4) % 4 AS BIGINT) + 1) AS c FROM events"""


def _tagged(spark, sf_dir):
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    s = pick(["Severe", "mild", "odd", "Moderate"], F.col("event_id") % 4)
    c = pick(["v", "scary", "sc", "zz"], F.floor(F.col("event_id") / 4) % 4)
    text = F.concat(F.lit("a [ep: v="), s, F.lit(", cat="), c, F.lit(", sev=Mild, x] b [EP : p="), s, F.lit("] "), F.coalesce("props", F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"))


_SNUM = "CASE s WHEN 'Severe' THEN 1.0::DOUBLE WHEN 'mild' THEN 0.33::DOUBLE ELSE 0.66::DOUBLE END"


@query(f"""SELECT event_id, CASE WHEN c = 'v' THEN greatest({_SNUM}, 0.33::DOUBLE) ELSE {_SNUM} END AS max_violence, 0.0::DOUBLE AS max_sexual, {_SNUM} AS max_profanity,
  0.0::DOUBLE AS max_alcohol_drugs, CASE WHEN c IN ('scary', 'sc') THEN 0.33::DOUBLE ELSE 0.0::DOUBLE END AS max_scary,
  CASE WHEN c = 'v' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS count_violence, 0.0::DOUBLE AS count_sexual, 1.0::DOUBLE AS count_profanity,
  0.0::DOUBLE AS count_alcohol_drugs, CASE WHEN c IN ('scary', 'sc') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS count_scary
FROM ({_TAG_SOURCE})""")
def kv_tag_features(spark, sf_dir):
    """Largest severity and number of tags by category."""
    d = _tagged(spark, sf_dir).select("event_id", T.episode_features(F.col("text")).alias("f"))
    names = [f"max_{c}" for c in CATEGORIES] + [f"count_{c}" for c in CATEGORIES]
    return d.select("event_id", *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


_SWORD = "CASE s WHEN 'mild' THEN 'Mild' WHEN 'odd' THEN 'Odd' ELSE s END"
_SNULL = "CASE s WHEN 'Severe' THEN 1.0::DOUBLE WHEN 'mild' THEN 0.33::DOUBLE WHEN 'Moderate' THEN 0.66::DOUBLE END"


@query(f"""WITH t AS (SELECT *, {_TAGGED} AS m FROM ({_TAG_SOURCE}))
SELECT event_id, 0 AS tag, trim(substr(m, 1, 202)) AS text, 1 AS violence, 0 AS sexual, 0 AS profanity, 0 AS alcohol_drugs,
  CASE WHEN c IN ('scary', 'sc') THEN 1 ELSE 0 END AS scary,
  CASE WHEN c = 'v' THEN 'Mild' ELSE {_SWORD} END AS sev_violence, 'None' AS sev_sexual, 'None' AS sev_profanity, 'None' AS sev_alcohol_drugs,
  CASE WHEN c IN ('scary', 'sc') THEN 'Mild' ELSE 'None' END AS sev_scary,
  CASE WHEN c = 'v' THEN 0.33::DOUBLE ELSE {_SNULL} END AS sev_violence_num, 0.0::DOUBLE AS sev_sexual_num, 0.0::DOUBLE AS sev_profanity_num,
  0.0::DOUBLE AS sev_alcohol_drugs_num, CASE WHEN c IN ('scary', 'sc') THEN 0.33::DOUBLE ELSE 0.0::DOUBLE END AS sev_scary_num FROM t
UNION ALL
SELECT event_id, 1, trim(substr(m, 1, CAST(instr(m, '[EP') - 1 + 200 AS BIGINT))), 0, 0, 1, 0, 0, 'None', 'None', {_SWORD}, 'None', 'None',
  0.0::DOUBLE, 0.0::DOUBLE, {_SNULL}, 0.0::DOUBLE, 0.0::DOUBLE FROM t""")
def kv_tag_rows(spark, sf_dir):
    """One row per tag, with its surroundings, flags and severities."""
    return T.episode_rows(_tagged(spark, sf_dir), "event_id")


def _labelled(spark, sf_dir):
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    tag = F.concat(F.lit("[Labels: v="), pick(["severe", "none", "Odd"], F.col("event_id") % 3), F.lit(", P = mild, zz=mild]"))
    text = F.when(F.col("event_id") % 4 == 0, F.lit("plain words only")).otherwise(F.concat(F.lit("INT. ROOM - DAY\nx "), tag))
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("script_id"), F.lit(1).alias("scene_index"), text.alias("text"))


@query("""SELECT CAST(event_id AS VARCHAR) AS script_id, 1 AS scene_index, '' AS scene_no, 'INT.' AS place_type, 'ROOM' AS location, 'ДЕНЬ' AS tod,
  CASE WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS has_violence, CASE event_id % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN 'None' ELSE 'Odd' END AS sev_violence,
  0 AS has_sexual, 'None' AS sev_sexual, 1 AS has_profanity, 'Mild' AS sev_profanity, 0 AS has_alcohol_drugs, 'None' AS sev_alcohol_drugs, 0 AS has_scary, 'None' AS sev_scary
FROM events WHERE event_id % 4 <> 0""")
def label_tag_flags(spark, sf_dir):
    """Label rows of scenes that have a heading or labels."""
    return extract_labels(_labelled(spark, sf_dir))[0]


@query("SELECT CAST(event_id AS VARCHAR) AS script_id, 1 AS scene_index, 'skipped' AS reason, 'plain words only' AS line, 'plain words only' AS strict FROM events WHERE event_id % 4 = 0")
def rejects(spark, sf_dir):
    """Scenes without heading and labels."""
    return extract_labels(_labelled(spark, sf_dir))[1]


@query("""SELECT count(*) AS cut, count(CASE WHEN event_id % 4 <> 0 THEN 1 END) AS written, count(CASE WHEN event_id % 4 = 0 THEN 1 END) AS skipped FROM events""")
def extraction_counts(spark, sf_dir):
    """Scenes cut, written and skipped."""
    return extraction_summary(_labelled(spark, sf_dir))


@query("""SELECT p_partkey, p_size % 5 AS headings, p_size % 5 AS scenes, 0 AS missing FROM part""")
def split_diagnostics(spark, sf_dir):
    """Headings counted against scenes split, of scripts with none to four."""
    text = F.expr("repeat('INT. ROOM - DAY\nfive words are in here\n', p_size % 5)")
    d = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    n, m = F.size(G.counted_headings(F.col("text"))), F.size(G.older_scenes(F.col("text")))
    return d.select("p_partkey", n.alias("headings"), m.alias("scenes"), F.greatest(n - m, F.lit(0)).alias("missing"))


@query("""SELECT p_partkey, '3. INT. ' || b || ' - NIGHT' AS dashed, 'EXT. ' || b || ' - DAY' AS bare, '3. INT. ' || b || ' - DAY' || chr(10) || 'x' AS whole
FROM (SELECT p_partkey, upper(replace(p_brand, '#', ' ')) AS b FROM part)""")
def heading_forms(spark, sf_dir):
    """Headings in their strict form, and a script's headings in one form."""
    b = F.upper(F.translate("p_brand", "#", " "))
    d = table(spark, sf_dir, "part").select("p_partkey", b.alias("b"))
    line = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    return d.select(
        "p_partkey",
        N.normalize_heading(line("3. int - ", F.col("b"), ": night"), compose=False).alias("dashed"),
        N.normalize_heading(line("ext. ", F.col("b"), "  —  day."), compose=False).alias("bare"),
        N.normalize_headings(line("3. INT ", F.col("b"), ". DAY.   \nx"), compose=False).alias("whole"),
    )


@query("""SELECT event_id, CAST(CASE WHEN instr(t, substr(q, 1, 12)) > 0 THEN instr(t, substr(q, 1, 12)) - 1 ELSE 7 END AS INTEGER) AS quote_offset,
  '[{"cat":"scary","offset":' || CASE WHEN instr(t, substr(q, 1, 12)) > 0 THEN instr(t, substr(q, 1, 12)) - 1 ELSE 7 END || '}]' AS episodes_json
FROM (SELECT event_id, 'type ' || event_type || ' of an event' AS t, event_type || ' of an evening' AS q FROM events)""")
def annotation_offsets(spark, sf_dir):
    """Where annotators' quotes begin, and the episodes' JSON."""
    t, q = F.concat(F.lit("type "), F.col("event_type"), F.lit(" of an event")), F.concat(F.col("event_type"), F.lit(" of an evening"))
    at = T.quote_offset(t, q, F.lit(7))
    return table(spark, sf_dir, "events").select(
        "event_id", at.alias("quote_offset"), F.to_json(F.array(F.struct(F.lit("scary").alias("cat"), at.alias("offset")))).alias("episodes_json")
    )


# Windows and vectors -----------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ts FROM documents),
s AS (SELECT doc_id, ts, CASE WHEN len(ts) <= 256 THEN [0] ELSE list_sort(list_distinct(list_append(generate_series(0, len(ts) - 256, 224), len(ts) - 256))) END AS starts FROM d),
e AS (SELECT doc_id, ts, unnest(starts[1:16]) AS start, generate_subscripts(starts[1:16], 1) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS "window", CAST(start AS INTEGER) AS start, CAST(len(ts[start + 1:start + 256]) AS INTEGER) AS n_tokens,
       coalesce(ts[start + 1], '') AS first_token FROM e""")
def token_windows(spark, sf_dir):
    """Episode windows over the words of documents: where they start, and what with."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("ts")).select("doc_id", F.posexplode(G.episode_windows(F.col("ts"))).alias("window", "w"))
    return d.select("doc_id", "window", "w.start", F.size("w.tokens").alias("n_tokens"), F.coalesce(F.get("w.tokens", F.lit(0)), F.lit("")).alias("first_token"))


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE)) DESC, vec_id DESC) AS place FROM embeddings),
t AS (SELECT x.label, pos, avg(v) AS m FROM x JOIN n USING (label, vec_id) WHERE place <= 3 GROUP BY ALL)
SELECT x.label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS mean, round(max(v), 6) AS max, round(any_value(t.m), 6) AS top_mean
FROM x JOIN t USING (label, pos) GROUP BY x.label, pos""")
def embedding_window_agg(spark, sf_dir):
    """Mean, max and top mean of the vectors of each label."""
    rows = W.aggregate_windows(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return rows.select("label", "pos", *(F.round(c, 6).alias(c) for c in ("mean", "max", "top_mean")))


def _heads(width: int = 64) -> dict:
    return {c: P.head(width, i) for i, c in enumerate(CATEGORIES)}


def _dot_sql(weights: list[float]) -> str:
    return f"list_sum(list_transform(list_zip(embedding, [{', '.join(map(str, weights))}]), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


_SCORED = " UNION ALL ".join(
    f"SELECT label, vec_id, '{c}' AS category, 1.0 / (1.0 + exp(-({_dot_sql(w)} + {b}::DOUBLE))) AS bin, least(1.0, greatest(0.0, {_dot_sql(u)} + {v}::DOUBLE)) AS sev FROM embeddings"
    for c, (w, b, u, v) in ((c, (*h["bin"][1:], *h["sev"][1:])) for c, h in _heads().items())
)


@query(f"""WITH s AS ({_SCORED}),
r AS (SELECT *, row_number() OVER (PARTITION BY label, category ORDER BY bin DESC) AS pb, row_number() OVER (PARTITION BY label, category ORDER BY sev DESC) AS ps FROM s)
SELECT label, category, round(max(bin), 6) AS bin_max, round(avg(bin), 6) AS bin_mean, round(avg(CASE WHEN pb <= 3 THEN bin END), 6) AS bin_top,
       round(max(sev), 6) AS sev_max, round(avg(sev), 6) AS sev_mean, round(avg(CASE WHEN ps <= 3 THEN sev END), 6) AS sev_top FROM r GROUP BY label, category""")
def episode_aggregates(spark, sf_dir):
    """Episode features of each label from fixed heads."""
    scored = W.linear_scores(table(spark, sf_dir, "embeddings"), "embedding", _heads())
    rows = W.episode_aggregates(scored, "label")
    return rows.select("label", "category", *(F.round(f"{n}_{k}", 6).alias(f"{n}_{k}") for n in ("bin", "sev") for k in ("max", "mean", "top")))


@query("SELECT doc_id, sha1(coalesce(text, '') || '|384|320') AS key FROM documents")
def cache_key(spark, sf_dir):
    """The keys of documents' cached vectors."""
    return table(spark, sf_dir, "documents").select("doc_id", W.cache_key(F.col("text"), 384, 320).alias("key"))


# Alignment, splits, models -----------------------------------------------------------------------------------------


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'aligned' END AS state, l.quality
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)""")
def ordinal_alignment(spark, sf_dir):
    """Documents and labels by key, those without labels told apart."""
    d = table(spark, sf_dir, "documents").select("doc_id").distinct()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct().withColumn("there", F.lit(True))
    state = F.when(F.col("there"), "aligned").otherwise("unlabelled")
    return d.join(labels, "doc_id", "left").select("doc_id", state.alias("state"), "quality")


_HASH = "('0x' || substr(md5(doc_id || '|42'), 1, 8))::BIGINT"


@query(f"SELECT doc_id, quality, {_HASH} < 3435973836 AS train FROM labels")
def hashed_split(spark, sf_dir):
    """Which labelled documents are for training, by their hash alone."""
    return table(spark, sf_dir, "labels").select("doc_id", "quality", M.in_training(F.col("doc_id")).alias("train"))


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_HASH}, doc_id) AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, place <= CASE WHEN n > 1 THEN least(n - 1, greatest(1, floor(n * 0.8::DOUBLE + 0.5))) ELSE 1 END AS train FROM r""")
def stratified_split(spark, sf_dir):
    """Which labelled documents are for training: four fifths of each class."""
    return M.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality").select("doc_id", "quality", "train")


@query("""WITH x AS (SELECT 'quality' AS label, quality AS y, doc_id FROM labels UNION ALL SELECT 'toxic', toxic, doc_id FROM labels UNION ALL SELECT 'first', CASE WHEN doc_id = 0 THEN 1 ELSE 0 END, doc_id FROM labels),
c AS (SELECT label, CAST(y AS INTEGER) AS y, count(*) AS n FROM x GROUP BY ALL)
SELECT label, count(*) AS classes, min(n) AS least, count(*) = 2 AND min(n) >= 2 AS balanced FROM c GROUP BY label""")
def balance_tests(spark, sf_dir):
    """Whether labels have two classes of two rows at least; one that a single row has is among them."""
    rows = table(spark, sf_dir, "labels").withColumn("first", (F.col("doc_id") == 0).cast("int"))
    made = [M.balance_test(rows, c).select(F.lit(c).alias("label"), "classes", "least", "balanced") for c in ("quality", "toxic", "first")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("SELECT CAST(quality AS INTEGER) AS label, count(*) AS n FROM labels GROUP BY quality")
def class_balance(spark, sf_dir):
    """Labels by class."""
    return M.class_balance(table(spark, sf_dir, "labels"), "quality")


@query("""WITH c AS (SELECT quality AS y, toxic AS p FROM labels), k(class) AS (VALUES (0), (1)),
s AS (SELECT class, count(CASE WHEN y = class AND p = class THEN 1 END) AS tp, count(CASE WHEN p = class THEN 1 END) AS chosen, count(CASE WHEN y = class THEN 1 END) AS support FROM c, k GROUP BY class),
r AS (SELECT class, support, CASE WHEN chosen > 0 THEN tp::DOUBLE / chosen ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, support FROM r""")
def class_metrics(spark, sf_dir):
    """Precision, recall and F1 of one label as a guess of the other."""
    m = M.metrics(table(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("""SELECT (SELECT min(toxic) FROM labels WHERE toxic = 0) AS class, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
  round((SELECT avg(toxic::DOUBLE) FROM labels WHERE quality = 1), 6) AS positive_rate_train FROM labels WHERE toxic = 0""")
def one_class_metrics(spark, sf_dir):
    """Accuracy and the training rows' positive rate, where the rows held out have one class."""
    rows = table(spark, sf_dir, "labels")
    made = M.report(rows.where("quality = 1"), rows.where("toxic = 0"), "toxic", "quality")
    return made.select("class", F.round("accuracy", 6).alias("accuracy"), F.round("positive_rate_train", 6).alias("positive_rate_train"))


@query()
def ridge_fit(spark, sf_dir):
    """Coefficients of a ridge regression of labels on vectors."""
    rows = table(spark, sf_dir, "embeddings").select("embedding", (F.col("label") % 4 / 3.0).alias("y"))
    model = M.fit_ridge(rows, "y", "embedding")
    values = [(i, float(v)) for i, v in enumerate([model.intercept, *model.coefficients])]
    return spark.createDataFrame(values, "place int, value double")


@query()
def logreg_metrics(spark, sf_dir):
    """Metrics, on the rows held out, of a balanced classifier of one label against the others."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))
    rows = rows.withColumn("train", M.in_training(F.col("vec_id")))
    model = M.fit_logistic(rows.where("train"), "y", "embedding")
    judged = M.predict(rows.where("NOT train"), model, "p", "embedding").withColumn("guess", (F.col("p") > 0.5).cast("int"))
    return M.metrics(judged, "y", "guess")
