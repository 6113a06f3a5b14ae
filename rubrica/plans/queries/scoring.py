"""Queries of the rules, the judge and the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.functions import scalars as S
from rubrica.operators import judge, levels, rules, score
from rubrica.plans import bind, pipeline
from rubrica.plans.queries import BODY, GREEDY, IMG, ORACLES, QUERIES, c, documents, query, reported, sub
from rubrica.plans.queries.mapping import YEAR, misfit
from rubrica.plans.staging import numbered, stage

FOUND = f"regexp_matches(lower(text), '{'|'.join(bind.WORDS)}')"
EMPTY = "coalesce(blank, true)"
# Points of each rule for rows whose files exist, then of each group.
PARTS = f"""v AS (SELECT *, NOT has_pdf AS no_pdf, n_images = 0 AS no_images, {EMPTY} AS empty FROM u {BODY}),
r AS (SELECT *, CASE WHEN event_theme <> '' AND id % 3 <> 1 THEN 10 ELSE 0 END AS p1, CASE WHEN lvl IS NOT NULL THEN 11 ELSE 0 END AS p2, CASE WHEN parts > 15 THEN 12 ELSE 0 END AS p3,
  CASE WHEN NOT empty AND id % 2 = 0 THEN 7 ELSE 0 END AS p5, CASE WHEN NOT empty AND (id % 3 = 0 OR found) THEN 7 ELSE 0 END AS p6, CASE WHEN NOT empty AND id % 5 = 0 THEN 3 ELSE 0 END AS p7,
  CASE WHEN NOT empty AND id % 7 = 0 THEN 3 ELSE 0 END AS p8, CASE WHEN NOT empty AND id % 8 <> 0 THEN 5 ELSE 0 END AS p9,
  CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS p11, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END AS p12, CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS p13, CASE WHEN id % 7 = 0 THEN 4 ELSE 0 END AS p14 FROM v),
z AS (SELECT *, p1 + p2 + p3 AS theme_p, CASE WHEN has_pdf THEN p5 + p6 + p7 + p8 + p9 ELSE 0 END AS pdf_p, CASE WHEN n_images > 0 THEN p11 + p12 + p13 + p14 ELSE 0 END AS image_p FROM r)"""
TOTAL = f"""{PARTS},
y AS (SELECT z.*, dups.said AS dup, CASE WHEN dups.said IS NULL THEN 15 ELSE 0 END AS p15 FROM z LEFT JOIN dups USING (id)),
x AS (SELECT *, CASE WHEN broken THEN 0 ELSE theme_p + pdf_p + image_p + p15 END AS score,
  CASE WHEN broken THEN 'Error' WHEN no_pdf OR no_images THEN 'Reopen' WHEN theme_p + pdf_p + image_p + p15 >= 60 THEN 'Accepted' ELSE 'Rejected' END AS status FROM y)"""
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id, {r.ord} AS ord, '{r.category}' AS category, '{r.criterion}' AS criterion, p{r.ord} AS points, p{r.ord} > 0 AS passed FROM x WHERE NOT broken"
    + {"pdf": " AND has_pdf", "image": " AND NOT no_images"}.get(r.category, "")
    for r in rules.RULES if r.ord not in (4, 10)
) + " UNION ALL SELECT id, 16, 'pdf', 'PDF Validation', 0, false FROM x WHERE NOT broken AND no_pdf UNION ALL SELECT id, 17, 'image', 'Image Validation', 0, false FROM x WHERE NOT broken AND no_images)"
LEVEL = "CASE WHEN h IS NULL OR h = 0 THEN 'Duration missing/invalid. Duration: ' || duration ELSE 'Level missing and cannot be determined from duration ' || CAST(h AS VARCHAR) || 'h' END"
WHY = {
    1: f"CASE WHEN event_theme = '' THEN '{rules.NO_THEME}' ELSE {misfit(rules.NOT_ALIGNED)} END", 2: LEVEL, 3: "'Participants reported: ' || parts || ' (needs > 15)'",
    5: "'PDF title does not match expected: ' || title", 6: f"'{rules.NO_EXPERT}'", 7: f"'{rules.OUTCOMES_DIFFER}'", 8: f"'{rules.OBJECTIVES_DIFFER}'", 9: f"'{rules.PDF_FEW}'",
    11: f"'{rules.NO_BANNER}'", 12: f"'{rules.NO_EVENT}'", 13: "'Event mode in image does not match specified mode: ' || lower(session_type)", 14: f"'{rules.IMAGE_FEW}'", 15: "'Duplicate Check: ' || dup",
}


def failed(r: rules.Rule) -> str:
    why = f"CASE WHEN empty THEN '{rules.NO_TEXT}' ELSE {WHY[r.ord]} END" if r.category == "pdf" else WHY[r.ord]
    there = {"pdf": "has_pdf AND ", "image": "NOT no_images AND "}.get(r.category, "")
    return f"CASE WHEN {there}p{r.ord} = 0 THEN '{r.criterion}: ' || {why} END"


MISSING = {9: "CASE WHEN no_pdf THEN 'PDF Validation: PDF file missing or could not be downloaded' END", 14: "CASE WHEN no_images THEN 'Image Validation: Event photos missing or invalid' END"}
PIECES = ", ".join(x for r in rules.RULES if r.ord not in (4, 10) for x in (failed(r), *([MISSING[r.ord]] if r.ord in MISSING else [])))
UNMET = f"CASE WHEN broken THEN 'Processing error: ''float'' object has no attribute ''strip''' ELSE concat_ws('; ', {PIECES}) END"


def scored(name: str, oracle: str):
    """Register fn(scored submissions); the oracle reads x, their SQL twin."""

    def keep(fn):
        QUERIES[name] = lambda spark, d: fn(pipeline.scored(bind.complete(spark, d)))
        ORACLES[name] = f"{GREEDY}, {TOTAL}{'' if oracle.startswith(',') else ' '}{oracle}"
        return fn

    return keep


# --- rules ---


def outcome(d: DataFrame, o: rules.Outcome) -> DataFrame:
    return score.held(d, [o]).select("id", c(f"ok_{o.rule.ord}").alias("passed"), c(f"why_{o.rule.ord}").alias("message"))


@sub("rule_theme", f"SELECT id, event_theme <> '' AND id % 3 <> 1 AS passed, CASE WHEN event_theme <> '' AND id % 3 <> 1 THEN '' ELSE {WHY[1]} END AS message FROM u")
def rule_theme(d: DataFrame) -> DataFrame:
    d = d.withColumn("expected", S.expected_title(c("canonical"), c("m_type"), c("m_theme"), c("m_title")))
    why = S.title_message(c("canonical"), c("expected"), c("m_title"), F.lit(rules.NOT_ALIGNED))
    empty = F.struct(F.lit(True).alias("passed"), F.lit("").alias("message"))
    return outcome(d, rules.theme_outcomes(c("m_theme"), judge.says_yes(c("theme_answer")), why, empty, c("m_participants"), F.lit(True))[0])


REACH = "CASE event_driven WHEN 1 THEN '2-4 hours' WHEN 2 THEN '5-8 hours' WHEN 3 THEN '9-18 hours' ELSE '19+ hours' END"


@sub(
    "rule_level",
    f"""SELECT id, CASE WHEN h IS NULL OR h = 0 THEN false WHEN kind = 0 THEN lvl IS NOT NULL WHEN kind IN (1, 2) THEN false ELSE lvl IS NOT NULL END AS passed,
  CASE WHEN h IS NULL OR h = 0 THEN 'Duration missing/invalid. Duration: ' || duration
    WHEN kind = 0 AND lvl IS NULL THEN 'Level missing and cannot be determined from duration ' || h || 'h'
    WHEN kind = 0 THEN 'Level auto-determined as ' || lvl || ' based on duration ' || h || 'h'
    WHEN kind = 1 THEN 'Invalid level format: x' || id WHEN kind = 2 THEN 'Invalid level: ' || id || '. Valid levels are 1-4.' WHEN lvl = event_driven THEN ''
    WHEN lvl IS NULL THEN 'Duration ' || h || 'h does not match Level ' || event_driven || ' requirements (' || {REACH} || ')'
    ELSE 'Level auto-corrected from ' || event_driven || ' to ' || lvl || ' based on duration ' || h || 'h' END AS message
FROM (SELECT *, CASE WHEN id % 7 IN (1, 2) AND id > 4 THEN id % 7 WHEN event_driven BETWEEN 1 AND 4 AND id % 7 > 2 THEN 3 ELSE 0 END AS kind FROM u)""",
)
def rule_level(d: DataFrame) -> DataFrame:
    """Levels of every kind: none, no number, out of range, and ones that fit the hours or do not."""
    k, own = c("id") % 7, c("id").cast("string")
    given = F.when((k == 1) & (c("id") > 4), F.concat(F.lit("x"), own)).when((k == 2) & (c("id") > 4), own).when(c("driven").between(1, 4) & (k > 2), c("driven").cast("string")).otherwise("")
    d = d.withColumn("parsed", levels.parse_hours(c("m_duration")))
    return d.withColumn("r", rules.level_rule(c("m_duration"), c("parsed"), given)).select("id", "r.passed", "r.message")


@sub("rule_participants", "SELECT id, parts > 15 AS passed FROM u")
def rule_participants(d: DataFrame) -> DataFrame:
    return d.select("id", rules.participants_ok(c("m_participants")).alias("passed"))


FINANCIAL = f"CASE WHEN id % 2 = 0 AND CAST(str_split(from_date, '/')[1] AS INT) < 4 THEN {YEAR} - 1 ELSE {YEAR} END"


@sub(
    "rule_year",
    f"""SELECT id, id % 10 > 1 AND abs(fy - 1996) <= 1 AS passed, CASE WHEN id % 10 = 0 THEN 'Event Date missing' WHEN id % 10 = 1 THEN 'Invalid event date format: soon' WHEN abs(fy - 1996) <= 1 THEN ''
  ELSE CASE WHEN id % 2 = 0 THEN 'Financial year ' ELSE 'Academic year ' END || fy || ' does not align with current year 1996' END AS message FROM (SELECT *, {FINANCIAL} AS fy FROM u)""",
)
def rule_year(d: DataFrame) -> DataFrame:
    given = F.when(c("id") % 10 == 0, "").when(c("id") % 10 == 1, "soon").otherwise(c("m_date"))
    return d.withColumn("r", rules.year_rule(given, c("m_year_type"), 1996)).select("id", "r.passed", "r.message")


def pdf_results(d: DataFrame) -> DataFrame:
    verdict = judge.verdict(c("pdf_answer"), judge.PDF_KEYS)
    outcomes = rules.pdf_outcomes(c("has_pdf"), c("pdf_empty"), c("pdf_expert"), verdict, c("m_title"), F.lit(True))
    return score.held(d, outcomes).withColumn("points", score.total(outcomes))


@reported("rule_pdf", f", {PARTS} SELECT id, CAST(pdf_p AS INT) AS points FROM z")
def rule_pdf(d: DataFrame) -> DataFrame:
    return pdf_results(d).select("id", "points")


@reported("rule_pdf_empty", f"SELECT id, blank AS failed FROM u {BODY} WHERE has_pdf")
def rule_pdf_empty(d: DataFrame) -> DataFrame:
    return pdf_results(d.where("has_pdf")).select("id", (c("why_7") == rules.NO_TEXT).alias("failed"))


@documents("rule_expert_keywords", f"SELECT doc_id, {FOUND} AS passed FROM documents")
def rule_expert_keywords(d: DataFrame) -> DataFrame:
    return pipeline.report_features(d.select("doc_id", "text"), words=bind.WORDS).select("doc_id", c("pdf_expert").alias("passed"))


@sub("rule_image", "SELECT id, CASE WHEN n_images > 0 THEN CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 4 ELSE 0 END ELSE 0 END AS points FROM u")
def rule_image(d: DataFrame) -> DataFrame:
    outcomes = rules.image_outcomes(c("n_images") > 0, judge.verdict(c("image_answer"), judge.IMAGE_KEYS), c("m_mode"), F.lit(True))
    return score.held(d, outcomes).select("id", score.total(outcomes).alias("points"))


@query("geotag_any", f"{IMG} SELECT submission, bool_or(file % 3 = 0) AS geotag FROM i GROUP BY submission")
def geotag_any(spark: SparkSession, d: str) -> DataFrame:
    held = bind.images(spark, d).groupBy("submission").agg(F.collect_list(F.struct("has_geotag")).alias("x"))  # two photos at most
    return held.select("submission", rules.geotag_any(c("x")).alias("geotag"))


@reported("missing_assets", "SELECT id, CASE WHEN NOT has_pdf THEN 'PDF Validation: PDF file missing or could not be downloaded' ELSE '' END AS no_pdf, CASE WHEN n_images = 0 THEN 'Image Validation: Event photos missing or invalid' ELSE '' END AS no_images FROM u")
def missing_assets(d: DataFrame) -> DataFrame:
    """What stands for a group whose file is missing."""
    pdf = rules.pdf_outcomes(c("has_pdf"), c("pdf_empty"), c("pdf_expert"), judge.verdict(c("pdf_answer"), judge.PDF_KEYS), c("m_title"), F.lit(True))[-1:]
    image = rules.image_outcomes(c("n_images") > 0, judge.verdict(c("image_answer"), judge.IMAGE_KEYS), c("m_mode"), F.lit(True))[-1:]
    held = score.held(d, [*pdf, *image])
    return held.select("id", score.unmet(pdf).alias("no_pdf"), score.unmet(image).alias("no_images"))


HEURISTIC = "CASE WHEN found THEN 7 ELSE 0 END + CASE WHEN n_images > 0 THEN 2 ELSE 0 END + CASE WHEN parts > 15 THEN 12 ELSE 0 END + CASE WHEN lvl IS NOT NULL THEN 11 ELSE 0 END + CASE WHEN event_theme <> '' AND benefit_learning <> '' THEN 5 ELSE 0 END"


@reported("heuristic_score", f"SELECT id, CAST({HEURISTIC} AS INT) AS heuristic FROM u {BODY}")
def heuristic_score(d: DataFrame) -> DataFrame:
    return d.select("id", pipeline.heuristic(d).alias("heuristic"))


# --- scores ---


@scored("overall_score", "SELECT id, CAST(score AS INT) AS score FROM x")
def overall_score(d: DataFrame) -> DataFrame:
    return d.select("id", "score")


@scored("status", "SELECT id, CAST(score AS INT) AS score, status FROM x")
def status(d: DataFrame) -> DataFrame:
    return d.select("id", "score", "status")


@scored("rules_long", f", {LONG} SELECT id, CAST(ord AS INT) AS ord, category, criterion, CAST(points AS INT) AS points, passed FROM long")
def rules_long(d: DataFrame) -> DataFrame:
    return pipeline.long(d).drop("message")


@scored("rules_union", f", {LONG} SELECT x.id, count(long.id) AS n, coalesce(sum(CAST(NOT passed AS INT)), 0) AS n_failed FROM x LEFT JOIN long USING (id) GROUP BY x.id")
def rules_union(d: DataFrame) -> DataFrame:
    return d.select("id", F.size("results").cast("long").alias("n"), F.size(F.filter("results", lambda r: ~r["passed"])).cast("long").alias("n_failed"))


@scored("category_breakdown", f", {LONG} SELECT id, category, sum(points) AS points, count(*) FILTER (passed) AS n_passed, count(*) AS n_rules FROM long GROUP BY id, category")
def category_breakdown(d: DataFrame) -> DataFrame:
    return score.breakdown(pipeline.long(d))


@scored("score_rollup", f", {LONG} SELECT category, criterion, sum(points) AS points, count(*) FILTER (passed) AS n_passed FROM long GROUP BY ROLLUP (category, criterion)")
def score_rollup(d: DataFrame) -> DataFrame:
    return score.rollup(pipeline.long(d))


@scored("batch_summary", "SELECT count(*) AS total, count(*) FILTER (status = 'Accepted') AS accepted, count(*) FILTER (status = 'Rejected') AS rejected, count(*) FILTER (status = 'Reopen') AS reopen, count(*) FILTER (status = 'Error') AS errors, avg(score) AS mean_score FROM x")
def batch_summary(d: DataFrame) -> DataFrame:
    return score.summary(d.withColumn("score", c("score").cast("string")))


@scored("requirements_not_met", f"SELECT id, {UNMET} AS unmet FROM x")
def requirements_not_met(d: DataFrame) -> DataFrame:
    return d.select("id", "unmet")


RAW = "id, event_driven, activity_name, session_type"


@scored("enriched_output", f"SELECT {RAW}, CAST(score AS INT) AS \"Overall Score\", status AS \"Status\", {UNMET} AS \"Requirements Not Met\" FROM x")
def enriched_output(d: DataFrame) -> DataFrame:
    return pipeline.output(d).select(*RAW.split(", "), "Overall Score", "Status", "Requirements Not Met")


@scored("ordered_output", "SELECT id, status, row_number() OVER (ORDER BY id) AS row_idx FROM x")
def ordered_output(d: DataFrame) -> DataFrame:
    return numbered(stage(d.select("id", "status"), "statuses"), ["id"], "place").select("id", "status", (c("place") + 1).alias("row_idx"))


# --- judge ---


@sub("judge_yes_no", "SELECT id, contains(upper(pdf_answer), 'YES') AS yes FROM u")
def judge_yes_no(d: DataFrame) -> DataFrame:
    return d.select("id", judge.says_yes(c("pdf_answer")).alias("yes"))


@sub("parse_verdict", "SELECT id, id % 2 = 0 AS title_match, id % 3 = 0 AS expert_details, id % 5 = 0 AS learning_outcomes, id % 7 = 0 AS objectives, id % 8 <> 0 AS participants, CASE WHEN id % 8 = 0 THEN 'none: given' ELSE '' END AS reasoning FROM u")
def parse_verdict(d: DataFrame) -> DataFrame:
    return d.withColumn("v", judge.verdict(c("pdf_answer"), judge.PDF_KEYS)).select("id", "v.*")


@sub("parse_image_verdict", "SELECT id, id % 2 = 0 AS has_banner, false AS banner_text_matches, id % 3 = 0 AS is_real_event, id % 5 = 0 AS mode_matches, CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE id % 40 END AS INT) AS participant_count, id % 7 = 0 AS has_15_plus, '' AS reasoning FROM u")
def parse_image_verdict(d: DataFrame) -> DataFrame:
    return d.withColumn("v", judge.verdict(c("image_answer"), judge.IMAGE_KEYS)).select("id", "v.*")


@sub("parse_legacy_verdicts", "SELECT id, id % 2 = 0 AS title_match, id % 7 = 0 AS objectives, false AS learning_outcomes, id % 3 = 0 AS expert_details, id % 8 <> 0 AS participants, false AS theme_alignment, CASE WHEN id % 8 = 0 THEN 'none: given' ELSE '' END AS reasoning FROM u")
def parse_legacy_verdicts(d: DataFrame) -> DataFrame:
    """The keys of the older questions, which the newer answers share in part."""
    return d.withColumn("v", judge.verdict(c("pdf_answer"), judge.REVIEW_KEYS)).select("id", "v.*")


@sub("judge_dedupe", "SELECT event_theme AS theme, count(*) AS n, CASE WHEN event_theme = '' THEN -1 ELSE 1 - CAST(('0x' || substr(sha256(event_theme), 1, 8)) AS BIGINT) % 2 END AS yes FROM u GROUP BY event_theme")
def judge_dedupe(d: DataFrame) -> DataFrame:
    yes = F.first(F.when(c("answer").isNotNull(), judge.says_yes(c("answer")).cast("int")).otherwise(-1)).cast("long")
    return judge.judged(d.select(c("m_theme").alias("theme")), "theme").groupBy("theme").agg(F.count("*").alias("n"), yes.alias("yes"))

