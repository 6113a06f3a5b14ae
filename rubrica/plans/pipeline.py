"""Scoring a batch of submissions, from raw rows to output.

The plan is a chain of projections. What several expressions use (hours, verdicts, the level rule, each rule's outcome) is a column of an earlier
step, which the optimizer does not copy into its uses; reports are scanned once each, before they are joined to the rows that name them.
Only duplicates, budgets and missing files need other rows; they come in as columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import EngineConfig
from rubrica.functions import scalars as S
from rubrica.operators import duplicates, judge, quota, rules, score
from rubrica.operators.levels import parse_hours, parse_hours_by_unit
from rubrica.operators.mapping import split_paths
from rubrica.operators.state import BudgetLedger, PhotoIndex
from rubrica.plans.staging import bounded, stage


def report_features(reports: DataFrame, text: str = "text", words: list[str] = rules.EXPERT_WORDS) -> DataFrame:
    """reports with has_pdf, pdf_empty and pdf_expert instead of their text: one scan for each report."""
    body = F.col(text)
    flags = {"has_pdf": F.lit(True), "pdf_empty": F.coalesce(body == "", F.lit(True)), "pdf_expert": F.coalesce(rules.has_words(body, words), F.lit(False))}
    return reports.withColumns(flags).drop(text)


def with_reports(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """df with the features of its report; a row without one has no PDF."""
    joined = df.join(features, key, "left")
    return joined.withColumns({"has_pdf": F.coalesce("has_pdf", F.lit(False)), "pdf_empty": F.coalesce("pdf_empty", F.lit(True)), "pdf_expert": F.coalesce("pdf_expert", F.lit(False))})


def photos(df: DataFrame, ord_: str) -> DataFrame:
    """(submission, ord, pos, key, path) of every photo that a row that can be processed names."""
    named = df.where("broken is null").select(F.col("sid").alias("submission"), F.col(ord_).alias("ord"), F.col("directory").alias("key"), F.posexplode_outer(split_paths(F.col("m_image_paths"))).alias("pos", "path"))
    return named.where("path is not null").select("submission", "ord", "pos", "key", "path")


def with_images(df: DataFrame, images: DataFrame, ord_: str) -> DataFrame:
    """df with n_images and has_geotag of images(ord, has_geotag) that exist."""
    found = images.groupBy(F.col("ord").alias(ord_)).agg(F.count("*").cast("int").alias("n_images"), F.bool_or("has_geotag").alias("has_geotag"))
    return df.join(found, ord_, "left").withColumns({"n_images": F.coalesce("n_images", F.lit(0)), "has_geotag": F.coalesce("has_geotag", F.lit(False))})


def with_duplicates(df: DataFrame, images: DataFrame, ord_: str, threshold: int, index: PhotoIndex | None = None, batch: int = 0) -> DataFrame:
    """df with duplicate_messages, what its photos repeat; null for none. An index knows earlier batches, and remembers this one."""
    if index:
        images = stage(index.lookup(batch, images), "looked-up")
    found = stage(duplicates.greedy_messages(images, threshold), "found")  # else the plan of scoring holds that of the scan too
    if index:
        index.add(batch, duplicates.remembered(images, found))
    return df.join(bounded(found).select(F.col("ord").alias(ord_), F.col("messages").alias("duplicate_messages")), ord_, "left")


def calls(df: DataFrame, key: Column, ord_: str) -> DataFrame:
    """(id, idx, step) of the judge calls that the rows make: 1 theme, 2 PDF, 3 images, for files that exist."""
    steps = F.array_compact(F.array(F.lit(1), F.when(F.col("has_pdf"), 2), F.when(F.col("n_images") > 0, 3)))
    return df.where("broken is null").select(key.alias("id"), F.col(ord_).alias("idx"), F.explode_outer(steps).alias("step")).where("step is not null")


def with_budget(df: DataFrame, key: Column, ord_: str, max_calls: int = 5, ledger: BudgetLedger | None = None, batch: int = 0) -> DataFrame:
    """df with theme_granted, pdf_granted and image_granted: whether the id's budget still allows the call. A ledger knows what earlier batches used, and charges this one."""
    made = stage(calls(df, key, ord_), "calls")
    cut = ledger.last_granted(batch, made) if ledger else stage(quota.last_granted(made, max_calls), "budgets")
    cut = cut.withColumnRenamed("id", "budget_id")
    joined = df.withColumn("budget_key", key).join(cut, F.col("budget_key") == F.col("budget_id"), "left")
    flag = lambda step: F.coalesce(F.struct(F.col(ord_).alias("idx"), F.lit(step).alias("step")) <= F.col("cut"), F.lit(False))
    return joined.withColumns({f"{n}_granted": flag(i) for i, n in enumerate(("theme", "pdf", "image"), 1)}).drop("budget_key", "budget_id", "cut")


def with_answers(df: DataFrame, body: str, image: str, provider: judge.Provider, config: EngineConfig = EngineConfig(), *, pictures: DataFrame | None = None, **how) -> DataFrame:
    """df with theme_answer, pdf_answer and image_answer of a judge; calls without budget, text or image are not made. image as judged() takes it, with `pictures` a path.

    For the theme, the provider and the fallback race where the first answer fails.
    """
    granted = lambda n: F.col(f"{n}_granted") if f"{n}_granted" in df.columns else F.lit(True)
    prompts = {
        "theme": judge.theme_prompt(F.col("m_title"), F.col("m_objectives"), F.col("m_outcomes"), F.col("m_theme")),
        "pdf": judge.pdf_prompt(F.col(body), F.col("m_title"), F.col("m_objectives"), F.col("m_outcomes"), F.col("m_participants"), config),
        "image": F.when(F.col(image).isNotNull(), judge.image_prompt(F.col("m_mode"), F.col("m_title"), F.col("m_theme"))),
    }
    for name, prompt in prompts.items():
        asked = df.withColumn("prompt", F.when(granted(name) & F.col("broken").isNull(), prompt))
        df = judge.judged(asked, "prompt", provider, f"{name}_answer", image=image if name == "image" else None, pictures=pictures if name == "image" else None, hedged=name == "theme", config=config, **how).drop("prompt")
    return df


def scored(df: DataFrame, config: EngineConfig = EngineConfig(), extra: list[rules.Outcome] = ()) -> DataFrame:
    """Mapped rows with outcomes (ok_*, why_*), score, status and unmet; no shuffle, no Python.

    df has the columns of mapped(), has_pdf, pdf_empty, pdf_expert, n_images, the three answers, and may have duplicate_messages,
    has_geotag and the three *_granted. `extra` are rules of the caller's own, with ords from 18 on.
    """
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")  # the JVM never compiles larger methods, into which this chain would go
    c = F.col
    have = lambda name, default: c(name) if name in df.columns else default
    granted = {n: have(f"{n}_granted", F.lit(True)) for n in ("theme", "pdf", "image")}
    geotag, repeated = have("has_geotag", F.lit(False)), have("duplicate_messages", F.lit(None).cast("array<string>"))
    steps = {
        "x_hours": parse_hours(c("m_duration")),
        "x_pdf": F.when(c("has_pdf"), judge.verdict(c("pdf_answer"), judge.PDF_KEYS)),
        "x_image": F.when(c("n_images") > 0, judge.verdict(c("image_answer"), judge.IMAGE_KEYS)),
        "x_expected": S.expected_title(c("canonical"), c("m_type"), c("m_theme"), c("m_title")),
    }
    df = df.withColumns(steps)
    more = {"x_level": rules.level_rule(c("m_duration"), c("x_hours"), c("m_level").cast("string"))}
    if config.enable_year:
        more["x_year"] = rules.year_rule(c("m_date"), c("m_year_type"), config.current_year or datetime.now().year)
    df = df.withColumns(more)
    misfit = S.title_message(c("canonical"), c("x_expected"), c("m_title"), F.lit(rules.NOT_ALIGNED))
    outcomes = [
        *rules.theme_outcomes(c("m_theme"), judge.says_yes(c("theme_answer")), misfit, c("x_level"), c("m_participants"), granted["theme"]),
        *([rules.year_outcome(c("x_year"), granted["theme"])] if config.enable_year else []),
        *rules.pdf_outcomes(c("has_pdf"), c("pdf_empty"), c("pdf_expert"), c("x_pdf"), c("m_title"), granted["pdf"]),
        *rules.image_outcomes(c("n_images") > 0, c("x_image"), c("m_mode"), granted["image"], geotag if config.enable_geotag else None),
        rules.duplicate_outcome(repeated),
        *extra,
    ]
    fine = c("broken").isNull()
    outcomes = [rules.Outcome(o.rule, F.when(fine, o.passed), o.message, o.praise) for o in outcomes]
    df = score.held(df, outcomes).withColumn("score", F.when(fine, score.total(outcomes)).otherwise(0))
    state = F.when(~fine, "Error").otherwise(score.status(c("score"), c("has_pdf"), c("n_images") > 0, config.acceptance_threshold))
    unmet = F.when(~fine, F.concat(F.lit("Processing error: "), c("broken"))).otherwise(score.unmet(outcomes))
    return df.withColumns({"status": state, "unmet": unmet, "results": score.results(outcomes)})


def heuristic(df: DataFrame) -> Column:
    """The score that needs no judge; pdf_expert must stem from HEURISTIC_WORDS."""
    c = F.col
    return rules.heuristic_score(c("pdf_expert"), c("n_images"), c("m_participants"), c("m_level"), parse_hours_by_unit(c("m_duration")), [c("m_theme"), c("m_objectives"), c("m_outcomes")])


def output(df: DataFrame, level: bool = False) -> DataFrame:
    """The raw columns, first of each name, and the three result columns; with `level`, the level that rule 2 derived."""
    three = {"Overall Score": "score", "Status": "status", "Requirements Not Met": "unmet"}
    raw = [f.name for f in df.schema["raw"].dataType.fields]
    names = [n for n in dict.fromkeys(raw) if n not in three]
    columns = [F.col("raw")[n].alias(n) for n in names] + [F.col(v).alias(k) for k, v in three.items()]
    return df.select(*columns, *([F.col("x_level.new_level").cast("string").alias("Level")] if level else []))


def long(df: DataFrame) -> DataFrame:
    """A row for each result: (id, ord, category, criterion, passed, points, message).

    For a generator that drops empty arrays the optimizer copies the array's whole expression into a filter below; the outer one has none.
    """
    return df.select("id", F.inline_outer("results")).where("ord is not null")
