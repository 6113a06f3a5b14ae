"""The rubric: weighted predicates as columns, and the registry that applies them.

A rule of a row has an Outcome: whether it passed (null where the row has no such result) and the text of its result.
Rules take plain columns; what several of them use is computed once, before, by plans/pipeline.py.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubrica.functions import scalars as S
from rubrica.functions.normalize import float_text, number
from rubrica.operators.levels import LEVELS, in_level, level_of


@dataclass(frozen=True)
class Rule:
    category: str
    ord: int
    criterion: str
    points: int


# Criteria and points, in order.
RULES = [
    Rule("theme", 1, "Title/Objectives/Learning align to theme", 10),
    Rule("theme", 2, "Level matches duration", 11),
    Rule("theme", 3, "Participants reported > 15", 12),
    Rule("theme", 4, "Year alignment (financial vs academic)", 7),
    Rule("pdf", 5, "PDF title matches metadata", 7),
    Rule("pdf", 6, "Expert details present", 7),
    Rule("pdf", 7, "Learning outcomes align", 3),
    Rule("pdf", 8, "Objectives match", 3),
    Rule("pdf", 9, "Participant info matches", 5),
    Rule("image", 10, "GeoTag present", 6),
    Rule("image", 11, "Banner/Poster visible", 2),
    Rule("image", 12, "Event scene is real activity", 3),
    Rule("image", 13, "Event mode matches (online/offline)", 5),
    Rule("image", 14, "15+ participants visible", 4),
    Rule("similarity", 15, "Duplicate photo detection (filesystem)", 15),
]
# What stands for a whole group whose file is missing.
MISSING_PDF = (Rule("pdf", 16, "PDF Validation", 0), "PDF file missing or could not be downloaded")
MISSING_IMAGES = (Rule("image", 17, "Image Validation", 0), "Event photos missing or invalid")
# Texts of results that an exhausted budget replaces.
DENIED = {
    "theme": "Theme validation skipped: API call budget exhausted",
    "pdf": "PDF validation skipped: API call budget exhausted",
    "image": "Image validation skipped: API call budget exhausted",
}
# Texts of failed rules.
NO_THEME = "Theme missing — cannot validate alignment"
NOT_ALIGNED = "Content does not semantically align with declared theme"
NO_TEXT = "PDF text not extracted"
TITLE_DIFFERS = "PDF title does not match expected: "
NO_EXPERT = "Expert details not found in PDF"
OUTCOMES_DIFFER = "Learning outcomes in PDF do not align with expected outcomes"
OBJECTIVES_DIFFER = "Objectives in PDF do not match expected objectives"
PDF_FEW = "PDF participant information does not match expected (needs 15+ participants)"
NO_GEOTAG = "No geotag found in any image"
NO_BANNER = "Banner or poster not visible in images"
NO_EVENT = "Image does not depict a real event activity"
MODE_DIFFERS = "Event mode in image does not match specified mode: "
IMAGE_FEW = "15+ participants not visible in images"
DUPLICATE = "Duplicate Check: "
# Words that tell of an expert.
HEURISTIC_WORDS = ["expert", "speaker", "facilitator", "instructor", "trainer", "resource person", "keynote", "presenter"]
EXPERT_WORDS = [*HEURISTIC_WORDS, "panelist"]
RESULT = "array<struct<ord:int,category:string,criterion:string,passed:boolean,points:int,message:string>>"


@dataclass(frozen=True)
class Outcome:
    rule: Rule
    passed: Column
    #: The text of a failed result, which may use the column that holds `passed`.
    message: Column
    #: The text of a passed result.
    praise: Column | None = None


def rule(ord_: int) -> Rule:
    return RULES[ord_ - 1]


def rule_points(category: str, criterion: str) -> int:
    return next((r.points for r in RULES if (r.category, r.criterion) == (category, criterion)), 0)


def has_words(body: Column, words: list[str]) -> Column:
    return F.lower(body).rlike("|".join(words))


def level_rule(duration: Column, hours: Column, level: Column) -> Column:
    """struct<passed, message, new_level> of a level text and the hours parsed from the duration text.

    A level that is missing or out of range is derived anew.
    """
    own, derived = level.try_cast("int"), level_of(hours)
    blank = level.isNull() | (level == "")
    h, new = F.concat(float_text(hours), F.lit("h")), derived.cast("string")
    reach = F
    for n, lo, hi in LEVELS:
        reach = reach.when(own == n, f"{int(lo)}+ hours" if hi == float("inf") else f"{int(lo)}-{int(hi)} hours")

    def out(passed: bool, message: Column, new_level: Column | None = None) -> Column:
        found = F.lit(None) if new_level is None else new_level
        return F.struct(F.lit(passed).alias("passed"), message.alias("message"), found.cast("int").alias("new_level"))

    return (
        F.when(hours.isNull() | (hours == 0), out(False, F.concat(F.lit("Duration missing/invalid. Duration: "), duration)))
        .when(blank & derived.isNotNull(), out(True, F.concat(F.lit("Level auto-determined as "), new, F.lit(" based on duration "), h), derived))
        .when(blank, out(False, F.concat(F.lit("Level missing and cannot be determined from duration "), h)))
        .when(own.isNull(), out(False, F.concat(F.lit("Invalid level format: "), level)))
        .when(~own.between(1, 4), out(False, F.concat(F.lit("Invalid level: "), level, F.lit(". Valid levels are 1-4."))))
        .when(in_level(own, hours), out(True, F.lit("")))
        .when(derived.isNotNull() & (derived != own), out(True, F.concat(F.lit("Level auto-corrected from "), level, F.lit(" to "), new, F.lit(" based on duration "), h), derived))
        .otherwise(out(False, F.concat(F.lit("Duration "), h, F.lit(" does not match Level "), level, F.lit(" requirements ("), reach, F.lit(")"))))
    )


def participants_ok(participants: Column) -> Column:
    """More than 15 participants, by a number or its text."""
    return F.coalesce(number(participants).try_cast("bigint"), F.lit(0)) > 15


def year_rule(event_date: Column, year_type: Column, current_year: int) -> Column:
    """struct<passed, message>: the (financial) year lies within one of the current year."""
    d = S.parse_date(event_date)
    financial = F.lower(year_type) == "financial"
    year = F.when(financial, S.fiscal_year(d)).otherwise(F.year(d))
    near = F.abs(year - current_year) <= 1
    far = F.concat(F.when(financial, "Financial year ").otherwise("Academic year "), year.cast("string"), F.lit(f" does not align with current year {current_year}"))
    out = lambda ok, message: F.struct(ok.alias("passed"), message.alias("message"))
    return (
        F.when(event_date.isNull() | (event_date == ""), out(F.lit(False), F.lit("Event Date missing")))
        .when(d.isNull(), out(F.lit(False), F.concat(F.lit("Invalid event date format: "), event_date)))
        .otherwise(out(near, F.when(near, "").otherwise(far)))
    )


def theme_outcomes(theme: Column, aligned: Column, misfit: Column, level: Column, participants: Column, granted: Column) -> list[Outcome]:
    """Rules 1 to 3. level is a level_rule(); without budget only the first remains, failed."""
    blank = theme == ""
    return [
        Outcome(rule(1), granted & ~blank & F.coalesce(aligned, F.lit(False)), F.when(~granted, DENIED["theme"]).when(blank, NO_THEME).otherwise(misfit)),
        Outcome(rule(2), F.when(granted, level["passed"]), level["message"], level["message"]),
        Outcome(rule(3), F.when(granted, participants_ok(participants)), F.concat(F.lit("Participants reported: "), participants.cast("string"), F.lit(" (needs > 15)"))),
    ]


def year_outcome(verdict: Column, granted: Column) -> Outcome:
    return Outcome(rule(4), F.when(granted, verdict["passed"]), verdict["message"])


def group(category: str, checks: list[tuple[int, Column, Column]], present: Column, granted: Column, missing: tuple[Rule, str]) -> list[Outcome]:
    """The checks (rule, passed, text) of a file, or the one result that tells of its absence."""
    answered = lambda ok: F.when(present, granted & F.coalesce(ok, F.lit(False)))
    out = [Outcome(rule(i), answered(ok), F.when(~granted, DENIED[category]).otherwise(why)) for i, ok, why in checks]
    return [*out, Outcome(missing[0], F.when(~present, F.lit(False)), F.lit(missing[1]))]


def pdf_outcomes(present: Column, empty: Column, expert: Column, verdict: Column, title: Column, granted: Column) -> list[Outcome]:
    """Rules 5 to 9: an empty text fails all with one message."""
    checks = [
        (5, verdict["title_match"], F.concat(F.lit(TITLE_DIFFERS), title)),
        (6, F.coalesce(verdict["expert_details"], F.lit(False)) | expert, F.lit(NO_EXPERT)),
        (7, verdict["learning_outcomes"], F.lit(OUTCOMES_DIFFER)),
        (8, verdict["objectives"], F.lit(OBJECTIVES_DIFFER)),
        (9, verdict["participants"], F.lit(PDF_FEW)),
    ]
    return group("pdf", [(i, ~empty & ok, F.when(empty, NO_TEXT).otherwise(why)) for i, ok, why in checks], present, granted, MISSING_PDF)


def image_outcomes(present: Column, verdict: Column, mode: Column, granted: Column, geotag: Column | None = None) -> list[Outcome]:
    """Rules 11 to 14, and 10 where it is enabled; without budget 10 fails in any case."""
    checks = [
        (10, F.lit(False) if geotag is None else geotag, F.lit(NO_GEOTAG)),
        (11, verdict["has_banner"], F.lit(NO_BANNER)),
        (12, verdict["is_real_event"], F.lit(NO_EVENT)),
        (13, verdict["mode_matches"], F.concat(F.lit(MODE_DIFFERS), F.lower(mode))),
        (14, verdict["has_15_plus"], F.lit(IMAGE_FEW)),
    ]
    first, *rest = group("image", checks, present, granted, MISSING_IMAGES)
    return [first if geotag is not None else Outcome(first.rule, F.when(~granted, first.passed), first.message), *rest]


def duplicate_outcome(messages: Column) -> Outcome:
    """messages: array of what the photos repeat; none (or null) passes."""
    return Outcome(rule(15), F.coalesce(F.size(messages) < 1, F.lit(True)), F.concat(F.lit(DUPLICATE), F.array_join(messages, "; ")))


def geotag_any(images: Column) -> Column:
    return F.exists(images, lambda x: x["has_geotag"])


def heuristic_score(expert: Column, n_images: Column, participants: Column, level: Column, duration_hours: Column, texts: list[Column]) -> Column:
    """Points that need no judge; expert tells whether the report has one of HEURISTIC_WORDS."""
    filled = F.lit(True)
    for t in texts:
        filled = filled & (F.trim(t) != "")
    parts = [(expert, 7), (n_images >= 1, 2), (participants_ok(participants), 12), (in_level(level, duration_hours), 11), (filled, 5)]
    return F.least(sum((F.when(ok, n).otherwise(0) for ok, n in parts), F.lit(0)), F.lit(100)).cast("int")
